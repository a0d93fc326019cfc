"""What the corpus queries return, in DuckDB SQL, where SQL can say it in reasonable time.

Learned models (3, 9), token ids (10), all periods of long texts (12) and the bank numbers' possessive patterns (8) have no SQL;
tests compare those queries with brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

#: Smallest id reachable from each row of links(a, b).
_COMPONENTS = """
    ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, l.b FROM reach r JOIN ends l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""

_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"

ORACLE = {
    "op1_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
        sh AS (
          SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        {_COMPONENTS}
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, least(w.doc_id, coalesce(b, w.doc_id)) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
    """,
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
        word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
        starts AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda k: array_to_string(w[k:k + 34], ' '))) AS t, unnest(range(1, len(w) - 33)) AS j FROM w),
        win AS (SELECT doc_id, j, t FROM word LEFT JOIN starts USING (doc_id, j)),
        twice AS (SELECT t FROM win WHERE t IS NOT NULL GROUP BY t HAVING count(*) > 1),
        covered AS (
          SELECT doc_id, j, max(CASE WHEN twice.t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
          FROM win LEFT JOIN twice USING (t)
        ),
        kept AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY j) AS kept FROM word JOIN covered USING (doc_id, j) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op4_embedding_dedup": f"""
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
        ),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
        {_COMPONENTS},
        n AS (SELECT a, count(*) AS n FROM ends GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
    """,
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    # Base32 takes five bits of the digest at a time.
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        b AS (SELECT *, array_to_string(list_transform(string_split(sha1(t), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), '') AS bits FROM p),
        d AS (
          SELECT page_id, t, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(5 * k + j AS BIGINT), 1) AS BIGINT) << (5 - j)))::BIGINT, 1)), '') AS payload_digest
          FROM b
        )
        SELECT page_id, strlen(t) AS payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER (PARTITION BY t) THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> min(page_id) OVER (PARTITION BY t) THEN min(page_id) OVER (PARTITION BY t) END AS refers_to
        FROM d
    """,
    "op7_chat_format": f"""
        WITH m AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>' || {_ESCAPED.format("role")} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op11_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
        line AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS k FROM l),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
        repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        told AS (SELECT doc_id, k, line, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM told GROUP BY doc_id
    """,
    # CRC-32 takes a byte at a time from a table that the polynomial gives; gains are in doubles.
    "op13_importance_resampling": """
        WITH RECURSIVE rest(i, r, k) AS (
          SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM rest WHERE k < 8
        ),
        crc AS (SELECT list(r ORDER BY i) AS t FROM rest WHERE k = 8),
        w AS (
          SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)
        ),
        f AS (
          SELECT kind, id, unnest(w) AS f FROM w
          UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM w
          UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) FROM w
        ),
        bytes AS (SELECT f, list_prepend(4294967295, list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda k: (instr('123456789ABCDEF', h[2 * k + 1]) * 16 + instr('123456789ABCDEF', h[2 * k + 2]))::BIGINT)) AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f))),
        hashed AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
        counted AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN hashed USING (f) GROUP BY bucket),
        total AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM counted),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(c.t + 1 AS DOUBLE) * (total.s + 10000)) / (CAST(c.s + 1 AS DOUBLE) * (total.t + 10000)))) AS BIGINT) AS g FROM counted c, total),
        weighed AS (SELECT id, count(*) AS n, sum(g) AS weight FROM f JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
        scored AS (
          SELECT id AS doc_id, len(w.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                 CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM w LEFT JOIN weighed USING (id) WHERE kind = 'd'
        ),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM placed) THEN place END AS rank
        FROM scored LEFT JOIN placed USING (doc_id)
    """,
}
