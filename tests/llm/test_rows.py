"""Repeated rows, shared and null ids, very long texts and partition counts, against brute force by row."""

from __future__ import annotations

import contextlib
import os
import sys
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

import brute  # noqa: E402
from oracle import DATA  # noqa: E402

from ionlake.llm import chat_format, embedding_dedup, exact_dedup, language_id, linear_text, minhash_dedup, mixing, packing, pii, queries, substring_dedup, warc  # noqa: E402
from ionlake.llm.shared import Stage, releasing  # noqa: E402

A, B = "a" * 96 + " one two three four", "b" * 96 + " one two three four"
WORDS = " ".join(f"u{k}" for k in range(60))
RUN = " ".join(f"r{k}" for k in range(40))
#: (id, text) with ids that several texts share, whole rows that repeat, and ids that are null.
ROWS = [(1, A), (1, B), (2, A), (3, B), (1, A), (4, RUN), (5, RUN + " x"), (4, WORDS), (6, WORDS + " tail"), (None, A), (None, WORDS), (7, None), (7, None), (7, ""), (8, WORDS.upper())]


def frame(spark, data=ROWS):
    clash = {c: F.lit("clash") for c in ("id", "rep", "vertex", "component", "chunk", "next", "th", "_kept_id", "_gone_id", "_mix_id", "_copies", "_copy", "rest", "size")}
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)


def as_rows(got, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in columns]) for r in got), key=repr)


def listed(found):
    return sorted(((i is None, i or 0, *rest) for i, *rest in found), key=repr)


def test_exact_dedup_tells_rows_apart_by_text(spark):
    got = exact_dedup.exact_classes(frame(spark)).collect()
    plain = [(t or "").translate(brute.LOWER) for _, t in ROWS]
    wanted = []
    for (i, _), t in zip(ROWS, plain, strict=True):
        ids = [j for (j, _), u in zip(ROWS, plain, strict=True) if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        wanted.append((i, keep, len(ids), i == keep))
    assert as_rows(got, "keep_id", "group_size", "kept") == listed(wanted)
    kept = exact_dedup.keep_one(frame(spark)).select("doc_id", "text").collect()
    assert sorted((r["text"] or "").translate(brute.LOWER) for r in kept) == sorted(set(plain))
    assert exact_dedup.keep_one(frame(spark)).columns == frame(spark).columns


def test_exact_dedup_of_null_ids_alone(spark):
    data = [(None, "x" * 200), (None, "x" * 200), (None, "x" * 150)]
    got = exact_dedup.exact_classes(frame(spark, data)).collect()
    assert sorted((r["group_size"], r["keep_id"], r["kept"]) for r in got) == [(1, None, True), (2, None, True), (2, None, True)]


def test_minhash_rows(spark):
    own = [(i, t) for i, t in ROWS if i is not None]
    by_row = brute.near({k: t for k, (_, t) in enumerate(own)}, 3, 85)
    groups: dict = {}
    for k, (i, _) in enumerate(own):
        groups.setdefault(by_row[k][1], []).append(i)
    wanted = [(i, by_row[k][0], min(groups[by_row[k][1]]) if by_row[k][0] else i) for k, (i, _) in enumerate(own)]
    assert as_rows(minhash_dedup.near_duplicates(frame(spark), 0.85, 3).collect(), "n_shingles", "component_id") == listed(wanted)
    kept = minhash_dedup.keep_one(frame(spark), 0.85, 3)
    assert kept.columns == frame(spark).columns and {t for _, t in ROWS if t in (A, B)} <= {r["text"] for r in kept.select("text").collect()}


def test_minhash_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(260):
        w = [f"w{k}" for k in range(150)]
        for j in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            w[j] = f"n{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    wanted = {d: c for d, (_, c) in brute.near(dict(enumerate(texts)), 3, 85).items()}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = minhash_dedup.near_duplicates(frame(spark, list(enumerate(texts))), 0.85, 3).collect()
            assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_minhash_disk_holds_one_round_of_trees(spark, monkeypatch, tmp_path):
    """Shuffle files that lie on disk while sorted orders are read, and after the last step, a document."""
    rng, n = np.random.default_rng(10), 2000
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 80)) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    root, notes, plain = spark.conf.get("spark.local.dir"), str(tmp_path), minhash_dedup._neighbours

    def on_disk():
        total = 0
        for folder, _, names in os.walk(root):
            for name in names:
                with contextlib.suppress(OSError):  # a file may go meanwhile
                    total += os.path.getsize(f"{folder}/{name}") if name.startswith("shuffle_") else 0
        return total

    def measured(similarity):
        inner = plain(similarity)

        def run(batches):
            Path(f"{notes}/{uuid.uuid4().hex}").write_text(str(on_disk()))
            yield from inner(batches)

        return run

    monkeypatch.setattr(minhash_dedup, "_neighbours", measured)
    was, key, before = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled", on_disk()
    cleaned = spark.conf.get(key, None)
    spark.conf.set("spark.sql.shuffle.partitions", 40)  # as in a large table, a partition has rows of one tree or two
    try:
        rows, found = minhash_dedup.near_components(docs, 0.85, 3)
        after = on_disk() - before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    most = max(int(f.read_text()) for f in tmp_path.iterdir()) - before
    assert most < 1500 * n and after < 100 * n, (most / n, after / n)
    assert rows.count() == found.select("component_id").distinct().count() == n
    assert spark.conf.get(key, None) == cleaned


def test_minhash_borders_name_no_region_that_is_too_large():
    """A border in a region of many rows names its deepest one alone; smaller ones are named at each depth."""
    sig = np.zeros((100, minhash_dedup.BINS), np.uint16)
    sig[:, 6] = np.arange(100) // 20
    sig[:, 7] = np.arange(100) % 20
    keys, n = minhash_dedup.keys_of(sig, 0, 1), pa.array(np.arange(100))
    batch = pa.RecordBatch.from_arrays([minhash_dedup.binaries(keys), n, n, n, minhash_dedup.binaries(minhash_dedup.sketches(sig))], ["key", "vertex", "component", "n", "sketch"])
    for rows in (100, 30):  # in one batch and in several
        cut = [batch.slice(k, rows) for k in range(0, 100, rows)]
        leaves = {x for b in minhash_dedup._neighbours(0.85)(iter(cut)) for x in b.column("leaf").to_pylist() if x is not None}
        assert leaves == {keys[k, : 1 + 2 * d].tobytes() for k in (0, 99) for d in (7, 8)}


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    for n in (60, 200, 3000):
        shared = int(np.ceil(0.85 * 2 * n / 1.85))
        g, doc = [], []
        for k in range(200):
            both = rng.integers(0, 1 << 63, shared, dtype=np.int64).view(np.uint64)
            for side in (0, 1):
                g.append(np.concatenate([both, rng.integers(0, 1 << 63, n - shared, dtype=np.int64).view(np.uint64)]))
                doc.append(np.full(n, 2 * k + side))
        sig = minhash_dedup.signatures(np.concatenate(g), np.concatenate(doc), 400)
        sketch = minhash_dedup.sketches(sig).view(np.uint64)
        sizes = np.full(200, n)
        assert minhash_dedup.likely(sketch[::2], sketch[1::2], sizes, sizes, 0.85).all()
        assert not minhash_dedup.likely(sketch[::2], np.roll(sketch[1::2], 1, axis=0), sizes, sizes, 0.85).any()


def test_substring_rows(spark):
    own = [(i, t) for i, t in ROWS if i is not None]
    found = brute.repeats({k: t for k, (_, t) in enumerate(own)}, 35)
    got = [{**r.asDict(), "sha": brute.sha(r["kept_text"])} for r in substring_dedup.remove_repeats(frame(spark), 35).collect()]
    assert as_rows(got, "n_words", "n_removed", "sha") == listed([(i, *found[k]) for k, (i, _) in enumerate(own)])
    data = [(1, " ".join(f"w{k}" for k in range(40))), (2, " ".join(f"w{k}" for k in range(40)) + " more"), (1, WORDS)]
    got = substring_dedup.remove_repeats(frame(spark, data), 35).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 40, 40), (1, 60, 0), (2, 41, 40)]


def test_substring_pieces_hold_each_window_once():
    rng = np.random.default_rng(3)
    for width in (7, 1):
        segment = " ".join(f"v{x}" for x in rng.integers(0, 30, 62)).encode()
        h, _, _ = substring_dedup.words(np.frombuffer(segment, np.uint8), np.array([0, len(segment)]))
        anchor, first, n, _ = substring_dedup.anchors_of(h, np.zeros(len(h), int), 35)
        w = segment.split()
        for a, f, k in zip(anchor, first, n, strict=True):
            own = b" ".join(w[f : f + k + 34])
            found = substring_dedup.pieces_of(own, int(a.view(np.int64)), 35, width)
            assert [s + j for s, m, _, _ in found for j in range(m)] == list(range(k))
            for s, m, core, piece in found:
                assert piece == b" ".join(w[f + s : f + s + m + 34])
                assert all(core in b" ".join(w[f + s + j : f + s + j + 35]) for j in range(m))


def test_embedding_rows_and_lengths(spark):
    rng = np.random.default_rng(4)
    u, v = [float(x) for x in rng.normal(size=4)], [float(x) for x in rng.normal(size=5)]
    data = [(1, u, 1), (2, u, 1), (3, v, 1), (4, v, 1), (5, u, 2), (3, u, 1), (3, u, 1), (None, u, 1), (6, [], 1), (7, [None, 1.0], 1)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 0.93).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 1, 3), (3, 3, 1), (3, 3, 1), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_embedding_lists_are_dealt_by_a_second_pivot(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LIST", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    data = [(k, [float(x) for x in centres[k % 60] + rng.normal(size=32) * 0.12], 1) for k in range(1500)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 0.93).collect()}
    wanted = brute.cosine_links(data, 0.93)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in wanted.values()) and all(got[k][0] <= wanted[k][0] for k in got)


def test_warc_rows(spark):
    pages = [(1, "x"), (5, "x"), (5, "y"), (1, "x"), (6, "y"), (None, "x"), (9, None), (9, "")]
    df = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in pages], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, Stage(spark, "t").path("warc"))).collect()
    wanted = [(1, "response", None), (5, "revisit", 1), (5, "response", None), (1, "response", None), (6, "revisit", 5), (None, "response", None), (9, "response", None), (9, "response", None)]
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(wanted, key=repr)


def test_warc_large_record():
    import pyarrow as pa

    text = np.random.default_rng(2).integers(0, 256, 12 << 20, dtype=np.uint8).tobytes()
    data = warc.member(warc.record(1, "u", text, None)) + b"".join(warc.member(warc.record(k, "u", b"small", None)) for k in range(2, 2000))
    found = [(warc.parse(r)["page_id"], warc.parse(r)["payload_bytes"]) for _, r in warc.records_in(pa.BufferReader(data), 0, len(data))]
    assert found == [(1, len(text)), *[(k, 5) for k in range(2, 2000)]]


def test_chat_roles_come_back(spark):
    roles = ["a\0b", "a\\b", "\\n", "\n\\", "<|im_end|>", "<\\|", "\\b\\\\n"]
    df = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(df.withColumn("content", chat_format.text_parts(F.col("text"))))
    assert [t["role"] for t in made.select(chat_format.read_back(F.col("formatted")).alias("t")).first()["t"]] == roles


def test_pii_rows_and_a_long_text(spark):
    long = "x@y.zz 1.2.3.4 " * 70_000
    got = pii.find(frame(spark, [(1, "a@b.co"), (1, "a@b.co"), (1, None), (2, long)])).select("doc_id", F.size("spans").alias("n"), F.try_element_at("spans", F.lit(-1)).alias("last")).collect()
    assert sorted((r["doc_id"], r["n"]) for r in got) == [(1, 0), (1, 1), (1, 1), (2, 140_000)]
    assert next(r["last"]["start"] for r in got if r["doc_id"] == 2) == long.rindex("1.2")


def test_language_sample_is_the_first_by_hash(spark):
    data = [(k, f"{'der die das' if k % 3 else 'the and of'} {k}") for k in range(3000)]
    df = frame(spark, data).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("de"))
    tops = linear_text.bounded_sample(df.select("lang", "doc_id"), "lang", "doc_id", 100, 5)
    hashes = {(r["lang"], r["h"]) for r in df.select("lang", F.xxhash64("doc_id").alias("h")).collect()}
    for lang in ("en", "de"):
        wanted = sorted(h for x, h in hashes if x == lang)[:100]
        assert tops[lang][0] == (1000 if lang == "en" else 2000) and [h for h in sorted(h for x, h in hashes if x == lang) if h <= tops[lang][1]] == wanted
    many = spark.createDataFrame([(f"l{k}", k) for k in range(30)] + [("big", 100 + k) for k in range(9)], "lang string, doc_id long")
    assert set(linear_text.bounded_sample(many, "lang", "doc_id", 5, 3)) == {"big", "l0", "l1"}
    # One id that holds most rows fills no sample.
    hot = spark.createDataFrame([(1, "en", f"t{k % 3}") for k in range(500)] + [(2, "en", "u")], "id long, label string, text string")
    sample = linear_text.sampled(hot, linear_text.bounded_sample(hot, "label", "id", 100))
    assert sorted(r["text"] for r in sample.collect()) == ["t0", "u"]


def test_language_scores_are_those_of_the_plain_sum(spark):
    docs = queries.table(spark, DATA, "documents")
    model = language_id.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(40).collect()}
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for d, t in texts.items():
        bucket, _ = model.features.buckets([t or ""])
        if t and any(map(str.isalpha, t)):
            s = np.zeros(len(model.labels))
            for b in bucket:
                s += model.table[b]
            e = np.exp(s / len(bucket) / model.temperature)
            assert got[d]["lang_pred"] == model.labels[int(np.argmax(e))] and abs(got[d]["score"] - (e / e.sum()).max()) < 1e-3
    twice = docs.unionByName(docs)
    assert language_id.predict(twice, model).distinct().count() == docs.select("doc_id").distinct().count()


def test_mixing_query_against_a_plain_solver(spark):
    out = queries.op3_mixing(spark, DATA).collect()
    names = sorted(c[2:] for c in out[0].asDict() if c.startswith("p_"))
    p, n, r = np.array([[o[f"p_{x}"] for x in names] for o in out]), np.array([o["n_tokens"] for o in out], float), np.ones(len(out))
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").collect()}
    assert all(o["n_tokens"] == len(brute.WORD.findall(texts[o["doc_id"]] or "")) for o in out) and np.allclose(p.sum(1), 1)
    supply, share = p.T @ n, np.array([queries.MIX[x] for x in names])
    total = min(supply[k] / share[k] for k, x in enumerate(names) if x not in queries.AT_MOST)
    target = np.array([min(share[k] * total, supply[k]) if x in queries.AT_MOST else share[k] * total for k, x in enumerate(names)])
    assert np.allclose(target, [out[0][f"target_{x}"] for x in names])
    m = (p * n[:, None]).T @ p
    for _ in range(500):
        r = np.maximum(0, r - p @ np.linalg.solve(m, p.T @ (n * r) - target))
    reached = p.T @ (n * np.array([o["rate"] for o in out]))
    assert np.allclose(reached, [out[0][f"reached_{x}"] for x in names])
    assert np.abs(reached - target).max() <= np.abs(p.T @ (n * r) - target).max() + 1e-3 * total
    assert all(int(o["rate"]) <= o["copies"] <= int(o["rate"]) + 1 for o in out)


def test_mixing_rows(spark):
    data = [(k, f"x{k % 7} x y{k % 5}") for k in range(60)] + [(1, "x1 x y1"), (2, None), (None, "x")]
    df = frame(spark, data)
    lab = spark.createDataFrame([(k, "xy"[k % 2]) for k in range(40)] + [(1, "x"), (1, "y")], "doc_id long, domain string")
    out = mixing.mix(df, mixing.train(df, lab), {"x": 0.5, "y": 0.5})
    assert out.count() == len(data)
    assert mixing.apply(df, out).columns == df.columns


def test_packing_rows(spark):
    data = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, "z"), (2, None)]
    out = packing.pack_documents(frame(spark, data), queries.tokenizer_path(), 64).collect()
    assert len(out) == 5 and sorted(r["length"] for r in out) == sorted(len(packing.encoder(queries.tokenizer_path())(t or "")) + 1 for _, t in data)
    assert {r["ids_crc32"] for r in out if r["doc_id"] == 2} == {zlib.crc32(np.array([2], "<u4").tobytes())}


def test_staged_tables_are_released(spark):
    with releasing():
        stage = Stage(spark, "released")
        kept = stage.keep(spark.range(5), "t")
        assert kept.count() == 5
    assert not stage.live


def test_filters_leave_clashing_columns_alone(spark):
    docs = frame(spark, [(1, WORDS), (2, WORDS), (3, RUN)])
    model = mixing.train(docs, spark.createDataFrame([(1, "x"), (3, "y")], "doc_id long, domain string"))
    for kept in (exact_dedup.keep_one(docs), minhash_dedup.keep_one(docs), mixing.apply(docs, mixing.mix(docs, model, {"x": 1.0})), language_id.keep_identified(docs, language_id.train(docs))):
        found = kept.select("_kept_id", "_gone_id", "_copies", "next").distinct().collect()
        assert kept.columns == docs.columns and [tuple(r) for r in found] == [("clash",) * 4]
