"""The corpus operators against brute force, with edge cases."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

import brute  # noqa: E402
from oracle import DATA, by_duckdb, rows  # noqa: E402

from ionlake.llm import chat_format, embedding_dedup, exact_dedup, language_id, minhash_dedup, mixing, packing, pii, queries, substring_dedup, warc  # noqa: E402
from ionlake.llm.components import components  # noqa: E402
from ionlake.llm.shared import Stage  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
BASE = " ".join(f"word{k}" for k in range(200))
TEXTS = [None, "", " \t\n", "a", "A", "one two", "One  two", BASE, BASE.upper(), BASE.replace("word50", "other"), BASE + " " + BASE, "Und " * 120, LONG, LONG + " end", "x" * 100_000, "éÉ ÀÀ", "same text", "same text"]


def frame(spark, texts, extra=True):
    rows_ = [(k, t, None if k % 3 else "en", None, None) for k, t in enumerate(texts)]
    out = spark.createDataFrame(rows_, DOC)
    # Extra columns with names that the operators use inside.
    return out.withColumns({"id": F.lit("clash"), "rep": F.lit(None), "a": F.lit(1), "count": F.lit(2), "chunk": F.lit("c"), "spans": F.lit(0)}) if extra else out


def documents(spark):
    return queries.table(spark, DATA, "documents")


def text_of(spark):
    return {r["doc_id"]: r["text"] for r in documents(spark).select("doc_id", "text").collect()}


# ------------------------------------------------------------------ all
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_oracle(spark, name):
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(by_duckdb(queries.oracle_sql()[name]))


# ------------------------------------------------------------------ 5


def test_exact_dedup_edges(spark):
    texts = [*TEXTS, LONG, LONG[:-1] + "!", BASE[:96], BASE[:97], "z" * 96, "Z" * 96]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_classes(frame(spark, texts)).collect()}
    plain = [(t or "").translate(brute.LOWER) for t in texts]
    for k, t in enumerate(plain):
        same = [j for j, u in enumerate(plain) if u == t]
        assert got[k] == (max(same), len(same), k == max(same)), (k, t[:40])
    assert exact_dedup.exact_classes(frame(spark, TEXTS).limit(0)).count() == 0
    assert exact_dedup.keep_one(frame(spark, texts)).count() == len(set(plain))


# ------------------------------------------------------------------ 1
@pytest.mark.parametrize(("width", "similarity"), [(3, 0.85), (5, 0.8)])
def test_minhash_finds_all_links(spark, width, similarity):
    wanted = brute.near(text_of(spark), width, round(100 * similarity))
    got = minhash_dedup.near_duplicates(documents(spark), similarity, width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_edges(spark):
    wanted = brute.near(dict(enumerate(TEXTS)), 3, 85)
    got = minhash_dedup.near_duplicates(frame(spark, TEXTS), 0.85, 3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert minhash_dedup.near_duplicates(frame(spark, TEXTS).limit(0)).count() == 0


def test_minhash_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        w = list(words)
        for j in rng.choice(120, 2, replace=False):
            w[j] = f"n{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    wanted = brute.near(dict(enumerate(texts)), 3, 85)
    got = minhash_dedup.near_duplicates(frame(spark, texts, extra=False), 0.85, 3).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in wanted.items()}


def test_minhash_large_region_is_compared_in_full(spark):
    # All share 220 words, so that unlinked pairs are at 0.846 and fill regions of any depth; pairs with one more word are at 0.853.
    own = [[f"d{k}o{j}" for j in range(20)] for k in range(400)]
    for k in range(60):
        own[k + 200][0] = own[k][0]
    texts = [" ".join([f"c{j}" for j in range(220)] + o) for o in own]
    got = minhash_dedup.near_duplicates(frame(spark, texts, extra=False), 0.85, 1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - 200 if 200 <= k < 260 else k for k in range(400)}


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(600, 700)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (150, 2))] + [(None, 3), (7, 7)]
    up = {}
    for a, b in chain:
        for x in (a, b):
            if x is not None:
                up.setdefault(x, x)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in chain:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    ends = {x for a, b in chain if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in ends}


# ------------------------------------------------------------------ 2
def test_substring_dedup(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op2_substring_dedup(spark, DATA).collect()}
    assert got == brute.repeats(text_of(spark), 35)


def test_substring_edges(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "REGION", 3)  # anchors over the cap take the exact way for the rest
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*TEXTS, *[f"left{k} {passage} right{k} tail{k}" for k in range(12)], " ".join(["a b c d e f g"] * 30)]
    for window in (35, 50):
        got = substring_dedup.remove_repeats(frame(spark, texts), window).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"])) for r in got} == brute.repeats(dict(enumerate(texts)), window)
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert substring_dedup.remove_repeats(frame(spark, texts).limit(0), 35).count() == 0


# ------------------------------------------------------------------ 3
def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(1)
    vocabulary = {"x": [f"x{k}" for k in range(50)], "y": [f"y{k}" for k in range(50)]}
    docs, labels = [], []
    for k in range(400):
        d = "x" if k % 4 else "y"
        docs.append((k, " ".join(rng.choice(vocabulary[d], int(rng.integers(5, 60)))), None, None, None))
        if k < 200:
            labels.append((k, d))
    docs += [(900, None, None, None, None), (901, "", None, None, None)]
    df, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + [(None, "x"), (3, None)], "doc_id long, domain string")
    model = mixing.train(df, lab)
    out = mixing.mix(df, model, {"x": 0.5, "y": 0.5}, total=4000).collect()
    totals = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in out) for d in "xy"}
    assert all(abs(v - 2000) < 20 for v in totals.values()) and all(r["rate"] >= 0 for r in out) and len(out) == 402
    assert sum(r["p_x"] > 0.5 for r in out if r["doc_id"] < 400 and r["doc_id"] % 4) > 285
    # Against a plain projected-gradient solver with the same metric.
    p, n, r = np.array([[o["p_x"], o["p_y"]] for o in out]), np.array([o["n_tokens"] for o in out], float), np.ones(len(out))
    m = (p * n[:, None]).T @ p
    for _ in range(200):
        r = np.maximum(0, r - p @ np.linalg.solve(m, (p * (n * r)[:, None]).sum(0) - 2000))
    assert np.abs((p * (n * r)[:, None]).sum(0) - 2000).max() < 20
    assert mixing.apply(df, mixing.mix(df, model, {"x": 1.0})).columns == df.columns


def test_mixing_scarce_unwanted_text_takes_nothing_away(spark):
    scored = spark.createDataFrame([(100, [0.995, 0.004, 0.001])] * 200 + [(100, [0.1, 0.5, 0.4])], "n_tokens long, p array<double>")
    rate, target, got = mixing.fit_rates(scored, ("good", "plain", "toxic"), queries.MIX, at_most=queries.AT_MOST)
    rates = [r["r"] for r in scored.select(rate.alias("r")).collect()]
    assert all(0.99 < r < 1.01 for r in rates) and abs(got["good"] - 19_910) < 20
    # Much unwanted text is held to its share of the total that the wanted text allows.
    scored = spark.createDataFrame([(100, [0.9, 0.07, 0.03])] * 100 + [(100, [0.1, 0.8, 0.1])] * 100, "n_tokens long, p array<double>")
    _, target, _ = mixing.fit_rates(scored, ("good", "plain", "toxic"), queries.MIX, at_most=queries.AT_MOST)
    assert abs(target["good"] - 10_000) < 1 and abs(target["plain"] - 10_000 * 0.1 / 0.87) < 1


def test_mixing_without_labels(spark):
    df = frame(spark, TEXTS)
    lab = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(df, mixing.train(df, lab), {"x": 1.0}).collect()
    assert len(out) == len(TEXTS) and all(r["rate"] == 1 and r["copies"] == 1 for r in out)
    assert mixing.mix(df.limit(0), mixing.train(df, lab), {"x": 1.0}).count() == 0


def test_mixing_query_reads_all(spark):
    out = queries.op3_mixing(spark, DATA)
    assert out.count() == documents(spark).count()


# ------------------------------------------------------------------ 4
def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    data = [(k, [float(x) for x in centres[k % 30] + rng.normal(size=16) * 0.12], k % 2) for k in range(400)]
    centre = rng.normal(size=16)  # one hot group, larger than a block
    data += [(1000 + k, [float(x) for x in centre + rng.normal(size=16) * 0.05], 7) for k in range(900)]
    nan, inf = float("nan"), float("inf")
    data += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [nan] + [1.0] * 15, 1), (5003, [1.0] * 16, None), (5004, [inf] + [0.0] * 15, 1), (5005, [1e-300] * 16, 1), (5006, [1e300] * 16, 1), (5007, [1.0] * 3, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(3))
    wanted = brute.cosine_links(data, 0.93)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df, 0.93).collect()}
    assert set(got) == set(wanted)
    true, found = sum(n for n, _ in wanted.values()), sum(n for n, _ in got.values())
    assert found >= 0.99 * true and all(got[k][0] <= wanted[k][0] for k in got)
    assert got[5005] == wanted[5005] and got[5007] == (0, 5007)
    assert embedding_dedup.near_vectors(df.limit(0), 0.93).count() == 0


def test_embedding_pivots_of_a_hot_group_are_spread(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    data = [(k, [float(x) for x in centre + rng.normal(size=64) * 0.25], 1) for k in range(700)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 0.93, prefix=3).collect()}
    assert got == brute.cosine_links(data, 0.93)


def test_embedding_query_against_brute_force(spark):
    data = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in queries.table(spark, DATA, "embeddings").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op4_embedding_dedup(spark, DATA).collect()}
    assert got == brute.cosine_links(data, 0.93)


# ------------------------------------------------------------------ 6
def test_warc_query(spark):
    pages = [(r["page_id"], r["html"]) for r in queries.table(spark, DATA, "pages").collect()]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op6_warc(spark, DATA).collect()}
    assert got == brute.warc(pages)


@pytest.mark.parametrize("split", [700, 5000, 8 << 20])
def test_warc_round_trip(spark, split):
    pages = [(k, f"http://x/{k} é", t) for k, t in enumerate([None, "", "abc", "abc", "é" * 5000, "\x1f\x08 WARC/1.1", "x" * 300_000, "abc"])] + [(99, None, "last")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    manifest = warc.write_archives(df, Stage(spark, "t").path("warc"))
    got = warc.read_archives(manifest, split).collect()
    want = brute.warc([(i, t) for i, _, t in pages])
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(pages)
    texts = {i: (t or "").encode() for i, _, t in pages}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in got if r["record_type"] == "response")


def test_warc_false_magic():
    # An archive whose payload holds a stored gzip member: only whole members at member ends count.
    import zlib as z

    import pyarrow as pa

    inner = warc.member(warc.record(7, "u", b"inner", None))
    gz = z.compressobj(0, z.DEFLATED, 31)
    outer = gz.compress(warc.record(1, "u", inner + b"tail", None)) + gz.flush()
    data = outer + warc.member(warc.record(2, "u", b"two", None))
    found = [warc.parse(r)["page_id"] for s in range(0, len(data), 50) for _, r in warc.records_in(pa.BufferReader(data), s, min(s + 50, len(data)))]
    assert found == [1, 2]


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df, Stage(spark, "t").path("warc"))).count() == 0


# ------------------------------------------------------------------ 7
def test_chat_query(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    talks = {-1: [(0, "user", said), (1, "assistant", said)]}
    for r in queries.table(spark, DATA, "conversations").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = queries.op7_chat_format(spark, DATA).collect()
    assert len(got) == len(talks)
    for r in got:
        turns = sorted(talks[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), brute.sha(loss))


def test_chat_escapes_and_edges(spark):
    hard = ["<|im_end|>\n", "<\\|", "<\\\\|im_start|>", "a < | b", "<<||", "\\", "𝄞é<|", "", None, "x" * 200_000]
    data = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, None, None, "n"), (2, 0, "role\nwith \\n", "m"), (2, 0, "role\nwith \\n", "m"), (None, 0, "user", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    made = chat_format.format_conversations(df.withColumn("content", chat_format.text_parts(F.col("text"))))
    out = {r["conv_id"]: r for r in made.select("conv_id", "formatted", "n_turns", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["t"]] == [(r, t or "") for _, _, r, t in data[:10]]
    assert out[1]["loss"] == "".join(t or "" for k, t in enumerate(hard) if k % 2)
    assert [(t["role"], t["text"]) for t in out[2]["t"]] == [("", "n"), ("role\nwith \\n", "m"), ("role\nwith \\n", "m")]
    assert out[None]["n_turns"] == 1 and made.limit(0).count() == 0


def test_chat_typed_parts(spark):
    part = "type string, text string, ref string, n_tokens long"
    content = [("text", "see <|image_1|> ", None, None), ("image", None, "s3://i.png", 100), ("AUDIO", None, "a.wav", None), (None, "end", None, None), ("document", "ignored", "d.pdf", 7)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", [("text", "ok", None, None), ("image", None, "j", None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, content array<struct<{part.replace(' string', ':string').replace(' long', ':long')}>>")
    r = chat_format.format_conversations(df).first()
    assert "see <\\|image_1|> <|image_1|><|audio_2|>end<|document_3|>" in r["formatted"] and "ok<|image_4|>" in r["formatted"]
    assert [(a["number"], a["type"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(1, "image", "s3://i.png", 100), (2, "audio", "a.wav", 750), (3, "document", "d.pdf", 7), (4, "image", "j", 576)]
    assert r["expanded_tokens"] == 1433 and r["n_turns"] == 3
    s = r["loss_spans"][0]
    assert r["formatted"][s["start"] : s["end"]] == "ok<|image_4|>"


# ------------------------------------------------------------------ 8
def check_pii(got, texts):
    for r in got:
        wanted = brute.pii(texts[r["doc_id"]])
        base = [s for s in r["spans"] if s["kind"] != "iban"]
        assert [(s["start"], s["kind"], s["end"]) for s in base] == [(a, k, b) for a, _, k, b in wanted], r["doc_id"]


def test_pii_query(spark):
    texts = text_of(spark)
    check_pii(pii.find(documents(spark)).collect(), texts)
    got = queries.op8_pii(spark, DATA).collect()
    assert all(r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute.pii(texts[r["doc_id"]]))) for r in got)


def test_pii_edges(spark):
    texts = [
        *TEXTS, "a@b.c._x@d.e", "a@b a@b.c@d.e", "x.@-.-", "é a@b.co 𝄞 1.2.3.4 +1 (555) 123-4567", "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.2", "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004", "+1 +12 345 678 90- +123456789012345678",
        "1" * 100_000, "1 " * 60_000, "a" * 100_000 + "@", "a." * 50_000, "a@" * 50_000, "+1" + " " * 50_000, "1." * 50_000, "a@" + "b." * 50_000, "GB82WEST12345698765432 bank", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433",
    ]
    got = pii.find(frame(spark, texts)).collect()
    check_pii(got, dict(enumerate(texts)))
    iban = {r["doc_id"]: [s["kind"] for s in r["spans"]].count("iban") for r in got}
    assert [iban[len(texts) - k] for k in (3, 2, 1)] == [1, 1, 0]
    assert pii.find(frame(spark, TEXTS).limit(0)).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    assert red[len(TEXTS) + 3] == "é [email] 𝄞 [ip] [phone]" and red[7] == BASE


def test_pii_context_raises_the_score(spark):
    got = pii.find(frame(spark, ["my card 4111111111111111", "zz qq 4111111111111111"])).orderBy("doc_id").collect()
    assert got[0]["spans"][0]["score"] > got[1]["spans"][0]["score"]


# ------------------------------------------------------------------ 9
def test_language_id(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op9_language_id(spark, d)
    rows_ = out.join(queries.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows_) == queries.table(spark, d, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows_)
    held = [r for r in rows_ if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    df = frame(spark, [*TEXTS, "123 !!"])
    out = {r["doc_id"]: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (0, 1, 2, len(TEXTS)))
    assert out[3]["lang_pred"] == "en"  # the only language learned
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict(none, language_id.train(none)).collect()} == {"und"}
    assert language_id.keep_identified(df, language_id.train(df)).columns == df.columns
    assert language_id.predict(df.limit(0), language_id.train(df)).count() == 0


# ------------------------------------------------------------------ 10
def check_packing(rows_, texts, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    seqs, pieces = {}, {}
    for r in rows_:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert set(pieces) == set(texts)
    for d, p in pieces.items():
        p.sort()
        assert [k for k, _, _ in p] == list(range(len(p))) and p[0][1] == 0 and sum(n for _, _, n in p) == len(ids[d])
        assert all(n == length for _, _, n in p[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= length
    return len(seqs), sum(len(v) for v in ids.values())


def test_packing_query(spark):
    n, tokens = check_packing(queries.op10_best_fit_packing(spark, DATA).collect(), text_of(spark), 1024)
    assert n <= 1.12 * tokens / 1024 + 2


def test_packing_edges(spark):
    texts = [*TEXTS[:12], "<|endoftext|> it's  12 ", "x" * 5000, "日本語" * 900, "a b " * 600]
    out = packing.pack_documents(frame(spark, texts), queries.tokenizer_path(), 64, open_bins=3)
    check_packing(out.collect(), dict(enumerate(texts)), 64)
    assert packing.pack_documents(frame(spark, texts).limit(0), queries.tokenizer_path(), 64).count() == 0
    whole = packing.sequences(frame(spark, texts, extra=False), queries.tokenizer_path(), 64).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 for r in whole)


def test_packing_ids_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(queries.tokenizer_path()), packing.encoder(queries.tokenizer_path())
    for text in ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext| >", "it's  12 "]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (7, 6, 4, 3, 8)] == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0)]
    bins = packing.Bins(10, 1)
    assert [bins.put(n) for n in (7, 6, 3)] == [(0, 0), (1, 0), (1, 6)]
