"""Line dedup, periodic runs and importance resampling against brute force, with edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

import brute  # noqa: E402
from oracle import DATA  # noqa: E402
from test_llm import LONG, TEXTS, frame  # noqa: E402

from ionlake.llm import importance, line_dedup, periodic_runs, queries  # noqa: E402

ROWS = "doc_id long, text string, h1 string, group int, id string"

# ------------------------------------------------------------------ 11
SHARED = "  A line of more than twenty signs \t"
LINES = [
    (1, None), (2, ""), (3, "\n\n"), (4, SHARED), (5, f"own {SHARED}\n{SHARED.upper()}\n{SHARED.strip()}\nend"), (6, f"x\n{SHARED}\nx"), (6, f"{SHARED}\ny"), (3, f"{SHARED}\nz\n"),
    (None, f"{SHARED}\nnull id"), (None, "only null ids hold this line\n1"), (None, "only null ids hold this line\n2"), (None, "only null ids hold this line\n3"),
    (20, "äöüäöüäöüäöüäöüäöüäö\n1"), (21, "äöüäöüäöüäöüäöüäöüäö\n2"), (22, "ÄÖÜäöüäöüäöüäöüäöüäö\n3"), (23, "äöüäöüäöüäöüäöüäöüäö\n\x0b"), (24, "äöüäöüäöüäöüäöüäöüä\n1"), (25, "äöüäöüäöüäöüäöüäöüä\n2"), (26, "äöüäöüäöüäöüäöüäöüä"),
    (30, "twice in one document only\ntwice in one document only\ntwice in one document only"), (31, "twice in one document only"), (32, LONG), (33, LONG + "\n" + SHARED), (34, "same row\nof lines that are long enough"), (34, "same row\nof lines that are long enough"),
    (35, "of lines that are long enough "), (36, "\x1fof lines that are long enough"), (33, LONG),
]


def line_rows(spark, rows=LINES):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], ROWS)


@pytest.mark.parametrize("sizes", [{}, {"group_keys": 2, "shard_keys": 1}, {"group_keys": 1, "shard_keys": 1}])
def test_lines(spark, sizes):
    got = line_dedup.drop_lines(line_rows(spark), 20, 3, **sizes).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute.lines(LINES, 20, 3), key=key)
    assert line_dedup.drop_lines(line_rows(spark).limit(0), 20, 3, **sizes).count() == 0


def test_lines_of_the_table_in_many_groups(spark):
    docs = queries.table(spark, DATA, "documents")
    one = {r["doc_id"]: r for r in line_dedup.drop_lines(docs, 10, 2).collect()}
    many = {r["doc_id"]: r for r in line_dedup.drop_lines(docs.repartition(5), 10, 2, group_keys=100, shard_keys=7).collect()}
    assert one == many
    wanted = brute.lines([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 10, 2)
    assert sorted(tuple(r) for r in one.values()) == sorted(wanted)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 70_000):
        h1, h2 = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        h1[: n // 2] = 7  # halves that are equal
        sizes, bits, slot = line_dedup.perfect_hash(h1, h2)
        assert sorted(slot.tolist()) == list(range(n))
        assert sum(sizes) == len(bits)
        assert n < 1000 or 64 * len(bits) < 5 * n


# ------------------------------------------------------------------ 12
def runs_of(docs, least):
    texts = [" ".join(d).encode() for d in docs]
    _, counts, start, length, period, collapsed = periodic_runs._answer(texts, least)
    found = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    at = np.cumsum([0, *counts])
    return [(found[a:b], c) for a, b, c in zip(at[:-1], at[1:], collapsed, strict=True)]


def brute_runs(d, least):
    found = brute.runs(d, least)
    return found, brute.collapsed(d, found)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_all_short_texts(least):
    for n in range(13):
        docs = [list(x) for x in itertools.product("ab", repeat=n)]
        assert runs_of(docs, least) == [brute_runs(d, least) for d in docs]


def test_runs_of_periodic_texts():
    rng = np.random.default_rng(9)
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    for _ in range(60):
        docs = [b]
        for _ in range(8):
            d: list = []
            while len(d) < 120:
                root = rng.choice(list("abcd")[: int(rng.integers(1, 5))], int(rng.integers(1, 25))).tolist()
                d += (root * 6)[: int(len(root) * rng.uniform(0.5, 5))]
            docs.append(d)
        assert runs_of(docs, 2) == [brute_runs(d, 2) for d in docs]


def test_runs_edges(spark):
    texts = [*TEXTS, "ab " * 50_000, "\x0b\x0c" + "x y\r\nx\ty " * 40 + "\x1fx y x", "no run here", " ".join(f"w{k}" for k in range(5)) + " z" * 12, "é è " * 6]
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(frame(spark, texts), 12).collect()}
    for k, t in enumerate(texts):
        w = brute.WORD.findall(t or "")
        assert got[k]["n_words"] == len(w)
        if len(w) < 5000:
            found, collapsed = brute_runs(w, 12)
            assert [tuple(r) for r in got[k]["runs"]] == found
            assert got[k]["collapsed_text"] == collapsed
    big = got[len(TEXTS)]
    assert [tuple(r) for r in big["runs"]] == [(0, 50_000, 1)] and big["collapsed_text"] == "ab"
    assert periodic_runs.find_runs(frame(spark, texts).limit(0)).count() == 0


def test_runs_query(spark):
    wanted = {}
    for r in queries.table(spark, DATA, "documents").select("doc_id", "text").collect():
        w, h = brute.WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found, collapsed = brute_runs(w, 12)
        start, length, period = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        wanted[r["doc_id"]] = (len(found), start, length, period, length and 1000 * length // period, brute.sha(lines), brute.sha(collapsed))
    got = queries.op12_periodic_runs(spark, DATA)
    assert [t for c, t in got.dtypes if not c.endswith("256")] == ["bigint"] * 6
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == wanted
    assert any(v[0] for v in wanted.values())


def test_planted_runs_edges(spark):
    docs = spark.createDataFrame([(k, t) for k in (None, *range(200)) for t in (None, "", " ", "one", " two  words ")], "doc_id long, text string")
    for r in queries.with_planted_runs(docs).collect():
        assert r["text"] is None or brute.WORD.findall(r["text"]) in ([], ["one"], ["two", "words"], ["two", "two"], ["words", "words"])


# ------------------------------------------------------------------ 13
SPELLED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_draw(docs, target, percent, least_words, seed, buckets):
    def features(t):
        w = SPELLED.findall((t or "").translate(brute.LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (s_all + buckets)) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[5] = k + 1
    return rows


def test_crcs_in_matrices():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    start = rng.integers(0, 10_000, 3000)
    length = np.concatenate([rng.integers(1, 40, 2990), rng.integers(4000, 9000, 10)])
    assert importance.crc_of_spans(data, start, length).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(start, length, strict=True)]
    assert importance.crc_of_spans(data, start[:0], length[:0]).tolist() == []


def test_draw_edges(spark, monkeypatch):
    monkeypatch.setattr(importance, "LONG_BYTES", 64)
    texts = [*TEXTS, "a b", "ÄB c-d'e 12", "\x00\x7f", *[f"common words of text {k % 7} and {k % 3}" for k in range(60)]]
    target = ["common words of text 5 and 2", None, "", "Common other", LONG[:500]]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((30, 3), (5, 20), (100, 0)):
        got = importance.resample(frame(spark, texts), goal, percent, least, 7, 97).collect()
        assert sorted(list(r) for r in got) == sorted(brute_draw(list(enumerate(texts)), target, percent, least, 7, 97))
    assert importance.resample(frame(spark, texts).limit(0), goal).count() == 0
    alone = importance.resample(frame(spark, texts), goal.limit(0), 30, 3, 7, 97).collect()
    assert sorted(list(r) for r in alone) == sorted(brute_draw(list(enumerate(texts)), [], 30, 3, 7, 97))


def test_draw_with_shared_and_null_ids(spark):
    rows = [(None, "one two three"), (None, "one two three"), (5, "one two three"), (5, "one two three"), (5, "four five six"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id_text", F.lit("clash")).withColumn("place", F.lit(1))
    goal = spark.createDataFrame([("one two",)], "text string")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((list(r) for r in importance.resample(docs, goal, 80, 2, 42, 50).collect()), key=key)
    assert got == sorted(brute_draw(rows, ["one two"], 80, 2, 42, 50), key=key)
