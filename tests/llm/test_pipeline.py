"""The pipeline's stages: what each keeps, and its packed result."""

from __future__ import annotations

import collections
import math
import sys
import zlib
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import brute  # noqa: E402
import corpus_pipeline as P  # noqa: E402
from ionlake.llm import mixing, queries  # noqa: E402
from ionlake.llm.shared import Stage  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    stage, docs = Stage(spark, "test"), queries.table(spark, DATA, "documents")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, step) in enumerate(P.STAGES):
        before, docs = docs, stage.keep(step(spark, docs, DATA), f"s{k}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert kept == {d for d, t in texts.items() if any(map(str.isalpha, t or ""))}
        if k == 1:
            last = {}
            for d in sorted(texts):
                if any(map(str.isalpha, texts[d] or "")):
                    last[(texts[d] or "").translate(brute.LOWER)] = d
            assert kept == set(last.values())
        if k == 2:
            left = {d: texts[d] for d in last.values()}
            assert kept == {d for d, (_, c) in brute.near(left, 5, 80).items() if d == c}
        if k == 3:
            check_mix(spark, before, docs)
        if k == 4:
            check_packed(before, docs)
    assert docs.count() and docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def check_mix(spark, before, after):
    """Each document as often as its rate says, rounded up or down, and the tokens of each domain as they are given."""
    model = mixing.train(before, queries.domains(queries.table(spark, DATA, "labels")))
    mixed = mixing.mix(before, model, queries.MIX, at_most=queries.AT_MOST).collect()
    times = collections.Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert set(times) <= {r["doc_id"] for r in mixed}
    for r in mixed:
        assert times[r["doc_id"]] in (math.floor(r["rate"]), math.ceil(r["rate"])), r["doc_id"]
    for name in model.labels:
        reached = sum(r["rate"] * r["n_tokens"] * r[f"p_{name}"] for r in mixed)
        assert abs(reached - mixed[0][f"reached_{name}"]) <= 1e-6 * max(1.0, reached)
    texts = {r["doc_id"]: tuple(r) for r in before.collect()}
    assert all(tuple(r) == texts[r["doc_id"]] for r in after.collect())


def check_packed(before, packed):
    """All ids of all rows, in pieces that fill their sequences without gaps."""
    plain = Tokenizer.from_file(queries.tokenizer_path())
    wanted = collections.Counter()
    for r in before.select("doc_id", "text").collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        starts = ([0] if first else []) + list(range(first, len(ids), 1024))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            wanted[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = packed.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
    total = sum(r["length"] for r in rows)
    assert len(places) <= max(-(-total // 1024) + 5, 1.1 * total / 1024)


def test_run_is_the_last_stage(spark):
    assert P.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_table_passes(spark, tmp_path):
    for name in ("documents", "labels"):
        queries.table(spark, DATA, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
