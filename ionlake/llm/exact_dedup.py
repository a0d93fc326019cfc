"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by successive byte chunks of their normalised text. One
round groups by (group so far, next chunk); a group with one member is done, a
group whose chunk is shorter than asked for has ended and is a class of equal
texts, and every other group goes to the next round with a longer chunk. Equality
comes from the bytes alone: no digest takes part.

Groups are numbered anew in each round, and a row carries its group's number, so
rows are told apart by their texts and never by their ids.

Counting combines on the map side, so a group holding a third of the corpus is
one row per task in the shuffle; handing the group's number back is an equi-join
that adaptive execution splits. Only documents whose first chunk is another's too
send the rest of their text on; a bitmap of at most ``BITMAP`` bits over hashes of
those chunks, a broadcast of bounded size, leaves the others out, and an exact join follows.

Edge cases: null text is the empty text; empty texts are one class; repeated
rows are members of one class like any others, also where they share an id, and rows
that share an id but not a text are in classes of their own; a null id counts as smaller
than all others, so ``keep_id`` is null only where a class has no other; an empty table gives
an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.llm.shared import Stage, bitmap_of, fresh, in_bitmap, only

#: Bytes that each round looks at; rounds after the last take its length again and again.
CHUNKS = (96, 416, 3584, 28672, 229376, 1835008)
BITMAP = 1 << 26

_UPPER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
_HEAD = "id long, sha256 string, n_bytes long, chunk binary"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(_UPPER)


def _head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, length and first chunk of each normalised text."""
    for batch in batches:
        texts = [normalised(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t[: CHUNKS[0]] for t in texts], pa.binary()),
            ],
            ["id", "sha256", "n_bytes", "chunk"],
        )


def _rest(places: np.ndarray):
    """Id, digest, length, first chunk and what follows it, of texts whose first chunk's place is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in batch.column(1).to_pylist()]
            place = np.fromiter((place_of(t[: CHUNKS[0]]) for t in texts), np.int64, len(texts))
            at = np.flatnonzero(in_bitmap(places, place) & np.fromiter((len(t) >= CHUNKS[0] for t in texts), bool, len(texts)))
            some = [texts[k] for k in at]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in some], pa.string()),
                    pa.array([len(t) for t in some], pa.int64()),
                    pa.array([t[: CHUNKS[0]] for t in some], pa.binary()),
                    pa.array([t[CHUNKS[0] :] for t in some], pa.binary()),
                ],
                ["id", "sha256", "n_bytes", "chunk", "rest"],
            )

    return run


def place_of(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=7).digest(), "big")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([place_of(c) for c in batch.column(0).to_pylist()], pa.int64())], ["place"])


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id (largest id of its class), group_size, kept, sha256, n_bytes.

    ``kept`` holds for the rows of a class that have its ``keep_id``: one row, when ids are unique.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "radix")
    source = only(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    heads = stage.keep(source.mapInArrow(_head, _HEAD), "heads")

    def groups_of(rows: DataFrame, keys: list[str], length: int, name: str) -> DataFrame:
        """Groups of two rows and more with their number, size, largest id and whether their texts end here."""
        sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id")).filter("group_size > 1")
        return stage.keep(sized.withColumn("next", F.monotonically_increasing_id()).withColumn("ended", F.octet_length("chunk") < length), name)

    def done(tagged: DataFrame) -> DataFrame:
        """Rows that are alone or whose class is whole."""
        alone = F.col("next").isNull()
        rows = tagged.filter(alone | F.col("ended"))
        return rows.select("id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha256", "n_bytes")

    groups = groups_of(heads.select("id", "chunk"), ["chunk"], CHUNKS[0], "groups0")
    found = [done(heads.join(groups, "chunk", "left"))]
    open_ = groups.filter("NOT ended").select("chunk", "next")
    places = stage.keep(open_.select("chunk").mapInArrow(_places, "place long"), "places")
    bitmap = bitmap_of(places, BITMAP)
    stage.drop("places")
    rest = source.mapInArrow(_rest(bitmap), _HEAD + ", rest binary")
    rows = stage.keep(rest.join(open_, "chunk").select("id", "sha256", "n_bytes", F.col("next").alias("gid"), "rest"), "open0")
    level = 1
    while not rows.isEmpty():
        length = CHUNKS[min(level, len(CHUNKS) - 1)]
        here = rows.withColumn("chunk", F.substring("rest", 1, length))
        groups = groups_of(here.select("id", "gid", "chunk"), ["gid", "chunk"], length, f"groups{level}")
        after = F.when(~F.col("ended"), F.expr(f"substring(rest, {length + 1})")).alias("rest")
        tagged = here.join(groups, ["gid", "chunk"], "left").select("id", "sha256", "n_bytes", "next", "keep_id", "group_size", "ended", after)
        tagged = stage.keep(tagged, f"round{level}")
        stage.drop(f"open{level - 1}", f"groups{level}")
        found.append(done(tagged))
        rows = tagged.filter("NOT ended").select("id", "sha256", "n_bytes", F.col("next").alias("gid"), "rest")
        level += 1
    return reduce(DataFrame.unionByName, found).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), "sha256", "n_bytes"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns; of rows that share the kept id and the text any one."""
    keys = fresh(docs, "_kept_id", "_kept_null", "_kept_sha")
    named = lambda i, sha: dict(zip(keys, (F.coalesce(i, F.lit(0)).cast("long"), i.isNull(), sha), strict=True))
    kept = exact_classes(docs, id_col, text_col).filter("kept")
    kept = kept.select(*[c.alias(k) for k, c in named(F.col(id_col), F.col("sha256")).items()])
    place = docs.columns.index(text_col)

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([hashlib.sha256(normalised(t)).hexdigest() for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, keys[2]])

    rows = docs.mapInArrow(with_digest, T.StructType([*docs.schema.fields, T.StructField(keys[2], T.StringType())]))
    rows = rows.withColumns({k: c for k, c in named(F.col(f"`{id_col}`"), F.col(keys[2])).items() if k != keys[2]})
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
