"""Near-duplicate vectors by a pivot-permutation index.

1. Pivots (reference points) are a bounded sample of the vectors of each length; their number grows
   with the square root of the table up to ``most_pivots`` and ``PIVOT_BYTES``, so the broadcast is
   bounded. Those near another are left out, so that a dense group has few pivots, which all its
   vectors share, and not more than fit in a prefix.
2. Every vector is described by its ``PREFIX`` nearest pivots in order (its permutation prefix)
   and posted in the inverted list of each of them, within its label and length.
3. Two vectors are compared if they share ``SHARED`` pivots and the order agrees: each shared
   pivot scores the product of its two places counted from the prefix's end, and the sum must
   reach ``ORDER``. They meet in one list only, that of the first pivot both prefixes have. Cosines in
   double precision decide. Lists are compared as matrices: a task gives counts and links, never pairs.
4. A list of more than ``LIST`` rows is dealt anew by the second shared pivot, so lists stay
   short as the table grows: no pair is lost, as two must be shared. What is still larger than
   ``BLOCK`` rows is cut into blocks by a hash, and block pairs are dealt to tasks, so no
   list is gathered in one place and none is capped. Only a group whose vectors all have the
   same nearest pivots is compared pair by pair; its links, which are counted, are as many.
   A block pair gives each of its vectors a number of links and one link to the smallest vector of
   its part of the block pair's own link graph, which is all that components need.
5. Counts are added up and the links make components.

Edge cases: a vector that is null, empty or zero, or that holds a null or non-finite number, or
has a null label, links with nothing; vectors of different lengths don't link; equal vectors
link; of equally near pivots the one drawn first comes first; every row is a vector of its own, so
repeated rows of one id link with each other like any equal vectors; rows without an id are left
out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.components import components
from ionlake.llm.shared import Stage, only

#: Pivots of a prefix, pivots and score of their order that two vectors must share.
PREFIX, SHARED, ORDER = 10, 2, 30
#: Rows of a list beyond which it is dealt by a second pivot, and rows of a block.
LIST, BLOCK = 8192, 384
PIVOT_BYTES = 32 << 20


def usable(column: str) -> F.Column:
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled first so that very large and small numbers keep their direction."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def spread_out(pivots: np.ndarray, cosine: float) -> np.ndarray:
    """The pivots, in order, that are farther from each one before than twice the angle of ``cosine`` (60 degrees at most)."""
    most = max(0.5, 2 * cosine * cosine - 1)
    kept, n = np.zeros_like(pivots), 0
    for a in range(0, len(pivots), 256):
        part = pivots[a : a + 256]
        ok = (part @ kept[:n].T).max(axis=1, initial=-1.0) < most
        inside, mine = part @ part.T, np.zeros(len(part), bool)
        for k in np.flatnonzero(ok):
            mine[k] = inside[k, mine].max(initial=-1.0) < most
        kept[n : n + mine.sum()] = part[mine]
        n += int(mine.sum())
    return kept[:n]


def _describe(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector")).to_numpy()
            for size in np.unique(sizes):
                some = batch.take(pa.array(np.flatnonzero(sizes == size)))
                near = unit(matrix(some.column("vector"))) @ pivots[int(size)].T
                top = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int32)
                k = top.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, k), pa.int32()), pa.array(top.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), some.column("vector"), lists], ["id", "label", "vector", "nearest"])

    return run


def _compare(cosine: float, shared: int, order: int):
    """Counts and spanning links of one block pair of one list (of one pivot, or of two)."""
    schema = pa.schema([("vertex", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        pivot, second = table.column("pivot")[0].as_py(), table.column("second")[0].as_py()
        left = np.flatnonzero(table.column("left").to_numpy())
        right = np.flatnonzero(table.column("right").to_numpy())
        vertex = table.column("vertex").to_numpy()
        vectors = unit(matrix(table.column("vector")))
        nearest = matrix(table.column("nearest")).astype(np.int64)
        here, column = np.unique(nearest, return_inverse=True)
        column = column.reshape(nearest.shape)
        place = np.zeros((len(vertex), len(here)), np.float32)
        np.put_along_axis(place, column, np.broadcast_to(np.arange(PREFIX, PREFIX - nearest.shape[1], -1, dtype=np.float32), nearest.shape), axis=1)
        has = (place > 0).astype(np.float32)
        needed = min(shared, nearest.shape[1])
        link = (has[left] @ has[right].T >= needed) & (place[left] @ place[right].T >= order)
        # The list is the pair's own if it is of the first pivot (or first two) that both have.
        before = here < (pivot if second < 0 else second)
        link &= (has[left][:, before] @ has[right][:, before].T) == (0 if second < 0 else 1)
        link &= vertex[left][:, None] != vertex[right][None, :]
        link &= vectors[left] @ vectors[right].T >= cosine
        same = len(left) == len(vertex) and len(right) == len(vertex)
        count = np.zeros(len(vertex), np.int64)
        count[left] += link.sum(axis=1)
        if not same:
            count[right] += link.sum(axis=0)
        root = vertex.copy()  # smallest vertex reached inside this block pair
        big = np.iinfo(np.int64).max
        while link.any():
            was = root.copy()
            np.minimum.at(root, left, np.where(link, root[right][None, :], big).min(axis=1, initial=big))
            np.minimum.at(root, right, np.where(link, root[left][:, None], big).min(axis=0, initial=big))
            if (root == was).all():
                break
        found = count > 0
        return pa.table([pa.array(vertex[found]), pa.array(root[found]), pa.array(count[found])], schema=schema)

    return run


def _pivots(good: DataFrame, cosine: float, most_pivots: int, seed: int) -> dict[int, np.ndarray]:
    """Pivots of each length of vector."""
    out = {}
    for r in good.groupBy(F.size("vector").alias("size")).count().collect():
        size, n = r["size"], r["count"]
        wanted = max(1, min(most_pivots, max(16, math.isqrt(n)), PIVOT_BYTES // (8 * size)))
        sample = good.filter(F.size("vector") == size).select("vector").orderBy(F.xxhash64("id", F.lit(seed))).limit(wanted).collect()
        out[size] = spread_out(unit(np.array([x["vector"] for x in sample], np.float64)), cosine)
    return out


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", prefix: int = PREFIX, shared: int = SHARED, order: int = ORDER, most_pivots: int = 16384, seed: int = 7
) -> DataFrame:
    """Per row: id, n_links (other vectors of its label at ``cosine`` or more), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    stage = Stage(spark, "pivots")
    rows = only(vectors, id_col, vector_col, label_col).toDF("id", "vector", "label").filter("id IS NOT NULL").withColumn("id", F.col("id").cast("long"))
    whole = F.col("label").isNotNull() & usable("vector")
    kind = rows.schema["vector"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    good = rows.filter(whole).select("id", F.col("label").cast("string").alias("label"), F.col("vector").cast(kind).alias("vector"))
    alone = rows.filter(~F.coalesce(whole, F.lit(False))).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = _pivots(good, cosine, most_pivots, seed)
    if not pivots:
        return alone
    described = good.mapInArrow(_describe(pivots, prefix), f"id long, label string, vector {kind}, nearest array<int>").withColumn("vertex", F.monotonically_increasing_id())
    described = stage.keep(described.withColumn("size", F.size("vector")), "described")

    lists = described.select("label", "size", "vertex", "nearest", F.explode("nearest").alias("pivot"))
    large = lists.groupBy("label", "size", "pivot").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") > LIST)
    plain = large.filter("NOT large").select("label", "size", "pivot", F.lit(-1).alias("second"), "n")
    again = lists.join(large.filter("large").select("label", "size", "pivot"), ["label", "size", "pivot"])
    again_rows = again.select("label", "size", "pivot", "vertex", F.explode(F.filter("nearest", lambda q: q > F.col("pivot"))).alias("second"))
    wanted = plain.unionByName(again_rows.groupBy("label", "size", "pivot", "second").agg(F.count(F.lit(1)).alias("n"))).filter("n > 1")
    wanted = stage.keep(wanted.select("label", "size", "pivot", "second", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "lists")
    single = lists.join(wanted.filter("second < 0"), ["label", "size", "pivot"])
    double = again_rows.join(wanted.filter("second >= 0"), ["label", "size", "pivot", "second"])
    posted = single.select("label", "size", "pivot", "second", "vertex", "blocks").unionByName(double.select("label", "size", "pivot", "second", "vertex", "blocks"))
    mine = F.pmod(F.xxhash64("vertex", F.lit(seed)), F.col("blocks"))
    posted = posted.withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("theirs"))
    posted = posted.select(
        "label", "size", "pivot", "second", F.least("mine", "theirs").alias("x"), F.greatest("mine", "theirs").alias("y"), "vertex", (F.col("mine") <= F.col("theirs")).alias("left"), (F.col("mine") >= F.col("theirs")).alias("right")
    )
    posted = posted.hint("shuffle_merge").join(described.select("vertex", "vector", "nearest"), "vertex")
    compared = posted.groupBy("label", "size", "pivot", "second", "x", "y").applyInArrow(_compare(cosine, shared, order), "vertex long, other long, n long")
    compared = stage.keep(compared, "compared")
    counts = compared.groupBy("vertex").agg(F.sum("n").alias("n_links"))
    linked = Stage(spark, "pivots-components")
    found = components(compared.select(F.col("vertex").alias("a"), F.col("other").alias("b")), linked)
    named = described.select("vertex", "id").join(counts, "vertex", "left").join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    named = stage.keep(named, "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    linked.clear()
    stage.drop("described", "lists", "compared")
    out = named.join(least, "component").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
