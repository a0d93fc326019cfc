"""Exact quantiles of groups of any size, from places in range partitions.

An aggregate such as ``percentile`` holds every distinct value of a group in one task. Here all rows are
ranged by group and value; only the two rows beside each wanted place of a group are looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.operators.ranks import global_rank


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and, for each name in ``shares``, the quantile with linear interpolation; nulls are left out, a null key is a group."""
    known = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    placed = global_rank(known, [*[F.col(k).asc_nulls_first() for k in keys], F.col("_v")], "_place")
    groups = placed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = placed.join(groups, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).withColumn("_own", F.col("_place") - F.col("_first"))
    wanted = {name: (F.col("_n") - 1) * F.lit(share) for name, share in shares.items()}
    near = [F.col("_own").isin(F.floor(h), F.ceil(h)) for h in wanted.values()]
    beside = found.filter(F.array_contains(F.array(*near), True))
    ends = [F.max(F.when(F.col("_own") == side(h), F.col("_v"))).alias(f"_{name}_{end}") for name, h in wanted.items() for end, side in (("lo", F.floor), ("hi", F.ceil))]
    out = beside.groupBy(*keys).agg(F.first("_n").alias("_n"), *ends)
    return out.select(*keys, *[(F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (h - F.floor(h))).alias(name) for name, h in wanted.items()])
