"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ionlake.sources.staging import staged


def global_rank(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``name`` is each row's place (from 1) in the order of ``keys``, which should have no ties.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and the
    partitions' sizes, one number each, say where its numbers start.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = rows.columns
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * k, pa.int32()), pa.array(range(at + 1, at + k + 1), pa.int64())], [*columns, "_part", "_own"])
            at += k

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_own", T.LongType())])
    numbered = staged(dealt.mapInArrow(number, schema), "ranks")  # once: range bounds are sampled
    sizes = numbered.groupBy("_part").agg(F.max("_own").alias("_size")).select(F.col("_part").alias("_other"), "_size")  # a row a partition
    earlier = Window.orderBy("_other").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    before = sizes.select("_other", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return numbered.join(before, F.col("_part") == F.col("_other")).withColumn(name, F.col("_own") + F.col("_before")).select(*columns, name)


def rank_in_group(rows: DataFrame, groups: list[str], keys: list[Column], name: str) -> DataFrame:
    """``name`` is each row's place (from 1) among the rows of its group, a null being a group; a group may span partitions.

    The place in the whole table less that of the group's first row, so no window gathers a group.
    """
    placed = global_rank(rows, [*[F.col(g).asc_nulls_first() for g in groups], *keys], "_place")
    first = placed.groupBy(*[F.col(g).alias(f"_of_{g}") for g in groups]).agg(F.min("_place").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]
    return placed.join(first, same).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).select(*rows.columns, name)
