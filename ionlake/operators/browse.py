"""Filters, sorts, pages and table counts for browsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.operators.ranks import rank_in_group
from ionlake.sources.staging import staged_folder


def keyword_filter(rows: DataFrame, contains: dict[str, str] | None = None, isin: dict[str, list] | None = None) -> DataFrame:
    """Case-insensitive contains, and membership, joined by AND; empty conditions and unknown columns don't filter."""
    parts: list[Column] = []
    for column, text in (contains or {}).items():
        if text and column in rows.columns:
            escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            parts.append(F.col(column).cast("string").ilike(f"%{escaped}%"))
    for column, values in (isin or {}).items():
        if values and column in rows.columns:
            parts.append(F.col(column).isin(*values))
    return rows.filter(reduce(lambda a, b: a & b, parts)) if parts else rows


def sort_keys(rows: DataFrame, sorts: list[tuple[str, str]], tie: str | None = None) -> list[Column]:
    """Ascending with nulls last, descending with nulls first, text without case, the tie column last if it isn't used."""
    kinds = dict(rows.dtypes)
    used = [(c, d) for c, d in sorts if c in kinds]
    if used and tie in kinds and tie not in [c for c, _ in used]:
        used.append((tie, "ascend"))
    out = []
    for c, direction in used:
        key = F.lower(F.col(c)) if kinds[c] == "string" else F.col(c)
        out.append(key.desc_nulls_first() if direction.startswith("desc") else key.asc_nulls_last())
    return out


#: Pages that end within this many rows are the first rows of a sort; later ones are looked for by range.
SHALLOW = 10_000


def page(rows: DataFrame, sorts: list[tuple[str, str]], tie: str, offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    """A page of the sorted rows with the number of all rows.

    The count is an aggregate of its own joined to the page, not a window over the table. A page far down is
    not reached by sorting all rows before it: see ``deep_page``.
    """
    if offset + limit > shallow and sort_keys(rows, sorts, tie):
        return deep_page(rows, sorts, tie, offset, limit, shallow)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    keys = sort_keys(rows, sorts, tie)
    return (rows.orderBy(*keys) if keys else rows).offset(offset).limit(limit).crossJoin(total)


def deep_page(rows: DataFrame, sorts: list[tuple[str, str]], tie: str, offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    """D7 for any offset: rows are written in ranges of the sort keys, whose sizes say which ranges hold the page.

    Only those are read, and cut into ranges again while the page lies deep in them. No task and not the
    driver holds the rows before the page; what is collected is a size for each range.
    """
    spark, total = rows.sparkSession, None
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])
    keys, smaller = sort_keys(rows, sorts, tie), True
    while total is None or (offset + limit > shallow and smaller):
        path = staged_folder(spark, "pages")
        rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        written = spark.read.schema(schema).parquet(path)
        sizes = {r["_range"]: r["n"] for r in written.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
        before, inside, first = 0, [], 0
        for k in sorted(sizes):
            if before < offset + limit and before + sizes[k] > offset:
                first = first if inside else before
                inside.append(k)
            before += sizes[k]
        total, smaller = before if total is None else total, sum(sizes[k] for k in inside) < before
        rows, offset = written.filter(F.col("_range").isin(inside)).drop("_range"), offset - first
    return rows.orderBy(*keys).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def page_by_group(rows: DataFrame, group: str, sort: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """Groups ordered by their smallest (largest) sort value; all rows of a page of groups with the group's place and the number of groups."""
    best = F.max(sort) if descending else F.min(sort)
    groups = rows.groupBy(group).agg(best.alias("_best"))
    order = F.desc_nulls_first("_best") if descending else F.asc_nulls_last("_best")
    chosen = groups.orderBy(order, group).offset(offset).limit(limit)
    placed = chosen.withColumn("group_place", F.row_number().over(Window.orderBy(order, group)) + offset)  # a page of rows only
    return rows.join(placed.drop("_best"), group).crossJoin(groups.agg(F.count(F.lit(1)).alias("n_groups")))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """D10."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def sample_tree(samples: DataFrame) -> DataFrame:
    """Per sample type the labels of its files, in order, as (title, key) nodes and as a list."""
    nodes = F.array_sort(F.collect_list(F.struct(F.col("label").alias("title"), F.col("ms_file_label").alias("key"))))
    return samples.groupBy("sample_type").agg(nodes.alias("nodes")).withColumn("keys", F.col("nodes.key"))


def order_by_list(rows: DataFrame, column: str, order: DataFrame) -> DataFrame:
    """``ord`` of each row's value in ``order`` (label, ord); what isn't listed comes last."""
    return rows.join(order.select(F.col("label").alias("_label"), "ord"), F.col(column) == F.col("_label"), "left").drop("_label").withColumn("ord", F.coalesce(F.col("ord").cast("double"), F.lit(1e9)))


def quota_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 12345) -> DataFrame:
    """Everything if there are at most n rows, else max(1, floor(n * share)) rows of each group by a seeded hash."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).crossJoin(total)
    quota = F.when(F.col("_total") <= n, F.col("_size")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(n) * (F.col("_size") / F.col("_total")))))
    placed = rank_in_group(rows, [group], [F.xxhash64(key, F.lit(seed)), F.col(key)], "_place")
    sizes = sizes.select(F.col(group).alias("_g"), quota.cast("int").alias("_quota"))
    return placed.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).filter("_place <= _quota").drop("_place", "_quota", "_g")


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and number of rows of each table, in the order given."""
    counts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("place"), F.lit(name).alias("table_name"), "n_rows") for k, (name, t) in enumerate(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), counts)


def target_status(targets: DataFrame, chromatograms: DataFrame) -> DataFrame:
    """Targets per type, selected ones and those with a chromatogram."""
    have = chromatograms.select("peak_label").distinct().withColumn("_have", F.lit(True))
    rows = targets.join(have, "peak_label", "left")
    return rows.groupBy("ms_type").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.coalesce("peak_selection", F.lit(False))).alias("n_selected"), F.count_if("_have").alias("n_extracted"))


#: What a data set must have; ``ms2_data`` may be absent.
REQUIRED = {"samples": ["ms_file_label"], "targets": ["peak_label", "mz_mean"], "ms1_data": ["ms_file_label", "scan_id", "mz", "intensity", "scan_time"]}


def validate_dataset(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per required table: found, missing columns, number of rows."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, columns in REQUIRED.items():
        t = tables.get(name)
        missing = ",".join(c for c in columns if t is None or c not in t.columns)
        counted = t.agg(F.count(F.lit(1)).alias("n_rows")) if t is not None else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("table_name"), F.lit(t is not None).alias("found"), F.lit(missing).alias("missing"), "n_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def export_results_long(results: DataFrame, columns: list[str], allowed: list[str]) -> DataFrame:
    """The allowed columns with peak, file and type; arrays as comma lists; in order of type, peak, file."""
    keys = ["peak_label", "ms_file_label", "ms_type"]
    kinds = dict(results.dtypes)
    chosen = [c for c in columns if c in allowed and c in kinds and c not in keys]
    text = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) if kinds[c].startswith("array") else F.col(c) for c in chosen]
    return results.select(*keys, *text).orderBy("ms_type", "peak_label", "ms_file_label")
