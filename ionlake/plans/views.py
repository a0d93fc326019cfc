"""The driver's tables as tables of this library, in Spark and as SQL text for the oracle.

``lineitem`` gives scan points (a supplier is a file, a week a scan, the price an m/z),
``part`` gives one target per size, ``supplier`` the samples, ``events`` the traces.
All rows take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators.traces import ordered_lists

SQL = {
    "points": """
        SELECT 'S' || l_suppkey AS ms_file_label, scan_id, 7.0::DOUBLE * scan_id AS scan_time, l_extendedprice AS mz, l_quantity AS intensity, l_returnflag || l_linestatus AS filterLine
        FROM (SELECT *, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS scan_id FROM lineitem)
    """,
    "targets": """
        SELECT 'P' || p_size AS peak_label, 2000.0::DOUBLE * p_size AS mz_mean, 20000.0::DOUBLE AS mz_width, 20.0::DOUBLE * p_size + 200 AS rt, 20.0::DOUBLE * p_size AS rt_min,
               20.0::DOUBLE * p_size + 400 AS rt_max, 's' AS rt_unit, (p_size % 7 + 1)::DOUBLE AS intensity_threshold, 'ms1' AS ms_type, CAST(NULL AS VARCHAR) AS filterLine,
               p_size % 3 <> 0 AS peak_selection, p_size % 4 = 0 AS bookmark, min(p_brand) AS category, max(p_retailprice) AS score
        FROM part GROUP BY p_size
    """,
    "targets2": """
        SELECT 'F' || l_returnflag || l_linestatus AS peak_label, 1000.0::DOUBLE AS mz_mean, 10.0::DOUBLE AS mz_width, 700.0::DOUBLE AS rt, 600.0::DOUBLE AS rt_min, 800.0::DOUBLE AS rt_max, 's' AS rt_unit,
               1.0::DOUBLE AS intensity_threshold, 'ms2' AS ms_type, l_returnflag || l_linestatus AS filterLine, true AS peak_selection, false AS bookmark, 'x' AS category, count(*)::DOUBLE AS score
        FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
    "samples": """
        SELECT 'S' || s_suppkey AS ms_file_label, s_name AS label, n_name AS sample_type, '#' || lpad(CAST(n_regionkey * 111111 AS VARCHAR), 6, '0') AS color, s_suppkey % 3 <> 0 AS use_for_optimization,
               s_suppkey % 7 <> 0 AS use_for_processing, true AS use_for_analysis, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '' ELSE 'g' || (s_suppkey % 3) END AS group_1,
               CASE WHEN s_suppkey % 11 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((s_suppkey * 37) % 1000 AS INTEGER)) END AS acquisition_datetime
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
    "trace_points": """
        SELECT event_type AS peak_label, 'U' || user_id AS ms_file_label, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS scan_time, value AS intensity, event_id FROM events
    """,
    "traces": """
        SELECT peak_label, ms_file_label, list(scan_time ORDER BY scan_time, event_id) AS scan_time, list(intensity ORDER BY scan_time, event_id) AS intensity
        FROM trace_points GROUP BY peak_label, ms_file_label
    """,
    "trace_targets": """
        SELECT event_type AS peak_label, 500000.0::DOUBLE AS rt_min, 1800000.0::DOUBLE AS rt_max, length(event_type)::DOUBLE AS intensity_threshold, 'ms1' AS ms_type FROM events GROUP BY event_type
    """,
    "users": """
        SELECT 'U' || user_id AS ms_file_label, 'T' || (user_id % 4) AS sample_type, '#00000' || (user_id % 2) AS color, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '' ELSE 'g' || (user_id % 3) END AS group_1,
               min(ts) AS acquisition_datetime, user_id % 7 <> 0 AS use_for_processing
        FROM events GROUP BY user_id
    """,
    "long_results": """
        SELECT peak_label, ms_file_label, count(*) AS n, sum(intensity) AS v, max(intensity) AS m FROM trace_points GROUP BY peak_label, ms_file_label
    """,
}
_NEEDS = {"traces": ["trace_points"], "long_results": ["trace_points"]}


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views in front of it, those they need first."""
    order: list[str] = []
    for name in names:
        for x in [*_NEEDS.get(name, []), name]:
            if x not in order:
                order.append(x)
    heads = ", ".join(f"{name} AS ({SQL[name]})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = F.floor(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) / 7).cast("int")
    rows = table(spark, sf_dir, "lineitem").withColumn("scan_id", scan)
    return rows.select(
        F.concat(F.lit("S"), "l_suppkey").alias("ms_file_label"), "scan_id", (F.lit(7.0) * F.col("scan_id")).alias("scan_time"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), F.concat("l_returnflag", "l_linestatus").alias("filterLine")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.min("p_brand").alias("category"), F.max("p_retailprice").alias("score"))
    return rows.select(
        F.concat(F.lit("P"), size).alias("peak_label"), (size * 2000.0).alias("mz_mean"), F.lit(20000.0).alias("mz_width"), (size * 20.0 + 200).alias("rt"), (size * 20.0).alias("rt_min"), (size * 20.0 + 400).alias("rt_max"),
        F.lit("s").alias("rt_unit"), (size % 7 + 1).cast("double").alias("intensity_threshold"), F.lit("ms1").alias("ms_type"), F.lit(None).cast("string").alias("filterLine"), (size % 3 != 0).alias("peak_selection"), (size % 4 == 0).alias("bookmark"), "category", "score",
    )


def targets2(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").groupBy(line.alias("filterLine")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return rows.select(
        F.concat(F.lit("F"), "filterLine").alias("peak_label"), F.lit(1000.0).alias("mz_mean"), F.lit(10.0).alias("mz_width"), F.lit(700.0).alias("rt"), F.lit(600.0).alias("rt_min"), F.lit(800.0).alias("rt_max"), F.lit("s").alias("rt_unit"),
        F.lit(1.0).alias("intensity_threshold"), F.lit("ms2").alias("ms_type"), "filterLine", F.lit(True).alias("peak_selection"), F.lit(False).alias("bookmark"), F.lit("x").alias("category"), "score",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    when = F.when(key % 11 != 0, start + F.make_interval(hours=(key * 37 % 1000).cast("int")))
    return rows.select(
        F.concat(F.lit("S"), key).alias("ms_file_label"), F.col("s_name").alias("label"), F.col("n_name").alias("sample_type"), F.concat(F.lit("#"), F.lpad((F.col("n_regionkey") * 111111).cast("string"), 6, "0")).alias("color"),
        (key % 3 != 0).alias("use_for_optimization"), (key % 7 != 0).alias("use_for_processing"), F.lit(True).alias("use_for_analysis"),
        F.when(key % 5 == 0, None).when(key % 5 == 1, "").otherwise(F.concat(F.lit("g"), key % 3)).alias("group_1"), when.alias("acquisition_datetime"),
    )


def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("peak_label"), F.concat(F.lit("U"), "user_id").alias("ms_file_label"), seconds.alias("scan_time"), F.col("value").alias("intensity"), "event_id")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_lists(trace_points(spark, sf_dir), ["peak_label", "ms_file_label"], ["scan_time", "event_id"], ["scan_time", "intensity"])


def trace_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select(F.col("event_type").alias("peak_label"), F.lit(500000.0).alias("rt_min"), F.lit(1800000.0).alias("rt_max"), F.length("event_type").cast("double").alias("intensity_threshold"), F.lit("ms1").alias("ms_type"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("acquisition_datetime"))
    group = F.when(key % 5 == 0, None).when(key % 5 == 1, "").otherwise(F.concat(F.lit("g"), key % 3))
    return rows.select(F.concat(F.lit("U"), key).alias("ms_file_label"), F.concat(F.lit("T"), key % 4).alias("sample_type"), F.concat(F.lit("#00000"), key % 2).alias("color"), group.alias("group_1"), "acquisition_datetime", (key % 7 != 0).alias("use_for_processing"))


def long_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample-by-target matrix in long form: n, v, m for every file and peak."""
    return trace_points(spark, sf_dir).groupBy("peak_label", "ms_file_label").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("v"), F.max("intensity").alias("m"))
