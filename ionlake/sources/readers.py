"""Readers and writers of point tables, target lists and results (section A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "ms_file_label string, scan_id int, mz double, intensity double, scan_time double"
POINTS2 = POINTS + ", mz_precursor double, filterLine string, filterLine_ELMAVEN string"

GROUP = "struct<meanMz:double,meanRt:double,rtmin:double,rtmax:double,label:string,compound:struct<compoundId:string,compoundName:string,formula:string,expectedRt:double,expectedMz:double,adductName:string,tagString:string>>"


def read_points(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """A1: points written as Parquet, one or many files; the schema is given, so no file is opened to find it."""
    return spark.read.schema(POINTS2 if level == 2 else POINTS).parquet(path)


def write_points(points: DataFrame, path: str) -> None:
    """Points in order of file and scan, in ranges of equal load: a query on some files reads only row groups that may hold them.

    There is no folder a file, as files may be hundreds of thousands.
    """
    order = ["ms_file_label", "scan_id"]
    points.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV, TSV, TXT (tabs if its first line has one, else commas) and JSON by suffix; all columns are text without a schema."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return read_feature_groups_json(spark, path)
    if suffix not in ("csv", "tsv", "txt"):
        raise ValueError(f"unsupported table format: .{suffix}")
    sep = "\t" if suffix == "tsv" else ","
    if suffix == "txt":
        first = spark.read.text(path).first()
        sep = "\t" if first is not None and "\t" in first[0] else ","
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def in_source_order(rows: DataFrame) -> DataFrame:
    """``source_order`` for rows just read from files: by file, split and row, however the files are split."""
    return rows.withColumn("source_order", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("row")))


def read_feature_groups_json(spark: SparkSession, path: str) -> DataFrame:
    """An object with groups as one row a group, a list of records, or one record."""
    plain = spark.read.option("multiLine", True).json(path)
    kinds = dict(plain.dtypes)
    if not kinds.get("groups", "").startswith("array"):
        return plain
    typed = spark.read.schema(f"groups array<{GROUP}>").option("multiLine", True).json(path)
    rows = typed.select(F.explode("groups").alias("g"))
    empty = lambda c: F.nullif(c, F.lit(""))
    c = F.col("g.compound")
    return rows.select(
        F.coalesce(empty(c["compoundName"]), empty(c["compoundId"]), F.col("g.label")).alias("compound"), c["compoundId"].alias("compoundId"), c["compoundName"].alias("compoundName"), c["formula"].alias("formula"),
        F.col("g.meanMz").alias("meanMz"), F.col("g.meanRt").alias("meanRt"), F.col("g.rtmin").alias("rtmin"), F.col("g.rtmax").alias("rtmax"),
        c["expectedRt"].alias("expectedRt"), c["expectedMz"].alias("expectedMz"), c["adductName"].alias("adductName"), c["tagString"].alias("tagString"),
    )


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A header in every part file; rows in order if asked for."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def export_targets(targets: DataFrame, path: str) -> None:
    """Targets in order of m/z, then label."""
    write_csv(targets, path, ["mz_mean", "peak_label"])


#: What a dense matrix may be made of.
MATRIX_ROWS, MATRIX_COLUMNS = {"ms_file_label", "peak_label"}, {"peak_label", "ms_file_label"}
MATRIX_VALUES = {"peak_area", "peak_area_top3", "peak_max", "peak_mean", "peak_median", "peak_n_datapoints", "peak_rt_of_max", "total_intensity", "peak_area_fitted"}


def dense_matrix(results: DataFrame, row: str, column: str, value: str, labels: list[str]) -> DataFrame:
    """A pivot of allowed names; ``labels`` are the columns."""
    if row not in MATRIX_ROWS or column not in MATRIX_COLUMNS or value not in MATRIX_VALUES or row == column:
        raise ValueError("not an allowed matrix")
    return results.groupBy(row).pivot(column, labels).agg(F.first(value))
