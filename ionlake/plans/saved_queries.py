"""Changes to saved tables (A10 to A15): each query saves tables, changes them, and reads them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.plans import views as V
from ionlake.plans.base import ORACLE, query
from ionlake.sources.staging import shared_folder
from ionlake.sources.tables import SavedTable, delete_everywhere


def _saved(spark: SparkSession, rows: DataFrame, by: str, parts: int = 8) -> SavedTable:
    return SavedTable(spark, f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}").create(rows, by, parts)


@query("a10_saved_samples", ORACLE["a10_update_samples"])
def a10(spark: SparkSession, d: str) -> DataFrame:
    old = V.samples(spark, d)
    table = _saved(spark, old, "ms_file_label")
    table.update(old.filter("use_for_processing").select("ms_file_label", F.lit("new").alias("sample_type"), F.lit(None).cast("string").alias("color")), "ms_file_label", ["sample_type", "color"])
    return table.read().select("ms_file_label", "sample_type", "color")


@query("a11_saved_targets", ORACLE["a11_upsert_targets"])
def a11(spark: SparkSession, d: str) -> DataFrame:
    old = V.targets(spark, d).select("peak_label", "score", "bookmark")
    table = _saved(spark, old, "peak_label")
    table.upsert(old.filter("bookmark").withColumn("score", F.lit(-1.0)), ["peak_label"])
    return table.read().select("peak_label", "score")


@query("a12_saved_chromatograms", ORACLE["a12_upsert_chromatograms"])
def a12(spark: SparkSession, d: str) -> DataFrame:
    old = V.traces(spark, d).select("peak_label", "ms_file_label", "scan_time", "intensity")
    used = V.users(spark, d).filter("use_for_processing").select("ms_file_label")
    empty = F.array().cast("array<double>")
    table = _saved(spark, old, "ms_file_label")
    table.upsert(old.join(used, "ms_file_label", "left_semi").select("peak_label", "ms_file_label", empty.alias("scan_time"), empty.alias("intensity")), ["peak_label", "ms_file_label"])
    return table.read().select("peak_label", "ms_file_label", F.size("intensity").cast("long").alias("n"))


@query("a13_saved_files", ORACLE["a13_delete_files"])
def a13(spark: SparkSession, d: str) -> DataFrame:
    tables = {"points": _saved(spark, V.points(spark, d), "ms_file_label"), "samples": _saved(spark, V.samples(spark, d), "ms_file_label")}
    delete_everywhere(tables, V.samples(spark, d).filter("NOT use_for_processing"), ["ms_file_label"])
    counts = [t.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return counts[0].unionByName(counts[1])


@query("a14_saved_results", ORACLE["a14_delete_targets"])
def a14(spark: SparkSession, d: str) -> DataFrame:
    table = _saved(spark, V.long_results(spark, d), "ms_file_label")
    table.delete(V.trace_targets(spark, d).filter("intensity_threshold > 5"), ["peak_label"])
    return table.read().select("peak_label", "ms_file_label")


@query("a15_saved_results", ORACLE["a15_delete_results"])
def a15(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d)
    table = _saved(spark, rows, "ms_file_label")
    table.delete(rows.filter("n <= 12"), ["peak_label", "ms_file_label"])
    return table.read().agg(F.count_distinct("peak_label").alias("n_peaks"), F.count_distinct("ms_file_label").alias("n_files"))
