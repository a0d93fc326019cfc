"""Array functions on traces over the driver tables (section F), and file formats written and read back (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.functions import names as N
from ionlake.operators import rt as H
from ionlake.operators import traces as X
from ionlake.plans import views as V
from ionlake.plans.base import query
from ionlake.sources import readers, staging


def ints(column) -> F.Column:
    return F.array_join(F.transform(column, lambda x: F.round(x).cast("long").cast("string")), ",")


@query("f1_lttb")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return X.lttb(V.traces(spark, d), 8, least=9).select("peak_label", "ms_file_label", F.size("scan_time").alias("n"), F.array_min("scan_time").alias("first"), F.array_max("scan_time").alias("last"))


# Runs of signal by gaps and islands; a point stays if it or a neighbour is in a run of three.
SPARSE = """
    s AS (SELECT *, row_number() OVER (PARTITION BY peak_label, ms_file_label ORDER BY scan_time, event_id) AS k, intensity > 20 AS sig FROM trace_points),
    g AS (SELECT *, k - row_number() OVER (PARTITION BY peak_label, ms_file_label, sig ORDER BY k) AS island FROM s),
    r AS (SELECT *, sig AND count(*) OVER (PARTITION BY peak_label, ms_file_label, sig, island) >= 3 AS run FROM g),
    kept AS (SELECT *, run OR coalesce(lag(run) OVER w, false) OR coalesce(lead(run) OVER w, false) AS keep FROM r WINDOW w AS (PARTITION BY peak_label, ms_file_label ORDER BY k))
"""


@query("f2_sparsify", f"WITH {SPARSE} SELECT peak_label, ms_file_label, count(*) FILTER (keep) AS n, coalesce(string_agg(CASE WHEN keep THEN CAST(round(intensity) AS BIGINT)::VARCHAR END, ',' ORDER BY k), '') AS kept FROM kept GROUP BY 1, 2", "trace_points")
def f2(spark: SparkSession, d: str) -> DataFrame:
    kept = X.sparsify(X.pairs(), baseline=20.0, width=3, around=1)
    return V.traces(spark, d).withColumn("kept", kept).select("peak_label", "ms_file_label", F.size("kept").cast("long").alias("n"), ints("kept.i").alias("kept"))


@query("f3_stride_downsample", "SELECT peak_label, ms_file_label, array_to_string(list_transform(CASE WHEN len(intensity) > 10 THEN list_transform(range(0, 10), lambda k: intensity[CAST(floor(k * len(intensity) / 10) AS BIGINT) + 1]) ELSE intensity END, lambda x: CAST(round(x) AS BIGINT)), ',') AS values FROM traces", "traces")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return V.traces(spark, d).select("peak_label", "ms_file_label", ints(X.stride_downsample(F.col("intensity"), 10)).alias("values"))


@query("f4_slice_window", "SELECT t.peak_label, t.ms_file_label, count(*) FILTER (scan_time BETWEEN rt_min AND rt_max) AS n, coalesce(string_agg(CASE WHEN scan_time BETWEEN rt_min AND rt_max THEN CAST(round(intensity) AS BIGINT)::VARCHAR END, ',' ORDER BY scan_time, event_id), '') AS values FROM trace_points t JOIN trace_targets g USING (peak_label) GROUP BY 1, 2", "trace_points trace_targets")
def f4(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).join(V.trace_targets(spark, d), "peak_label").withColumn("w", X.slice_window(F.col("rt_min"), F.col("rt_max")))
    return rows.select("peak_label", "ms_file_label", F.size("w").cast("long").alias("n"), ints("w.i").alias("values"))


def _slice_sql(where: str) -> str:
    return f"SELECT peak_label, ms_file_label, count(x) AS n, round(max(x) * 1.1, 6) AS y_max, min(x) AS y_min, min(CASE WHEN x IS NOT NULL THEN scan_time END) AS t_min, max(CASE WHEN x IS NOT NULL THEN scan_time END) AS t_max FROM (SELECT t.*, CASE WHEN {where} THEN intensity END AS x FROM trace_points t JOIN trace_targets g USING (peak_label)) GROUP BY 1, 2"


@query("f5_threshold_slice", _slice_sql("intensity >= intensity_threshold * 5"), "trace_points trace_targets")
def f5(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).join(V.trace_targets(spark, d), "peak_label")
    out = rows.select("peak_label", "ms_file_label", *X.threshold_slice(X.pairs(), F.col("intensity_threshold") * 5))
    return out.withColumns({"n": F.col("n").cast("long"), "y_max": F.round("y_max", 6)})


@query("f6_cached_full_range_slice", _slice_sql("scan_time BETWEEN rt_min AND rt_max"), "trace_points trace_targets")
def f6(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).join(V.trace_targets(spark, d), "peak_label")
    out = rows.select("peak_label", "ms_file_label", *X.threshold_slice(X.slice_window(F.col("rt_min"), F.col("rt_max"))))
    return out.withColumns({"n": F.col("n").cast("long"), "y_max": F.round("y_max", 6)})


@query("f7_preview_slice", "SELECT t.peak_label, t.ms_file_label, count(*) AS n, round(sum(intensity), 4) AS total FROM trace_points t JOIN trace_targets g USING (peak_label) JOIN users u USING (ms_file_label) WHERE u.use_for_processing AND g.intensity_threshold >= 5 AND scan_time BETWEEN rt_min - 2 AND rt_max + 2 GROUP BY 1, 2", "trace_points trace_targets users")
def f7(spark: SparkSession, d: str) -> DataFrame:
    out = X.preview_slice(V.traces(spark, d), V.trace_targets(spark, d).filter("intensity_threshold >= 5"), V.users(spark, d).filter("use_for_processing"))
    return out.select("peak_label", "ms_file_label", F.size("scan_time").cast("long").alias("n"), F.round(F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


SHIFT = "CASE WHEN u.group_1 IS NULL THEN 0 ELSE length(u.group_1) * 0.5 END"


@query("f8_shift_trace", f"SELECT t.peak_label, t.ms_file_label, round(sum(scan_time + {SHIFT}), 2) AS total FROM trace_points t JOIN users u USING (ms_file_label) GROUP BY 1, 2", "trace_points users")
def f8(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).join(V.users(spark, d), "ms_file_label")
    moved = X.shift_trace(F.col("scan_time"), F.length("group_1") * 0.5)
    return rows.select("peak_label", "ms_file_label", F.round(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query("f9_y_range", """WITH p AS (SELECT t.* FROM trace_points t JOIN trace_targets g USING (peak_label) WHERE scan_time BETWEEN rt_min AND rt_max), l AS (SELECT *, row_number() OVER (PARTITION BY peak_label, ms_file_label ORDER BY intensity) AS k FROM p WHERE intensity > 1.0001)
    SELECT a.peak_label, a.ms_file_label, least(0.0::DOUBLE, lo) AS y_min, round(hi * 1.05, 6) AS y_max, round(log10(m), 6) AS log_min, round(log10(hi * 1.05), 6) AS log_max FROM (SELECT peak_label, ms_file_label, min(intensity) AS lo, max(intensity) AS hi FROM p GROUP BY 1, 2) a
    LEFT JOIN (SELECT peak_label, ms_file_label, median(intensity) AS m FROM l WHERE k <= 5 GROUP BY 1, 2) b ON a.peak_label = b.peak_label AND a.ms_file_label = b.ms_file_label""", "trace_points trace_targets")
def f9(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).join(V.trace_targets(spark, d), "peak_label").filter(F.size(X.slice_window(F.col("rt_min"), F.col("rt_max"))) > 0)
    out = rows.select("peak_label", "ms_file_label", *X.y_range(X.pairs(), F.col("rt_min"), F.col("rt_max")))
    return out.withColumns({c: F.round(c, 6) for c in ("y_max", "log_min", "log_max")})


@query("f10_has_visible_points", f"WITH {SPARSE} SELECT ms_file_label, bool_or(keep) AS visible FROM kept GROUP BY 1", "trace_points")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return X.has_visible_points(V.traces(spark, d), ["ms_file_label"], baseline=20.0, width=3)


@query("f11_log2p1", "SELECT event_id, round(log2(intensity + 1), 8) AS y FROM trace_points", "trace_points")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return V.trace_points(spark, d).select("event_id", F.round(X.log2p1(F.col("intensity")), 8).alias("y"))


@query("f12_array_to_string", "SELECT peak_label, ms_file_label, array_to_string(list_transform(intensity, lambda x: CAST(round(x) AS BIGINT)), ',') AS text FROM traces", "traces")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return V.traces(spark, d).select("peak_label", "ms_file_label", X.array_to_string(F.transform("intensity", lambda x: F.round(x).cast("long"))).alias("text"))


APEX = "apex AS (SELECT peak_label, ms_file_label, arg_max(scan_time, struct_pack(i := intensity, t := -scan_time)) AS apex FROM trace_points JOIN trace_targets g USING (peak_label) WHERE scan_time BETWEEN g.rt_min AND g.rt_max GROUP BY 1, 2)"


# Traces here are shorter than a preview's points, so none is thinned and SQL knows them too.
@query("f13_preview_traces", f"""WITH {APEX}, ref AS (SELECT peak_label, median(apex) AS reference FROM apex GROUP BY 1),
    moved AS (SELECT p.peak_label, p.ms_file_label, u.sample_type, scan_time + coalesce(reference - apex, 0) AS t, intensity AS i, rt_min, rt_max FROM trace_points p JOIN trace_targets USING (peak_label) JOIN users u USING (ms_file_label) LEFT JOIN apex a ON a.peak_label = p.peak_label AND a.ms_file_label = p.ms_file_label LEFT JOIN ref r ON r.peak_label = p.peak_label WHERE u.use_for_processing),
    cut AS (SELECT * FROM moved WHERE t BETWEEN rt_min - 2 AND rt_max + 2), one AS (SELECT DISTINCT peak_label, ms_file_label, sample_type FROM cut), types AS (SELECT peak_label, sample_type, count(*) AS k FROM one GROUP BY 1, 2),
    first AS (SELECT one.peak_label, ms_file_label AS first_file FROM one JOIN types ON types.peak_label = one.peak_label AND types.sample_type = one.sample_type QUALIFY row_number() OVER (PARTITION BY one.peak_label ORDER BY k DESC, one.sample_type, ms_file_label) = 1)
    SELECT peak_label, max(i) AS top, min(CASE WHEN i > 0 THEN i END) AS least_positive, count(*) AS n, max(first_file) AS first_file FROM cut JOIN first USING (peak_label) GROUP BY 1""", "trace_points trace_targets users")
def f13(spark: SparkSession, d: str) -> DataFrame:
    targets, users = V.trace_targets(spark, d), V.users(spark, d).filter("use_for_processing")
    shown = X.preview_traces(V.traces(spark, d), targets, users, H.rt_alignment(V.traces(spark, d), targets), n=10_000)
    return shown.groupBy("peak_label").agg(F.max("top").alias("top"), F.min("least_positive").alias("least_positive"), F.sum(F.size("intensity")).alias("n"), F.min_by("ms_file_label", "place").alias("first_file"))


@query("f14_top_contrast_samples", "SELECT peak_label, ms_file_label, round(contrast, 6) AS contrast, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY peak_label ORDER BY contrast DESC NULLS LAST, ms_file_label) AS place FROM (SELECT peak_label, ms_file_label, max(intensity) - min(intensity) AS contrast FROM trace_points GROUP BY 1, 2)) WHERE place <= 5", "trace_points")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return X.top_contrast_samples(V.traces(spark, d), 5).withColumn("contrast", F.round("contrast", 6))


@query("f15_group_neighbors", "WITH n AS (SELECT group_1, count(*) AS c FROM samples GROUP BY 1) SELECT s.ms_file_label AS of, least(10, n.c - 1) AS n_neighbors, true AS same_group FROM samples s JOIN n ON s.group_1 IS NOT DISTINCT FROM n.group_1 WHERE n.c > 1", "samples")
def f15(spark: SparkSession, d: str) -> DataFrame:
    rows = V.samples(spark, d)
    found = X.group_neighbors(rows, "group_1", 10, 7)
    a, b = rows.select(F.col("ms_file_label").alias("of"), F.col("group_1").alias("g1")), rows.select(F.col("ms_file_label").alias("neighbor"), F.col("group_1").alias("g2"))
    return found.join(a, "of").join(b, "neighbor").groupBy("of").agg(F.count_distinct("neighbor").alias("n_neighbors"), F.bool_and(F.col("g1").eqNullSafe(F.col("g2")) & (F.col("of") != F.col("neighbor"))).alias("same_group"))


@query("f16_build_traces", f"WITH {SPARSE} SELECT k.peak_label, k.ms_file_label, count(*) AS n, round(sum(k.scan_time + {SHIFT}), 2) AS total FROM kept k JOIN users u USING (ms_file_label) WHERE keep GROUP BY 1, 2", "trace_points users")
def f16(spark: SparkSession, d: str) -> DataFrame:
    made = X.build_traces(V.traces(spark, d).join(V.users(spark, d), "ms_file_label"), F.length("group_1") * 0.5, baseline=20.0, width=3)
    return made.select("peak_label", "ms_file_label", F.size("scan_time").cast("long").alias("n"), F.round(F.aggregate("scan_time", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


# ------------------------------------------------------------------ files
def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{staging.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_points", "SELECT ms_file_label, count(*) AS n, round(sum(mz), 2) AS total FROM points GROUP BY 1", "points")
def a1(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "points")
    readers.write_points(V.points(spark, d).drop("filterLine"), path)
    return readers.read_points(spark, path).groupBy("ms_file_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 2).alias("total"))


@query("a6_read_table", "SELECT p_partkey, p_name, p_size FROM part")
def a6(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "list") + ".csv"
    readers.write_csv(V.table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.read_table(spark, path, "p_partkey long, p_name string, p_size int")


@query("a8_normalize_column_names", "SELECT p_name AS peak_label, p_retailprice AS mz_mean, p_size * 60.0::DOUBLE AS rt, p_size * 30.0::DOUBLE AS rt_min FROM part")
def a8(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "part").select(F.col("p_name").alias("Compound "), F.col("p_brand").alias("compoundId"), F.col("p_retailprice").alias("medMz"), (F.col("p_size") * 1.0).alias("medRt"), (F.col("p_size") * 0.5).alias("rtMin"))
    return N.normalize_column_names(rows).select("peak_label", "mz_mean", "rt", "rt_min")


@query("a19_export_dense_matrix", "SELECT ms_file_label, " + ", ".join(f"max(CASE WHEN peak_label = '{k}' THEN m END) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM long_results GROUP BY 1", "long_results")
def a19(spark: SparkSession, d: str) -> DataFrame:
    labels = ["click", "error", "purchase", "signup", "view"]
    path = _folder(spark, "matrix") + ".csv"
    readers.write_csv(readers.dense_matrix(V.long_results(spark, d).withColumnRenamed("m", "peak_max"), "ms_file_label", "peak_label", "peak_max", labels), path)
    return readers.read_table(spark, path, "ms_file_label string, " + ", ".join(f"{k} double" for k in labels))


@query("a20_export_targets", "SELECT peak_label, mz_mean, rt_min, score FROM targets", "targets")
def a20(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "targets") + ".csv"
    readers.export_targets(V.targets(spark, d).select("peak_label", "mz_mean", "rt_min", "score"), path)
    return readers.read_table(spark, path, "peak_label string, mz_mean double, rt_min double, score double")


@query("a7_read_feature_groups_json", "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'L' || p_partkey ELSE p_name END AS compound, p_retailprice AS meanMz, p_size::DOUBLE AS meanRt FROM part")
def a7(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    compound = F.struct(F.when(k % 3 == 2, F.col("p_name")).alias("compoundName"), F.when(k % 3 == 0, F.col("p_brand")).alias("compoundId"))
    group = F.struct(F.col("p_retailprice").alias("meanMz"), F.col("p_size").cast("double").alias("meanRt"), F.concat(F.lit("L"), k).alias("label"), compound.alias("compound"))
    path = _folder(spark, "groups") + ".json"
    # A file a brand, each one document with its groups.
    documents = V.table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(group).alias("groups")).select(F.to_json(F.struct("groups")).alias("value"))
    documents.write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_feature_groups_json(spark, path).select("compound", "meanMz", "meanRt")


@query("a2_ingest_spectra", "SELECT ms_file_label, count(*) AS n, round(sum(mz), 2) AS total, max(scan_time) AS t_last, count(DISTINCT scan_id) AS n_scans FROM points GROUP BY 1", "points")
def a2(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.sources.mzml_writer import write_mzml
    from ionlake.sources.spectra import good_points, ingest_spectra

    path = _folder(spark, "spectra")
    write_mzml(V.points(spark, d), path).count()
    rows = good_points(ingest_spectra(spark, path))
    return rows.groupBy("ms_file_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 2).alias("total"), F.max("scan_time").alias("t_last"), F.count_distinct("scan_id").alias("n_scans"))


@query(
    "a2_ingest_broken",
    """
    WITH broken AS (SELECT ms_file_label, max(scan_id) % 4 = 1 AS b FROM points GROUP BY 1)
    SELECT ms_file_label, CASE WHEN b THEN 0 ELSE count(*) END AS n, CASE WHEN NOT b THEN round(sum(mz), 2) END AS total, CASE WHEN NOT b THEN count(DISTINCT scan_id) END AS n_scans, CASE WHEN b THEN 1 ELSE 0 END AS n_errors
    FROM points JOIN broken USING (ms_file_label) GROUP BY ms_file_label, b
    """,
    "points",
)
def a2_broken(spark: SparkSession, d: str) -> DataFrame:
    """Files read in ranges, of which some break off at nine tenths: those give no point and an error."""
    from ionlake.sources.mzml_writer import write_mzml
    from ionlake.sources.spectra import good_points, ingest_errors, ingest_spectra

    path, points = _folder(spark, "spectra"), V.points(spark, d)
    broken = points.groupBy("ms_file_label").agg((F.max("scan_id") % 4 == 1).alias("broken"))
    write_mzml(points.join(broken, "ms_file_label").withColumn("share", F.when(F.col("broken"), 0.9).otherwise(1.0)), path).count()
    found = ingest_spectra(spark, path, whole_bytes=1 << 14, split_bytes=1 << 14)
    good = good_points(found).groupBy("ms_file_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 2).alias("total"), F.count_distinct("scan_id").alias("n_scans"), F.lit(0).alias("n_errors"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("total", "double"), ("n_scans", "long"))]
    return good.unionByName(ingest_errors(found).groupBy("ms_file_label").agg(F.lit(0).cast("long").alias("n"), *nothing, F.count(F.lit(1)).cast("int").alias("n_errors")))
