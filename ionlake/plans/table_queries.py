"""Target rules, table maintenance and browsing over the driver tables (sections A, B, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.functions import names as N
from ionlake.operators import browse as R
from ionlake.operators import targets as T
from ionlake.plans import views as V
from ionlake.plans.base import query

# Target rows in need of rules: some lack times or bounds, some have them the wrong way round.
RAW = """
    SELECT CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'L' || (p_partkey // 2) END AS peak_label, p_partkey AS row_no, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS rt,
           CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size - 2.0 END AS rt_min, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size + (p_partkey % 9) - 3.0 END AS rt_max,
           CASE p_partkey % 6 WHEN 0 THEN 'min' WHEN 1 THEN ' Minutes' WHEN 2 THEN 'hour' WHEN 3 THEN 'sec' ELSE 's' END AS rt_unit,
           CASE p_partkey % 7 WHEN 0 THEN '+' WHEN 1 THEN ' Neg' WHEN 2 THEN 'odd' WHEN 3 THEN NULL ELSE 'positive' END AS polarity, CASE WHEN p_partkey % 8 = 0 THEN 'FTMS' WHEN p_partkey % 8 = 1 THEN ' ' END AS filterLine,
           CASE WHEN p_partkey % 4 = 1 THEN 5.0 END AS mz_width, CASE WHEN p_partkey % 5 = 1 THEN false END AS peak_selection, CASE WHEN p_partkey % 6 = 1 THEN true END AS bookmark
    FROM part
"""


def raw(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return V.table(spark, d, "part").select(
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("L"), F.floor(k / 2))).alias("peak_label"), k.alias("row_no"), F.when(k % 5 != 0, size.cast("double")).alias("rt"), F.when(k % 3 != 0, size - 2.0).alias("rt_min"),
        F.when(k % 4 != 0, size + (k % 9) - 3.0).alias("rt_max"), F.when(k % 6 == 0, "min").when(k % 6 == 1, " Minutes").when(k % 6 == 2, "hour").when(k % 6 == 3, "sec").otherwise("s").alias("rt_unit"),
        F.when(k % 7 == 0, "+").when(k % 7 == 1, " Neg").when(k % 7 == 2, "odd").when(k % 7 != 3, "positive").alias("polarity"), F.when(k % 8 == 0, "FTMS").when(k % 8 == 1, " ").alias("filterLine"),
        F.when(k % 4 == 1, 5.0).alias("mz_width"), F.when(k % 5 == 1, False).alias("peak_selection"), F.when(k % 6 == 1, True).alias("bookmark"),
    )


B1 = f"""
    b1 AS (SELECT * REPLACE (
        CASE WHEN rt IS NULL AND rt_min IS NOT NULL AND rt_max IS NOT NULL THEN (rt_min + rt_max) / 2 ELSE rt END AS rt,
        coalesce(rt_min, CASE WHEN rt IS NOT NULL AND rt_max IS NOT NULL THEN rt - (rt_max - rt) ELSE rt - 5 END) AS rt_min,
        coalesce(rt_max, CASE WHEN rt IS NOT NULL AND rt_min IS NOT NULL THEN rt + (rt - rt_min) ELSE rt + 5 END) AS rt_max),
        rt IS NOT NULL AND (rt_min IS NULL OR rt_max IS NULL) AS rt_auto_adjusted,
        CASE WHEN rt IS NULL AND (rt_min IS NULL OR rt_max IS NULL) THEN CASE WHEN rt_min IS NOT NULL OR rt_max IS NOT NULL THEN 'only one bound' ELSE 'no retention time' END END AS error
      FROM ({RAW}))
"""
B3 = """
    b3 AS (SELECT * REPLACE (rt * f AS rt, rt_min * f AS rt_min, rt_max * f AS rt_max, 's' AS rt_unit, coalesce(error, CASE WHEN NOT ok THEN 'unknown unit' END) AS error)
      FROM (SELECT *, CASE WHEN lower(trim(rt_unit)) IN ('min', 'minute', 'minutes', 'm') THEN 60.0::DOUBLE ELSE 1.0::DOUBLE END AS f, lower(trim(rt_unit)) IN ('min', 'minute', 'minutes', 'm', 's', 'sec', 'second', 'seconds') AS ok FROM b1))
"""
B2 = "b2 AS (SELECT * REPLACE (coalesce(error, CASE WHEN trim(peak_label) = '' THEN 'empty label' WHEN rt_min >= rt_max THEN 'rt_min not below rt_max' WHEN rt_min < 0 THEN 'negative rt_min' END) AS error) FROM b3)"
B4 = "b4 AS (SELECT * REPLACE (rt_auto_adjusted OR coalesce(NOT (rt BETWEEN rt_min AND rt_max), false) AS rt_auto_adjusted, CASE WHEN NOT (rt BETWEEN rt_min AND rt_max) THEN (rt_min + rt_max) / 2 ELSE rt END AS rt) FROM b2)"
B6 = "b6 AS (SELECT *, row_number() OVER (PARTITION BY peak_label ORDER BY row_no) > 1 AS duplicate FROM b4)"
TIMES = ["row_no", "peak_label", "rt", "rt_min", "rt_max", "rt_auto_adjusted", "error"]
LIST = ", ".join(TIMES)


@query("b1_derive_rt_window", f"WITH {B1} SELECT {LIST} FROM b1")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return T.derive_rt_window(raw(spark, d)).select(*TIMES)


@query("b3_rt_to_seconds_unit", f"WITH {B1}, {B3} SELECT {LIST}, rt_unit FROM b3")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return T.rt_to_seconds_unit(T.derive_rt_window(raw(spark, d))).select(*TIMES, "rt_unit")


@query("b2_validate_targets", f"WITH {B1}, {B3}, {B2} SELECT {LIST} FROM b2")
def b2(spark: SparkSession, d: str) -> DataFrame:
    return T.validate_targets(T.rt_to_seconds_unit(T.derive_rt_window(raw(spark, d)))).select(*TIMES)


def checked(spark: SparkSession, d: str) -> DataFrame:
    return T.recenter_rt(T.validate_targets(T.rt_to_seconds_unit(T.derive_rt_window(raw(spark, d)))))


@query("b4_recenter_rt", f"WITH {B1}, {B3}, {B2}, {B4} SELECT {LIST} FROM b4")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).select(*TIMES)


@query("b5_default_target_fields", f"""SELECT row_no, coalesce(mz_width, 10.0)::DOUBLE AS mz_width, replace(replace(replace(replace(polarity, '+', 'Positive'), 'positive', 'Positive'), '-', 'Negative'), 'negative', 'Negative') AS polarity,
    CASE WHEN coalesce(filterLine, '') <> '' THEN 'ms2' ELSE 'ms1' END AS ms_type, coalesce(peak_selection, true) AS peak_selection, coalesce(bookmark, false) AS bookmark FROM ({RAW})""")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return T.default_target_fields(raw(spark, d)).select("row_no", "mz_width", "polarity", "ms_type", "peak_selection", "bookmark")


@query("b6_dedupe_targets", f"WITH {B1}, {B3}, {B2}, {B4}, {B6} SELECT row_no, peak_label, duplicate FROM b6")
def b6(spark: SparkSession, d: str) -> DataFrame:
    return T.dedupe_targets(checked(spark, d), ["row_no"]).select("row_no", "peak_label", "duplicate")


@query("b7_target_stats", f"WITH {B1}, {B3}, {B2}, {B4}, {B6} SELECT count(*) AS processed, count(error) AS failed, count(*) FILTER (error IS NULL AND NOT duplicate) AS unique_labels, count(*) FILTER (error IS NULL AND duplicate) AS duplicates, count(*) FILTER (error IS NULL AND rt_auto_adjusted) AS adjusted FROM b6")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return T.target_stats(T.dedupe_targets(checked(spark, d), ["row_no"]))


BOTH = "SELECT * FROM targets UNION ALL SELECT * FROM targets2"


@query("b8_selected_or_all", f"SELECT peak_label FROM (SELECT *, bool_or(peak_selection) OVER (PARTITION BY ms_type) AS s FROM ({BOTH})) WHERE peak_selection OR NOT s", "targets targets2")
def b8(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.extract import selected_or_all

    return selected_or_all(V.targets(spark, d).unionByName(V.targets2(spark, d))).select("peak_label")


@query("b9_bookmarked_only", f"SELECT peak_label, score FROM ({BOTH}) WHERE bookmark", "targets targets2")
def b9(spark: SparkSession, d: str) -> DataFrame:
    return V.targets(spark, d).unionByName(V.targets2(spark, d)).filter("bookmark").select("peak_label", "score")


@query("b10_samples_for", "SELECT 'optimization' AS stage, ms_file_label FROM samples WHERE use_for_optimization UNION ALL SELECT 'processing', ms_file_label FROM samples WHERE use_for_processing UNION ALL SELECT 'analysis', ms_file_label FROM samples WHERE use_for_analysis", "samples")
def b10(spark: SparkSession, d: str) -> DataFrame:
    rows = V.samples(spark, d)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"use_for_{s}").alias("use")) for s in ("optimization", "processing", "analysis")])
    return rows.select("ms_file_label", F.explode(stages).alias("s")).filter("s.use").select("s.stage", "ms_file_label")


@query("b11_rt_in_seconds", f"SELECT row_no, CASE WHEN rt_unit = 'min' THEN rt * 60 ELSE rt END AS rt_seconds FROM ({RAW})")
def b11(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.extract import rt_in_seconds

    return raw(spark, d).select("row_no", rt_in_seconds("rt").alias("rt_seconds"))


@query("b12_keyword_filter", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#1', 'Brand#2') AND p_type ILIKE '%e%'")
def b12(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_filter(V.table(spark, d, "part"), {"p_name": "A", "p_type": "e", "absent": "x", "p_brand": ""}, {"p_brand": ["Brand#11", "Brand#12", "Brand#13", "Brand#1", "Brand#2"]}).select("p_partkey", "p_name")


@query("b13_choose_targets", "SELECT peak_label FROM targets t WHERE NOT bookmark AND peak_selection AND EXISTS (SELECT 1 FROM points p WHERE p.mz BETWEEN t.mz_mean - t.mz_mean * t.mz_width / 1e6 AND t.mz_mean + t.mz_mean * t.mz_width / 1e6)", "targets points")
def b13(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.extract import mz_range_join

    targets = V.targets(spark, d)
    chrom = mz_range_join(V.points(spark, d), targets).select("peak_label").distinct().withColumn("ms_type", F.lit("ms1"))
    return T.choose_targets(targets.unionByName(V.targets2(spark, d)), "ms1", bookmark=False, chromatograms=chrom).select("peak_label")


@query("c10_order_by_list", "SELECT ms_file_label, coalesce(ord::DOUBLE, 1e9) AS ord FROM samples LEFT JOIN (SELECT n_name AS nn, n_nationkey AS ord FROM nation WHERE n_regionkey = 1) ON sample_type = nn", "samples")
def c10(spark: SparkSession, d: str) -> DataFrame:
    order = V.table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    return R.order_by_list(V.samples(spark, d), "sample_type", order).select("ms_file_label", "ord")


@query("d7_page", "SELECT *, (SELECT count(*) FROM part WHERE p_name ILIKE '%e%') AS total FROM (SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%e%' ORDER BY p_size DESC NULLS FIRST, lower(p_name), p_partkey LIMIT 25 OFFSET 50)")
def d7(spark: SparkSession, d: str) -> DataFrame:
    rows = R.keyword_filter(V.table(spark, d, "part"), {"p_name": "e"}).select("p_partkey", "p_name", "p_size")
    return R.page(rows, [("p_size", "descend"), ("absent", "ascend"), ("p_name", "ascend")], "p_partkey", 50, 25)


@query("d8_multi_sort", f"SELECT row_no, row_number() OVER (ORDER BY lower(polarity) ASC NULLS LAST, rt DESC NULLS FIRST, row_no) AS place FROM ({RAW})")
def d8(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.ranks import global_rank

    rows = raw(spark, d)
    return global_rank(rows, R.sort_keys(rows, [("polarity", "ascend"), ("rt", "descend")], "row_no"), "place").select("row_no", "place")


# A page at nine tenths of the rows, looked for by ranges.
@query("d7_deep_page", "WITH n AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY lower(event_type) DESC NULLS FIRST, value, event_id) AS k, count(*) OVER () AS total FROM events) SELECT event_id, event_type, value, total FROM n WHERE k > total * 9 // 10 AND k <= total * 9 // 10 + 25")
def d7_deep(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "events").select("event_id", "event_type", "value")
    return R.page(rows, [("event_type", "descend"), ("value", "ascend")], "event_id", rows.count() * 9 // 10, 25, shallow=1000)


@query("d9_page_by_group", "WITH g AS (SELECT peak_label, max(v) AS best FROM long_results GROUP BY 1), p AS (SELECT peak_label, row_number() OVER (ORDER BY best DESC NULLS FIRST, peak_label) AS group_place FROM g QUALIFY group_place BETWEEN 2 AND 3) SELECT r.peak_label, r.ms_file_label, r.n, CAST(group_place AS INTEGER) AS group_place, (SELECT count(*) FROM g) AS n_groups FROM long_results r JOIN p USING (peak_label)", "long_results")
def d9(spark: SparkSession, d: str) -> DataFrame:
    return R.page_by_group(V.long_results(spark, d), "peak_label", "v", True, 1, 2).select("peak_label", "ms_file_label", "n", "group_place", "n_groups")


@query("d10_distinct_values", "SELECT DISTINCT sample_type FROM samples WHERE sample_type IS NOT NULL", "samples")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_values(V.samples(spark, d), "sample_type")


@query("d11_sample_tree", "SELECT sample_type, count(*) AS n, string_agg(label || '=' || ms_file_label, ',' ORDER BY label, ms_file_label) AS nodes FROM samples GROUP BY 1", "samples")
def d11(spark: SparkSession, d: str) -> DataFrame:
    out = R.sample_tree(V.samples(spark, d))
    return out.select("sample_type", F.size("nodes").cast("long").alias("n"), F.array_join(F.transform("nodes", lambda x: F.concat(x["title"], F.lit("="), x["key"])), ",").alias("nodes"))


@query("d12_target_order", "SELECT peak_label, row_number() OVER (ORDER BY score, peak_label) AS place FROM targets", "targets")
def d12(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.ranks import global_rank

    return global_rank(V.targets(spark, d), [F.col("score"), F.col("peak_label")], "place").select("peak_label", "place")


@query("d14_intersect", "SELECT peak_label FROM (SELECT sample_type AS peak_label FROM samples INTERSECT SELECT n_name FROM nation WHERE n_regionkey < 3)", "samples")
def d14(spark: SparkSession, d: str) -> DataFrame:
    return V.samples(spark, d).select(F.col("sample_type").alias("peak_label")).intersect(V.table(spark, d, "nation").filter("n_regionkey < 3").select("n_name"))


@query("d15_lead_lag", "SELECT event_id, lag(intensity) OVER w AS before, lead(intensity) OVER w AS after FROM trace_points WINDOW w AS (PARTITION BY peak_label, ms_file_label ORDER BY scan_time, event_id)", "trace_points")
def d15(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("peak_label", "ms_file_label").orderBy("scan_time", "event_id")
    return V.trace_points(spark, d).select("event_id", F.lag("intensity").over(w).alias("before"), F.lead("intensity").over(w).alias("after"))


@query("d16_aggregates", "SELECT peak_label, round(median(intensity), 4) AS median, round(avg(intensity), 4) AS mean, min(intensity) AS low, max(intensity) AS high, round(sum(intensity), 2) AS total, count(*) AS n, count(DISTINCT ms_file_label) AS n_files FROM trace_points GROUP BY 1", "trace_points")
def d16(spark: SparkSession, d: str) -> DataFrame:
    rows = V.trace_points(spark, d).groupBy("peak_label")
    return rows.agg(F.round(F.median("intensity"), 4).alias("median"), F.round(F.avg("intensity"), 4).alias("mean"), F.min("intensity").alias("low"), F.max("intensity").alias("high"), F.round(F.sum("intensity"), 2).alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("ms_file_label").alias("n_files"))


@query("d17_quota_sample", "SELECT sample_type, CASE WHEN (SELECT count(*) FROM users) <= 50 THEN count(*) ELSE least(count(*), greatest(1, floor(50 * (count(*) / (SELECT count(*) FROM users))))) END::BIGINT AS n FROM users GROUP BY 1", "users")
def d17(spark: SparkSession, d: str) -> DataFrame:
    return R.quota_sample(V.users(spark, d), "sample_type", "ms_file_label", 50).groupBy("sample_type").agg(F.count(F.lit(1)).alias("n"))


def _like(patterns: list[str]) -> str:
    return " OR ".join(f"x LIKE '%{p}%'" for p in patterns)


@query("a5_detect_sample_type", f"SELECT p_partkey, CASE {' '.join(f'WHEN {_like(p)} THEN {t!r}' for t, _, p in N.SAMPLE_TYPES)} ELSE 'Sample' END AS sample_type FROM (SELECT p_partkey, lower(p_name || CASE p_partkey % 9 WHEN 0 THEN '_Blank' WHEN 1 THEN 'STD1' WHEN 2 THEN '-qc' WHEN 3 THEN '_pool_blk' ELSE '' END) AS x FROM part)")
def a5(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 9 == 0, "_Blank").when(k % 9 == 1, "STD1").when(k % 9 == 2, "-qc").when(k % 9 == 3, "_pool_blk").otherwise(""))
    return V.table(spark, d, "part").select("p_partkey", N.detect_sample_type(name).alias("sample_type"))


@query("a23_rt_to_seconds", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 60.0 + 30 WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 3600.0 * (p_size % 3) + 5 WHEN 3 THEN 0.0 ELSE p_size / 4.0 END::DOUBLE AS seconds FROM part")
def a23(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("PT"), size, F.lit("M30S"))).when(k % 5 == 1, F.concat(F.lit(" "), size, F.lit(".5"))).when(k % 5 == 2, F.concat(F.lit("PT"), size % 3, F.lit("H5S")))
        .when(k % 5 == 3, "soon").otherwise(F.concat(F.lit("PT"), (size / 4.0).cast("string"), F.lit("S")))
    )
    return V.table(spark, d, "part").select("p_partkey", N.rt_to_seconds(text).alias("seconds"))


@query("a3_skip_known_files", "SELECT 'S' || l_suppkey || '.mzML' AS path FROM lineitem WHERE 'S' || l_suppkey NOT IN (SELECT ms_file_label FROM samples WHERE use_for_optimization) GROUP BY 1", "samples")
def a3(spark: SparkSession, d: str) -> DataFrame:
    files = V.table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey", F.lit(".mzML")).alias("path")).distinct()
    return N.skip_known_files(files, V.samples(spark, d).filter("use_for_optimization"))


@query("a4_register_samples", "SELECT ms_file_label, min(scan_time) AS first_scan, count(*) AS n_points, 'Sample' AS sample_type, '#BBBBBB' AS color FROM points GROUP BY 1", "points")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return N.register_samples(V.points(spark, d))


@query("a9_read_metadata", "SELECT ms_file_label, min(sample_type) AS sample_type, true AS use_for_optimization, min(label) AS label FROM samples GROUP BY 1", "samples")
def a9(spark: SparkSession, d: str) -> DataFrame:
    first = V.samples(spark, d).select("ms_file_label", "sample_type", "label")
    second = first.withColumn("sample_type", F.lit("late")).withColumn("extra", F.lit(1))
    return N.read_metadata([first, second]).select("ms_file_label", "sample_type", "use_for_optimization", "label")


@query("a10_update_samples", "SELECT ms_file_label, coalesce(CASE WHEN use_for_processing THEN 'new' END, sample_type) AS sample_type, color FROM samples", "samples")
def a10(spark: SparkSession, d: str) -> DataFrame:
    old = V.samples(spark, d)
    new = old.select("ms_file_label", F.when(F.col("use_for_processing"), "new").alias("sample_type"), F.lit(None).cast("string").alias("color"))
    return T.update_rows(old, new, "ms_file_label", ["sample_type", "color"]).select("ms_file_label", "sample_type", "color")


@query("a11_upsert_targets", "SELECT peak_label, CASE WHEN bookmark THEN -1.0 ELSE score END AS score FROM targets", "targets")
def a11(spark: SparkSession, d: str) -> DataFrame:
    old = V.targets(spark, d).select("peak_label", "score", "bookmark")
    return T.upsert(old, old.filter("bookmark").withColumn("score", F.lit(-1.0)), ["peak_label"]).select("peak_label", "score")


@query("a12_upsert_chromatograms", "SELECT peak_label, ms_file_label, CASE WHEN use_for_processing THEN 0::BIGINT ELSE len(intensity) END AS n FROM traces JOIN users USING (ms_file_label)", "traces users")
def a12(spark: SparkSession, d: str) -> DataFrame:
    old = V.traces(spark, d)
    used = V.users(spark, d).filter("use_for_processing").select("ms_file_label")
    new = old.join(used, "ms_file_label", "left_semi").select("peak_label", "ms_file_label", F.array().cast("array<double>").alias("scan_time"), F.array().cast("array<double>").alias("intensity"))
    return T.upsert(old, new, ["peak_label", "ms_file_label"]).select("peak_label", "ms_file_label", F.size("intensity").cast("long").alias("n"))


@query("a13_delete_files", "SELECT 'points' AS table_name, count(*) AS n FROM points WHERE ms_file_label NOT IN (SELECT ms_file_label FROM samples WHERE NOT use_for_processing) UNION ALL SELECT 'samples', count(*) FROM samples WHERE use_for_processing", "points samples")
def a13(spark: SparkSession, d: str) -> DataFrame:
    samples = V.samples(spark, d)
    left = T.delete_rows({"points": V.points(spark, d), "samples": samples}, samples.filter("NOT use_for_processing"), ["ms_file_label"])
    return left["points"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("points").alias("table_name"), "n").unionByName(left["samples"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("samples").alias("table_name"), "n"))


@query("a14_delete_targets", "SELECT peak_label, ms_file_label FROM long_results WHERE peak_label NOT IN (SELECT peak_label FROM trace_targets WHERE intensity_threshold > 5)", "long_results trace_targets")
def a14(spark: SparkSession, d: str) -> DataFrame:
    gone = V.trace_targets(spark, d).filter("intensity_threshold > 5")
    return T.delete_rows({"results": V.long_results(spark, d)}, gone, ["peak_label"])["results"].select("peak_label", "ms_file_label")


@query("a15_delete_results", "SELECT count(DISTINCT peak_label) AS n_peaks, count(DISTINCT ms_file_label) AS n_files FROM long_results WHERE n > 12", "long_results")
def a15(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d)
    left = T.delete_rows({"results": rows}, rows.filter("n <= 12"), ["peak_label", "ms_file_label"])["results"]
    return left.agg(F.count_distinct("peak_label").alias("n_peaks"), F.count_distinct("ms_file_label").alias("n_files"))


@query("a16_validate_dataset", "SELECT 'samples' AS table_name, true AS found, '' AS missing, (SELECT count(*) FROM samples) AS n_rows UNION ALL SELECT 'targets', true, '', (SELECT count(*) FROM targets) UNION ALL SELECT 'ms1_data', true, 'scan_time', (SELECT count(*) FROM points)", "samples targets points")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return R.validate_dataset({"samples": V.samples(spark, d), "targets": V.targets(spark, d), "ms1_data": V.points(spark, d).drop("scan_time")})


@query("a17_table_summary", "SELECT 0 AS place, 'samples' AS table_name, (SELECT count(*) FROM samples) AS n_rows UNION ALL SELECT 1, 'ms1_data', (SELECT count(*) FROM points WHERE filterLine LIKE '%O') UNION ALL SELECT 2, 'ms2_data', (SELECT count(*) FROM points WHERE filterLine NOT LIKE '%O') UNION ALL SELECT 3, 'targets', (SELECT count(*) FROM targets) UNION ALL SELECT 4, 'chromatograms', (SELECT count(*) FROM traces) UNION ALL SELECT 5, 'results', (SELECT count(*) FROM long_results)", "samples targets points traces long_results")
def a17(spark: SparkSession, d: str) -> DataFrame:
    points, open_ = V.points(spark, d), F.col("filterLine").like("%O")
    tables = {"samples": V.samples(spark, d), "ms1_data": points.filter(open_), "ms2_data": points.filter(~open_), "targets": V.targets(spark, d), "chromatograms": V.traces(spark, d), "results": V.long_results(spark, d)}
    return R.table_summary(tables)


@query("a17_target_status", f"SELECT ms_type, count(*) AS n_targets, count(*) FILTER (peak_selection) AS n_selected, count(*) FILTER (peak_label IN (SELECT peak_label FROM points JOIN targets2 USING (filterLine))) AS n_extracted FROM ({BOTH}) GROUP BY 1", "targets targets2 points")
def a17b(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.extract import filterline_join

    two = V.targets2(spark, d)
    return R.target_status(V.targets(spark, d).unionByName(two), filterline_join(V.points(spark, d), two))


@query("a18_export_results_long", "SELECT peak_label, ms_file_label, 'ms1' AS ms_type, array_to_string(list_transform(intensity, lambda x: CAST(round(x) AS BIGINT)), ',') AS intensity FROM traces", "traces")
def a18(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).withColumn("ms_type", F.lit("ms1")).withColumn("intensity", F.transform("intensity", lambda x: F.round(x).cast("long")))
    return R.export_results_long(rows, ["intensity", "secret", "peak_label"], ["intensity", "scan_time"])


@query("a21_import_feature_table", "SELECT peak_label, mz, rt, rt_min, rt_max FROM (SELECT 'F' || p_partkey AS peak_label, p_retailprice AS mz, p_size::DOUBLE AS rt, (p_size - 1.0)::DOUBLE AS rt_min, (p_size + 1.0)::DOUBLE AS rt_max, (p_partkey % 10) / 10.0 AS c, p_partkey % 7 AS n FROM part) WHERE c >= 0.4 AND n >= 3")
def a21(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = V.table(spark, d, "part").select(F.concat(F.lit("F"), k).alias("id_number"), F.col("p_retailprice").alias("mz"), size.cast("double").alias("rtime"), (size - 1.0).alias("rtime_left_base"), (size + 1.0).alias("rtime_right_base"), (k % 10 / 10.0).alias("cSelectivity"), (k % 7).alias("detection_counts"))
    return N.import_feature_table(rows, 0.4, 50, 6).select("peak_label", "mz", "rt", "rt_min", "rt_max")


@query("g8_browse_results", """SELECT r.peak_label, r.ms_file_label, s.sample_type, r.n, round(c.concentration, 6) AS concentration, CASE r.peak_label WHEN 'view' THEN 0.0 WHEN 'click' THEN 1.0 ELSE 1e9 END AS ord, array_to_string(list_transform(CASE WHEN len(t.intensity) > 10 THEN list_transform(range(0, 10), lambda k: t.intensity[CAST(floor(k * len(t.intensity) / 10) AS BIGINT) + 1]) ELSE t.intensity END, lambda x: CAST(round(x) AS BIGINT)), ',') AS spark_line
    FROM long_results r JOIN users s USING (ms_file_label) JOIN traces t USING (peak_label, ms_file_label) LEFT JOIN (SELECT peak_label, ms_file_label, v / 2 AS concentration FROM long_results WHERE n > 12) c USING (peak_label, ms_file_label) WHERE s.sample_type IN ('T1', 'T2')""", "long_results users traces")
def g8(spark: SparkSession, d: str) -> DataFrame:
    from ionlake.operators.calibrate import join_concentrations
    from ionlake.operators.traces import stride_downsample

    results = V.long_results(spark, d)
    rows = join_concentrations(results, results.filter("n > 12").select("peak_label", "ms_file_label", (F.col("v") / 2).alias("concentration")))
    rows = R.keyword_filter(rows.join(V.users(spark, d), "ms_file_label"), isin={"sample_type": ["T1", "T2"]}).join(V.traces(spark, d), ["peak_label", "ms_file_label"])
    order = F.create_map(F.lit("view"), F.lit(0.0), F.lit("click"), F.lit(1.0))
    line = F.array_join(F.transform(stride_downsample(F.col("intensity"), 10), lambda x: F.round(x).cast("long").cast("string")), ",")
    return rows.select("peak_label", "ms_file_label", "sample_type", "n", F.round("concentration", 6).alias("concentration"), F.coalesce(F.try_element_at(order, F.col("peak_label")), F.lit(1e9)).alias("ord"), line.alias("spark_line"))
