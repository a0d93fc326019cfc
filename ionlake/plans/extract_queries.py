"""Extraction and integration over the driver tables (sections C, D, E, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators import extract as E
from ionlake.operators import integrate as G
from ionlake.plans import views as V
from ionlake.plans.base import query

CHOSEN = "SELECT * FROM (SELECT *, bool_or(peak_selection) OVER (PARTITION BY ms_type) AS any_selected FROM targets) WHERE peak_selection OR NOT any_selected"
#: Chromatograms that are there already: one in five of the pairs, by label length and number.
EXISTING = "SELECT peak_label, ms_file_label, ms_type FROM targets, samples WHERE (mz_mean / 2000 + length(label) + length(sample_type)) % 5 = 0"
PENDING = f"""
    chosen AS ({CHOSEN}), existing AS ({EXISTING}),
    pending AS (
      SELECT c.*, s.ms_file_label FROM chosen c, samples s
      WHERE s.use_for_processing AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.peak_label = c.peak_label AND e.ms_file_label = s.ms_file_label AND e.ms_type = c.ms_type)
    )
"""
MATCHED = "SELECT p.*, t.peak_label FROM points p JOIN targets t ON p.mz BETWEEN t.mz_mean - t.mz_mean * t.mz_width / 1e6 AND t.mz_mean + t.mz_mean * t.mz_width / 1e6"
TOP1 = "SELECT peak_label, ms_file_label, scan_id, intensity, mz FROM (SELECT *, row_number() OVER (PARTITION BY peak_label, ms_file_label, scan_id ORDER BY intensity DESC, mz) AS rn FROM matched) WHERE rn = 1"
CHROM = f"""
    {PENDING}, matched AS ({MATCHED}), top1 AS ({TOP1}),
    needed AS (
      SELECT DISTINCT p.peak_label, p.ms_file_label, s.scan_id, s.scan_time
      FROM pending p JOIN (SELECT DISTINCT ms_file_label, scan_id, scan_time FROM points) s
        ON s.ms_file_label = p.ms_file_label AND s.scan_time BETWEEN coalesce(p.rt_min, 0) - 30 AND coalesce(p.rt_max, 999999) + 30
    ),
    filled AS (
      SELECT n.*, coalesce(round(m.intensity, 0), 1) AS intensity, m.mz FROM needed n LEFT JOIN top1 m USING (peak_label, ms_file_label, scan_id)
    ),
    chrom AS (
      SELECT peak_label, ms_file_label, list(scan_time ORDER BY scan_time) AS scan_time, list(intensity ORDER BY scan_time) AS intensity, list(mz ORDER BY scan_time) AS mz_arr
      FROM filled GROUP BY peak_label, ms_file_label
    )
"""
DIGEST = """
    peak_label, ms_file_label, len(scan_time) AS n, array_to_string(list_transform(scan_time, lambda x: CAST(x AS BIGINT)), ',') AS times,
    array_to_string(list_transform(intensity, lambda x: CAST(x AS BIGINT)), ',') AS intensities
"""
MZ_DIGEST = "array_to_string(list_transform(mz_arr, lambda x: coalesce(CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR), 'null')), ',') AS mzs"


def digest(df: DataFrame) -> DataFrame:
    """Arrays as comma lists of whole numbers, to compare."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    out = [F.col("peak_label"), F.col("ms_file_label"), F.size("scan_time").cast("long").alias("n"), text("scan_time").alias("times"), text("intensity").alias("intensities")]
    if "mz_arr" in df.columns:
        out.append(F.array_join(F.transform("mz_arr", lambda x: F.coalesce(F.round(x * 100).cast("long").cast("string"), F.lit("null"))), ",").alias("mzs"))
    return df.select(*out)


def existing(spark: SparkSession, d: str) -> DataFrame:
    grid = V.targets(spark, d).crossJoin(V.samples(spark, d).select("ms_file_label", "label", "sample_type"))
    return grid.filter((F.col("mz_mean") / 2000 + F.length("label") + F.length("sample_type")) % 5 == 0).select("peak_label", "ms_file_label", "ms_type")


def pending(spark: SparkSession, d: str) -> DataFrame:
    return E.pending_pairs(V.targets(spark, d), V.samples(spark, d), existing(spark, d))


def chromatograms(spark: SparkSession, d: str) -> DataFrame:
    points = V.points(spark, d)
    return E.extract_ms1(points, V.targets(spark, d), pending(spark, d), E.scan_lookup(points))


@query("c1_pair_grid", "SELECT t.peak_label, s.ms_file_label, CASE WHEN rt_unit = 'min' THEN rt_min * 60 ELSE rt_min END AS rt_min, CASE WHEN rt_unit = 'min' THEN rt_max * 60 ELSE rt_max END AS rt_max FROM targets t, samples s", "targets samples")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return E.pair_grid(V.targets(spark, d), V.samples(spark, d)).select("peak_label", "ms_file_label", "rt_min", "rt_max")


@query("c2_pending_pairs", f"WITH {PENDING} SELECT peak_label, ms_file_label, ms_type FROM pending", "targets samples")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return pending(spark, d).select("peak_label", "ms_file_label", "ms_type")


@query("c13_pair_counts", f"WITH chosen AS ({CHOSEN}), existing AS ({EXISTING}) SELECT c.ms_type, count(*) AS n_pairs, count(e.peak_label) AS n_existing, count(*) - count(e.peak_label) AS n_missing FROM chosen c CROSS JOIN samples s LEFT JOIN existing e ON e.peak_label = c.peak_label AND e.ms_file_label = s.ms_file_label AND e.ms_type = c.ms_type GROUP BY c.ms_type", "targets samples")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return E.pair_counts(V.targets(spark, d), V.samples(spark, d), existing(spark, d))


@query("c3_pending_results", "SELECT t.peak_label, t.ms_file_label FROM traces t WHERE NOT EXISTS (SELECT 1 FROM long_results r WHERE r.peak_label = t.peak_label AND r.ms_file_label = t.ms_file_label AND r.n > 12)", "traces long_results")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return E.pending_results(V.traces(spark, d), V.long_results(spark, d).filter("n > 12")).select("peak_label", "ms_file_label")


@query("c4_mz_range_join", f"SELECT peak_label, ms_file_label, scan_id, mz, intensity FROM ({MATCHED})", "points targets")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return E.mz_range_join(V.points(spark, d), V.targets(spark, d)).select("peak_label", "ms_file_label", "scan_id", "mz", "intensity")


@query("c4_mz_sweep_join", f"SELECT peak_label, ms_file_label, scan_id, mz, intensity FROM ({MATCHED})", "points targets")
def c4_sweep(spark: SparkSession, d: str) -> DataFrame:
    return E.mz_sweep_join(V.points(spark, d), V.targets(spark, d)).select("peak_label", "ms_file_label", "scan_id", "mz", "intensity")


@query("c5_rt_range_join", f"WITH {CHROM} SELECT peak_label, ms_file_label, scan_id, scan_time FROM needed", "points targets samples")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return E.rt_range_join(pending(spark, d), E.scan_lookup(V.points(spark, d))).select("peak_label", "ms_file_label", "scan_id", "scan_time")


@query("c6_filterline_join", "SELECT peak_label, ms_file_label, scan_id, intensity FROM points JOIN targets2 USING (filterLine)", "points targets2")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return E.filterline_join(V.points(spark, d), V.targets2(spark, d)).select("peak_label", "ms_file_label", "scan_id", "intensity")


@query("c7_fill_missing_scans", f"WITH {CHROM} SELECT peak_label, ms_file_label, scan_id, scan_time, intensity, mz FROM filled", "points targets samples")
def c7(spark: SparkSession, d: str) -> DataFrame:
    points = V.points(spark, d)
    matched = E.top1_per_scan(E.mz_range_join(points, V.targets(spark, d)))
    return E.fill_missing_scans(E.rt_range_join(pending(spark, d), E.scan_lookup(points)), matched).select("peak_label", "ms_file_label", "scan_id", "scan_time", "intensity", "mz")


@query("d1_top1_per_scan", f"WITH matched AS ({MATCHED}) {TOP1}", "points targets")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return E.top1_per_scan(E.mz_range_join(V.points(spark, d), V.targets(spark, d)))


@query("d2_top1_per_time_bin", f"WITH matched AS ({MATCHED}) SELECT peak_label, ms_file_label, round(scan_time, 3) AS scan_time, round(intensity, 0) AS intensity FROM matched QUALIFY row_number() OVER (PARTITION BY peak_label, ms_file_label, round(scan_time, 2) ORDER BY intensity DESC, scan_time) = 1", "points targets")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return E.top1_per_time_bin(E.mz_range_join(V.points(spark, d), V.targets(spark, d)))


@query("d3_max_per_time", "SELECT peak_label, ms_file_label, round(scan_time, 3) AS scan_time, round(max(intensity), 0) AS intensity FROM points JOIN targets2 USING (filterLine) GROUP BY 1, 2, 3", "points targets2")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return E.max_per_time(E.filterline_join(V.points(spark, d), V.targets2(spark, d)))


@query("d4_ordered_lists", "SELECT peak_label, ms_file_label, len(scan_time) AS n, array_to_string(list_transform(intensity, lambda x: CAST(round(x * 100) AS BIGINT)), ',') AS intensities FROM traces", "traces")
def d4(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform("intensity", lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return V.traces(spark, d).select("peak_label", "ms_file_label", F.size("scan_time").cast("long").alias("n"), text.alias("intensities"))


SCANS = "SELECT DISTINCT ms_file_label, scan_id, scan_time, 'ms1' AS ms_type FROM points WHERE filterLine LIKE '%O' UNION ALL SELECT DISTINCT ms_file_label, scan_id, scan_time, 'ms2' AS ms_type FROM points WHERE filterLine NOT LIKE '%O'"


def scans(spark: SparkSession, d: str) -> DataFrame:
    points = V.points(spark, d)
    open_ = F.col("filterLine").like("%O")
    return E.scan_lookup(points.filter(open_), points.filter(~open_))


@query("d5_scan_lookup", SCANS, "points")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d)


@query("d6_scan_lookup_stats", f"SELECT CAST(sum(n) AS BIGINT) AS n_entries, count(*) AS n_files, round(avg(n), 4) AS avg_scans FROM (SELECT ms_file_label, count(*) AS n FROM ({SCANS}) GROUP BY 1)", "points")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return E.scan_lookup_stats(scans(spark, d))


@query("a22_scans_as_arrays", "SELECT ms_file_label, scan_id, max(scan_time) AS scan_time, array_to_string(list(CAST(round(mz * 100) AS BIGINT) ORDER BY mz, intensity), ',') AS mzs, array_to_string(list(CAST(intensity AS BIGINT) ORDER BY mz, intensity), ',') AS intensities FROM points GROUP BY 1, 2", "points")
def a22(spark: SparkSession, d: str) -> DataFrame:
    out = E.scans_as_arrays(V.points(spark, d))
    mzs = F.array_join(F.transform("mz", lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return out.select("ms_file_label", "scan_id", "scan_time", mzs.alias("mzs"), F.array_join(F.transform("intensity", lambda x: x.cast("long").cast("string")), ",").alias("intensities"))


@query("e1_extract_ms1", f"WITH {CHROM} SELECT {DIGEST}, {MZ_DIGEST} FROM chrom", "points targets samples")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return digest(chromatograms(spark, d))


MS2 = """
    pending AS (SELECT t.*, s.ms_file_label FROM targets2 t, samples s WHERE s.use_for_processing),
    needed AS (
      SELECT DISTINCT p.peak_label, p.ms_file_label, s.scan_id, s.scan_time
      FROM pending p JOIN (SELECT DISTINCT ms_file_label, scan_id, scan_time FROM points) s
        ON s.ms_file_label = p.ms_file_label AND s.scan_time BETWEEN coalesce(p.rt_min, 0) - 30 AND coalesce(p.rt_max, 999999) + 30
    ),
    chrom AS (
      SELECT n.peak_label, n.ms_file_label, list(n.scan_time ORDER BY n.scan_time, coalesce(round(m.intensity, 0), 1)) AS scan_time,
             list(coalesce(round(m.intensity, 0), 1) ORDER BY n.scan_time, coalesce(round(m.intensity, 0), 1)) AS intensity
      FROM needed n LEFT JOIN (SELECT peak_label, ms_file_label, scan_id, intensity FROM points JOIN targets2 USING (filterLine)) m
        ON m.peak_label = n.peak_label AND m.ms_file_label = n.ms_file_label AND m.scan_id = n.scan_id
      GROUP BY 1, 2
    )
"""


@query("e2_extract_ms2", f"WITH {MS2} SELECT {DIGEST} FROM chrom", "points targets2 samples")
def e2(spark: SparkSession, d: str) -> DataFrame:
    points, targets = V.points(spark, d), V.targets2(spark, d)
    pairs = E.pending_pairs(targets, V.samples(spark, d), None)
    return digest(E.extract_ms2(points, targets, pairs, E.scan_lookup(points)))


@query("e3_extract_simple", f"WITH matched AS ({MATCHED}), c AS (SELECT peak_label, ms_file_label, list(scan_time ORDER BY scan_time, intensity, mz) AS scan_time, list(intensity ORDER BY scan_time, intensity, mz) AS intensity FROM matched GROUP BY 1, 2) SELECT {DIGEST} FROM c", "points targets")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return digest(E.extract_simple(V.points(spark, d), V.targets(spark, d)))


@query("e4_extract_matched_only_ms1", f"WITH matched AS (SELECT m.* FROM ({MATCHED}) m JOIN targets t USING (peak_label) WHERE m.scan_time BETWEEN coalesce(t.rt_min, 0) - 30 AND coalesce(t.rt_max, 999999) + 30), top AS (SELECT peak_label, ms_file_label, round(scan_time, 3) AS scan_time, round(intensity, 0) AS intensity FROM matched QUALIFY row_number() OVER (PARTITION BY peak_label, ms_file_label, round(scan_time, 2) ORDER BY intensity DESC, scan_time) = 1), c AS (SELECT peak_label, ms_file_label, list(scan_time ORDER BY scan_time) AS scan_time, list(intensity ORDER BY scan_time) AS intensity FROM top GROUP BY 1, 2) SELECT {DIGEST} FROM c", "points targets")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return digest(E.extract_matched_only_ms1(V.points(spark, d), V.targets(spark, d)))


@query("e5_extract_matched_only_ms2", f"WITH matched AS (SELECT peak_label, ms_file_label, round(scan_time, 3) AS scan_time, round(max(intensity), 0) AS intensity FROM points p JOIN targets2 t USING (filterLine) WHERE p.scan_time BETWEEN t.rt_min - 30 AND t.rt_max + 30 GROUP BY 1, 2, 3), c AS (SELECT peak_label, ms_file_label, list(scan_time ORDER BY scan_time) AS scan_time, list(intensity ORDER BY scan_time) AS intensity FROM matched GROUP BY 1, 2) SELECT {DIGEST} FROM c", "points targets2")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return digest(E.extract_matched_only_ms2(V.points(spark, d), V.targets2(spark, d)))


# Pairs that have a chromatogram but no full-range arrays: those of files with an even name.
@query("e6_extract_full_range", f"""WITH matched AS ({MATCHED}), top1 AS ({TOP1}), pairs AS (SELECT peak_label, ms_file_label FROM ({EXISTING}) WHERE length(ms_file_label) % 2 = 0), filled AS (
    SELECT t.peak_label, s.ms_file_label, s.scan_id, s.scan_time, coalesce(round(m.intensity, 0), 1) AS intensity, m.mz
    FROM pairs t JOIN (SELECT DISTINCT ms_file_label, scan_id, scan_time FROM points) s USING (ms_file_label) LEFT JOIN top1 m ON m.peak_label = t.peak_label AND m.ms_file_label = s.ms_file_label AND m.scan_id = s.scan_id)
    SELECT peak_label, ms_file_label, count(*) AS n, sum(intensity) AS total, max(scan_time) AS t_last, max(intensity) AS top FROM filled GROUP BY 1, 2""", "points targets samples")
def e6(spark: SparkSession, d: str) -> DataFrame:
    points, targets = V.points(spark, d), V.targets(spark, d)
    have = existing(spark, d).withColumn("scan_time_full_ds", F.when(F.length("ms_file_label") % 2 == 1, F.array(F.lit(0.0))))
    # A file has fewer scans than are downsampled, so all of them come out.
    out = E.extract_full_range(points, targets, E.pending_full_range(have, targets), E.scan_lookup(points), n=1000)
    total = F.aggregate("intensity_full_ds", F.lit(0.0), lambda s, x: s + x)
    return out.select("peak_label", "ms_file_label", F.size("scan_time_full_ds").cast("long").alias("n"), total.alias("total"), F.array_max("scan_time_full_ds").alias("t_last"), F.array_max("intensity_full_ds").alias("top"))


@query("e8_recompute", f"WITH {PENDING}, again AS (SELECT c.peak_label, s.ms_file_label, c.ms_type FROM chosen c, samples s WHERE s.use_for_processing) SELECT peak_label, count(*) AS n_recomputed, count(*) FILTER (EXISTS (SELECT 1 FROM pending p WHERE p.peak_label = again.peak_label AND p.ms_file_label = again.ms_file_label)) AS n_pending FROM again GROUP BY 1", "targets samples")
def e8(spark: SparkSession, d: str) -> DataFrame:
    again = E.pending_pairs(V.targets(spark, d), V.samples(spark, d), existing(spark, d), recompute=True).select("peak_label", "ms_file_label")
    waiting = pending(spark, d).select("peak_label", "ms_file_label", F.lit(True).alias("waiting"))
    return again.join(waiting, ["peak_label", "ms_file_label"], "left").groupBy("peak_label").agg(F.count(F.lit(1)).alias("n_recomputed"), F.count_if(F.col("waiting").isNotNull()).alias("n_pending"))


# The chromatograms of a run that computes all again; those that were there are told from the others.
@query(
    "e8_recompute_extract",
    f"WITH {CHROM.replace('FROM pending p JOIN', 'FROM again p JOIN').replace('needed AS', 'again AS (SELECT c.*, s.ms_file_label FROM chosen c, samples s WHERE s.use_for_processing), needed AS', 1)} SELECT {DIGEST}, EXISTS (SELECT 1 FROM existing e WHERE e.peak_label = chrom.peak_label AND e.ms_file_label = chrom.ms_file_label) AS was_there FROM chrom",
    "points targets samples",
)
def e8_extract(spark: SparkSession, d: str) -> DataFrame:
    points, targets = V.points(spark, d), V.targets(spark, d)
    again = E.pending_pairs(targets, V.samples(spark, d), existing(spark, d), recompute=True)
    have = existing(spark, d).select("peak_label", "ms_file_label", F.lit(True).alias("there"))
    out = digest(E.extract_ms1(points, targets, again, E.scan_lookup(points), match=E.mz_join).drop("mz_arr"))
    return out.join(have, ["peak_label", "ms_file_label"], "left").withColumn("was_there", F.coalesce("there", F.lit(False))).drop("there")


@query("e7_slice_raw", f"SELECT m.peak_label, m.ms_file_label, count(*) AS n, round(max(m.intensity) * 1.10, 4) AS y_max, min(m.intensity) AS y_min, min(m.scan_time) AS t_min, max(m.scan_time) AS t_max FROM ({MATCHED}) m JOIN targets t USING (peak_label) WHERE m.scan_time BETWEEN t.rt_min AND t.rt_max GROUP BY 1, 2", "points targets")
def e7(spark: SparkSession, d: str) -> DataFrame:
    return E.slice_raw(V.points(spark, d), V.targets(spark, d)).withColumn("y_max", F.round("y_max", 4))


METRICS = """
    SELECT *, list_filter(list_transform(range(1, len(scan_time) + 1), lambda k: {'t': scan_time[k], 'i': intensity[k]}), lambda p: p.t >= rt_min - shift AND p.t <= rt_max - shift) AS w FROM src
"""
METRICS2 = """
    w1 AS (SELECT *, list_transform(w, lambda p: p.t) AS tt, list_transform(w, lambda p: p.i) AS ii FROM w0),
    w2 AS (SELECT *, CAST(list_position(ii, list_max(ii)) AS BIGINT) AS top FROM w1),
    metrics AS (SELECT *,
      len(ii) AS peak_n_datapoints,
      round(coalesce(list_sum(list_transform(range(1, len(tt)), lambda k: (ii[k] + ii[k + 1]) / 2.0 * (tt[k + 1] - tt[k]))), 0), 0) AS peak_area,
      round(coalesce(list_max(ii), 0), 0) AS peak_max, round(coalesce(list_min(ii), 0), 0) AS peak_min, round(coalesce(list_avg(ii), 0), 0) AS peak_mean,
      round(coalesce(list_sort(ii)[CAST(len(ii) / 2 + 1 AS BIGINT)], 0), 0) AS peak_median, tt[top] AS peak_rt_of_max,
      round(coalesce(CASE WHEN top > 1 THEN ii[top - 1] END, 0) + list_max(ii) + coalesce(ii[top + 1], 0), 0) AS peak_area_top3
    FROM w2)
"""
NAMES = "peak_label, ms_file_label, peak_area, peak_area_top3, peak_max, peak_min, peak_mean, peak_median, peak_n_datapoints, peak_rt_of_max"


@query("g2_peak_metrics", f"WITH src AS (SELECT t.*, g.rt_min, g.rt_max, 0.0 AS shift FROM traces t JOIN trace_targets g USING (peak_label)), w0 AS ({METRICS}), {METRICS2} SELECT {NAMES} FROM metrics", "traces trace_targets")
def g2(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).join(V.trace_targets(spark, d), "peak_label")
    return G.peak_metrics(rows, F.col("rt_min"), F.col("rt_max")).select(*NAMES.split(", "))


@query("g1_rt_shift_for_file", "SELECT ms_file_label, CASE WHEN n % 3 = 0 THEN 0.0::DOUBLE WHEN n % 3 = 1 THEN n * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS shift FROM (SELECT ms_file_label, max(length(ms_file_label)) + count(*) AS n FROM trace_points GROUP BY 1)", "trace_points")
def g1(spark: SparkSession, d: str) -> DataFrame:
    rows = V.trace_points(spark, d).groupBy("ms_file_label").agg((F.max(F.length("ms_file_label")) + F.count(F.lit(1))).alias("n"))
    # One in three has no entry, one a number and one something that isn't one.
    entry = F.when(F.col("n") % 3 == 1, F.concat(F.lit('{"'), "ms_file_label", F.lit('": '), (F.col("n") * 0.5).cast("string"), F.lit("}"))).when(F.col("n") % 3 == 2, F.concat(F.lit('{"'), "ms_file_label", F.lit('": "bad"}')))
    return rows.withColumn("j", F.coalesce(entry, F.lit('{"other": 1}'))).select("ms_file_label", G.rt_shift_for_file(F.col("j"), F.col("ms_file_label")).alias("shift"))


@query("g4_integrate", f"""WITH {CHROM}, src AS (SELECT c.*, t.rt_min, t.rt_max, CASE WHEN t.bookmark THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END AS shift, t.bookmark AS rt_aligned FROM chrom c JOIN targets t USING (peak_label)), w0 AS ({METRICS}), {METRICS2}
    SELECT {NAMES}, rt_aligned, shift AS rt_shift, mz_arr[CAST(list_position(intensity, peak_max) AS BIGINT)] AS peak_mz_of_max FROM metrics""", "points targets samples")
def g4(spark: SparkSession, d: str) -> DataFrame:
    # Bookmarked targets are aligned: every file has a shift of one scan.
    chosen = V.targets(spark, d).withColumn("rt_align_enabled", F.col("bookmark"))
    shifts = E.pair_grid(chosen.filter("bookmark"), V.samples(spark, d)).select("peak_label", "ms_file_label", F.lit(7.0).alias("shift"))
    return G.integrate(chromatograms(spark, d), chosen, shifts).select(*NAMES.split(", "), "rt_aligned", "rt_shift", "peak_mz_of_max")


@query("g5_peak_properties", """WITH p AS (SELECT t.peak_label, t.ms_file_label, t.scan_time AS t, t.intensity AS i, t.event_id, g.rt_min, g.rt_max FROM trace_points t JOIN trace_targets g USING (peak_label) JOIN (SELECT ms_file_label FROM users WHERE use_for_processing) u USING (ms_file_label)),
    tot AS (SELECT peak_label, ms_file_label, sum(i) AS total_intensity FROM p GROUP BY 1, 2),
    f AS (SELECT *, lag(i) OVER w AS b, lead(i) OVER w AS a, lead(t) OVER w AS next_t, row_number() OVER (PARTITION BY peak_label, ms_file_label ORDER BY i DESC, t) AS rn FROM p WHERE t BETWEEN rt_min AND rt_max WINDOW w AS (PARTITION BY peak_label, ms_file_label ORDER BY t, event_id))
    SELECT f.peak_label, f.ms_file_label, round(max(total_intensity), 4) AS total_intensity, round(sum(CASE WHEN next_t IS NOT NULL THEN (i + a) / 2.0 * (next_t - t) ELSE 0 END), 0) AS peak_area, round(max(i), 0) AS peak_max, round(min(i), 0) AS peak_min, round(CAST(sum(CAST(i AS DECIMAL(28,6))) AS DOUBLE) / count(*), 0) AS peak_mean,
      round(median(i), 0) AS peak_median, count(*) AS peak_n_datapoints, round(max(CASE WHEN rn = 1 THEN i + coalesce(b, 0) + coalesce(a, 0) END), 0) AS peak_area_top3, max(CASE WHEN rn = 1 THEN t END) AS peak_rt_of_max
    FROM f JOIN tot USING (peak_label, ms_file_label) GROUP BY 1, 2""", "trace_points trace_targets users")
def g5(spark: SparkSession, d: str) -> DataFrame:
    out = G.peak_properties(V.traces(spark, d), V.trace_targets(spark, d), V.users(spark, d))
    return out.withColumn("total_intensity", F.round("total_intensity", 4)).select(*NAMES.split(", "), "total_intensity")
