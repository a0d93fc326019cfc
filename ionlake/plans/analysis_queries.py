"""Alignment, envelopes, sample-by-target analysis and calibration over the driver tables (sections H, I, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators import analysis as A
from ionlake.operators import calibrate as J
from ionlake.operators import rt as H
from ionlake.plans import views as V
from ionlake.plans.base import query

SHIFTS = """
    apex AS (SELECT peak_label, ms_file_label, arg_max(scan_time, struct_pack(i := intensity, t := -scan_time)) AS apex FROM trace_points JOIN trace_targets g USING (peak_label) WHERE scan_time BETWEEN g.rt_min AND g.rt_max GROUP BY 1, 2),
    ref AS (SELECT peak_label, median(apex) AS reference FROM apex GROUP BY 1),
    shifts AS (SELECT t.peak_label, t.ms_file_label, apex, reference, coalesce(reference - apex, 0) AS shift FROM (SELECT DISTINCT peak_label, ms_file_label FROM trace_points) t LEFT JOIN apex USING (peak_label, ms_file_label) LEFT JOIN ref USING (peak_label))
"""


def shifts(spark: SparkSession, d: str) -> DataFrame:
    return H.rt_alignment(V.traces(spark, d), V.trace_targets(spark, d))


@query("h4_rt_alignment", f"WITH {SHIFTS} SELECT peak_label, ms_file_label, apex, reference, shift FROM shifts", "trace_points trace_targets")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return shifts(spark, d).select("peak_label", "ms_file_label", "apex", "reference", "shift")


@query("h5_shift_by_sample_type", f"WITH {SHIFTS} SELECT peak_label, sample_type, round(median(shift), 4) AS shift FROM shifts JOIN users USING (ms_file_label) GROUP BY 1, 2", "trace_points trace_targets users")
def h5(spark: SparkSession, d: str) -> DataFrame:
    return H.shift_by_sample_type(shifts(spark, d), V.users(spark, d)).withColumn("shift", F.round("shift", 4))


@query("h6_alignment_state", f"WITH {SHIFTS} SELECT peak_label, true AS active, rt_min AS span_min, rt_max AS span_max, round(reference, 4) AS reference FROM trace_targets JOIN ref USING (peak_label)", "trace_points trace_targets")
def h6(spark: SparkSession, d: str) -> DataFrame:
    rows = shifts(spark, d)
    return H.alignment_state(H.save_alignment(V.trace_targets(spark, d), rows), rows).withColumn("reference", F.round("reference", 4))


@query("h7_save_alignment", f"WITH {SHIFTS} SELECT peak_label, count(*) AS n_files, round(sum(shift), 2) AS total_shift, round(max(reference), 4) AS rt_align_reference_rt FROM shifts GROUP BY 1", "trace_points trace_targets")
def h7(spark: SparkSession, d: str) -> DataFrame:
    saved = H.save_alignment(V.trace_targets(spark, d), shifts(spark, d))
    total = F.aggregate(F.map_values("rt_align_shifts"), F.lit(0.0), lambda s, x: s + x)
    return saved.select("peak_label", F.size("rt_align_shifts").cast("long").alias("n_files"), F.round(total, 2).alias("total_shift"), F.round("rt_align_reference_rt", 4).alias("rt_align_reference_rt"))


@query("h8_envelope", """WITH p AS (SELECT peak_label, ms_file_label, sample_type, color, scan_time AS t, intensity AS i FROM trace_points JOIN trace_targets g USING (peak_label) JOIN users USING (ms_file_label) WHERE intensity >= g.intensity_threshold),
    b AS (SELECT peak_label, min(t) AS lo, max(t) AS hi FROM p GROUP BY 1), c AS (SELECT peak_label, sample_type, count(DISTINCT ms_file_label) AS sample_count FROM p GROUP BY 1, 2),
    q AS (SELECT p.*, CAST(least(199, greatest(0, floor((t - lo) / (hi - lo + 1e-9) * 200))) AS INTEGER) AS bin_idx FROM p JOIN b USING (peak_label))
    SELECT peak_label, sample_type, color, bin_idx, round(avg(t), 0) AS rt, min(i) AS min_int, max(i) AS max_int, round(avg(i), 9) AS mean_int, count(*) AS count, max(sample_count) AS sample_count FROM q JOIN c USING (peak_label, sample_type) GROUP BY 1, 2, 3, 4""", "trace_points trace_targets users")
def h8(spark: SparkSession, d: str) -> DataFrame:
    out = H.envelope(V.traces(spark, d), V.trace_targets(spark, d), V.users(spark, d), bins=200)
    return out.withColumns({"rt": F.round("rt", 0), "mean_int": F.round("mean_int", 9)})


COMBINED = """k AS (SELECT *, row_number() OVER w AS k, lead(scan_time) OVER w AS t1, lead(intensity) OVER w AS y1, count(*) OVER (PARTITION BY peak_label, ms_file_label) AS size FROM trace_points WINDOW w AS (PARTITION BY peak_label, ms_file_label ORDER BY scan_time, event_id)),
    grid AS (SELECT DISTINCT peak_label, scan_time AS t FROM trace_points), usable AS (SELECT peak_label, count(DISTINCT ms_file_label) AS usable FROM k WHERE size > 1 GROUP BY 1),
    on_grid AS (SELECT g.peak_label, g.t, CASE WHEN k.t1 > k.scan_time THEN k.intensity + (k.y1 - k.intensity) * ((g.t - k.scan_time) / (k.t1 - k.scan_time)) ELSE k.y1 END AS y FROM grid g LEFT JOIN k ON k.peak_label = g.peak_label AND k.size > 1 AND k.t1 IS NOT NULL AND g.t >= k.scan_time AND (g.t < k.t1 OR g.t = k.t1 AND k.k = k.size - 1)),
    top AS (SELECT o.peak_label, t, CASE WHEN count(y) < any_value(usable) THEN greatest(coalesce(max(y), 0), 0) ELSE max(y) END AS y FROM on_grid o JOIN usable USING (peak_label) GROUP BY 1, 2)"""


@query("h1_combine_traces", f"""WITH {COMBINED}
    SELECT peak_label, count(*) AS n, max(y) AS top, round(sum(y), 2) AS total FROM top GROUP BY 1""", "trace_points")
def h1(spark: SparkSession, d: str) -> DataFrame:
    out = H.combine_traces(V.traces(spark, d), "max")
    total = F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x)
    return out.select("peak_label", F.size("scan_time").cast("long").alias("n"), F.array_max("intensity").alias("top"), F.round(total, 2).alias("total"))


# The smoothing takes 8 points on both sides, mirrored at the ends; without a point near the expected time all are looked at.
@query("h2_h3_optimize_rt_spans", f"""WITH {COMBINED},
    wanted AS (SELECT peak_label, 900000.0::DOUBLE AS expected FROM trace_targets WHERE intensity_threshold > 4),
    placed AS (SELECT peak_label, t, y, row_number() OVER (PARTITION BY peak_label ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY peak_label) AS n FROM top JOIN wanted USING (peak_label)),
    kernel AS (SELECT d, exp(-0.5 * (d / 2.0) * (d / 2.0)) / sum(exp(-0.5 * (d / 2.0) * (d / 2.0))) OVER () AS w FROM range(-8, 9) r(d)),
    asked AS (SELECT peak_label, k, t, w, CASE WHEN (k + d + 2 * n) % (2 * n) < n THEN (k + d + 2 * n) % (2 * n) ELSE 2 * n - 1 - (k + d + 2 * n) % (2 * n) END AS other FROM placed CROSS JOIN kernel),
    smooth AS (SELECT a.peak_label, a.k, a.t, sum(w * b.y) AS s FROM asked a JOIN placed b ON b.peak_label = a.peak_label AND b.k = a.other GROUP BY 1, 2, 3),
    near AS (SELECT *, abs(t - expected) <= 15 OR NOT bool_or(abs(t - expected) <= 15) OVER (PARTITION BY peak_label) AS near FROM smooth JOIN wanted USING (peak_label)),
    best AS (SELECT peak_label, k AS top_at, t AS apex, s AS height, base + 0.1 * (s - base) AS least FROM (SELECT *, min(s) OVER (PARTITION BY peak_label) AS base FROM near WHERE near) QUALIFY row_number() OVER (PARTITION BY peak_label ORDER BY s DESC, k) = 1),
    ends AS (SELECT b.peak_label, apex, min(t) AS t_first, max(t) AS t_last, coalesce(max(CASE WHEN k < top_at AND s < least THEN t END), min(t)) AS lo, coalesce(min(CASE WHEN k > top_at AND s < least THEN t END), max(t)) AS hi FROM best b JOIN smooth s USING (peak_label) GROUP BY 1, 2)
    SELECT g.peak_label, coalesce(apex, 900000.0) AS rt, CASE WHEN apex IS NULL THEN g.rt_min ELSE greatest(CASE WHEN hi - lo < 5 THEN lo - (5 - (hi - lo)) / 2 WHEN hi - lo > 120 THEN apex - 60 ELSE lo END, t_first) END AS rt_min,
           CASE WHEN apex IS NULL THEN g.rt_max ELSE least(CASE WHEN hi - lo < 5 THEN hi + (5 - (hi - lo)) / 2 WHEN hi - lo > 120 THEN apex + 60 ELSE hi END, t_last) END AS rt_max, intensity_threshold > 4 AND apex IS NULL AS rt_auto_adjusted
    FROM trace_targets g LEFT JOIN ends USING (peak_label)""", "trace_points trace_targets")
def h3(spark: SparkSession, d: str) -> DataFrame:
    targets = V.trace_targets(spark, d).withColumns({"rt": F.lit(900000.0), "rt_auto_adjusted": F.col("intensity_threshold") > 4})
    return H.optimize_rt_spans(V.traces(spark, d), targets).select("peak_label", "rt", "rt_min", "rt_max", "rt_auto_adjusted")


@query("g6_fit_emg")
def g6(spark: SparkSession, d: str) -> DataFrame:
    rows = V.traces(spark, d).withColumn("fit_success", F.lit(None).cast("boolean"))
    # A trace by hours from its first point, so that the fit's bounds suit it.
    rows = rows.withColumn("window_time", F.transform("scan_time", lambda t: (t - F.array_min("scan_time")) / 3600)).withColumnRenamed("intensity", "window_intensity").withColumn("rt", F.lit(None).cast("double"))
    return H.fit_emg(H.fit_pending(rows))


@query("g7_fit_pending", "SELECT peak_label, ms_file_label FROM long_results WHERE peak_label IN (SELECT peak_label FROM trace_targets WHERE intensity_threshold > 4) AND NOT coalesce(CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END, false)", "long_results trace_targets")
def g7(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d).withColumn("fit_success", F.when(F.col("n") % 3 == 0, True).when(F.col("n") % 3 == 1, False))
    return H.fit_pending(rows, V.trace_targets(spark, d).filter("intensity_threshold > 4")).select("peak_label", "ms_file_label")


# ------------------------------------------------------------------ I
KINDS = ["click", "error", "purchase", "signup", "view"]


ANALYSED = "analysed AS (SELECT *, CASE sample_type WHEN 'T0' THEN 'ms2' ELSE 'ms1' END AS ms_type, ms_file_label || '2' AS group_2, CAST(NULL AS VARCHAR) AS group_3, group_1 AS group_4, 'x' AS group_5, use_for_processing AS use_for_analysis FROM users)"


def analysed(spark: SparkSession, d: str) -> DataFrame:
    return V.users(spark, d).withColumns({
        "ms_type": F.when(F.col("sample_type") == "T0", "ms2").otherwise("ms1"), "group_2": F.concat("ms_file_label", F.lit("2")), "group_3": F.lit(None).cast("string"), "group_4": F.col("group_1"), "group_5": F.lit("x"), "use_for_analysis": F.col("use_for_processing"),
    })


@query("i1_sample_matrix", f"WITH {ANALYSED} SELECT ms_file_label, ms_type, sample_type, group_1, group_2, group_3, group_4, group_5, " + ", ".join(f"max(CASE WHEN peak_label = '{k}' THEN m END) AS \"{k}\"" for k in KINDS) + " FROM long_results JOIN analysed USING (ms_file_label) WHERE use_for_analysis GROUP BY 1, 2, 3, 4, 5, 6, 7, 8", "long_results users")
def i1(spark: SparkSession, d: str) -> DataFrame:
    targets = V.trace_targets(spark, d).withColumn("ms_type", F.when(F.col("peak_label") < "d", "ms2").otherwise("ms1"))
    return A.sample_matrix(V.long_results(spark, d), analysed(spark, d), "m", A.columns_by_type(targets))


SPARSE = "sparse AS (SELECT peak_label, ms_file_label, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 'inf'::DOUBLE ELSE m END AS m FROM long_results)"


@query("i2_clean_matrix", f"WITH {SPARSE}, f AS (SELECT * FROM sparse WHERE m IS NOT NULL AND NOT isinf(m)) SELECT a.ms_file_label, b.peak_label, coalesce(f.m, 0) AS m FROM (SELECT DISTINCT ms_file_label FROM f) a CROSS JOIN (SELECT DISTINCT peak_label FROM f) b LEFT JOIN f ON f.ms_file_label = a.ms_file_label AND f.peak_label = b.peak_label", "long_results")
def i2(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("n") % 4 == 0, None).when(F.col("n") % 4 == 1, float("inf")).otherwise(F.col("m"))
    return A.clean_long(V.long_results(spark, d).withColumn("m", m), "m")


Z = "CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END"


@query("i3_zscore", f"SELECT peak_label, ms_file_label, round({Z}, 6) AS z FROM long_results WINDOW w AS (PARTITION BY peak_label)", "long_results")
def i3(spark: SparkSession, d: str) -> DataFrame:
    return A.zscore(V.long_results(spark, d), "v").select("peak_label", "ms_file_label", F.round("z", 6).alias("z"))


@query("i4_rocke_durbin", "SELECT peak_label, ms_file_label, round(ln((v + sqrt(v * v + 100)) / 2), 8) AS y FROM long_results", "long_results")
def i4(spark: SparkSession, d: str) -> DataFrame:
    return V.long_results(spark, d).select("peak_label", "ms_file_label", F.round(A.rocke_durbin(F.col("v")), 8).alias("y"))


@query("i5_normalize", f"WITH s AS (SELECT peak_label, ms_file_label, {Z} AS z FROM long_results WINDOW w AS (PARTITION BY peak_label)) SELECT peak_label, ms_file_label, round(ln((z + sqrt(z * z + 100)) / 2), 6) AS y FROM s", "long_results")
def i5(spark: SparkSession, d: str) -> DataFrame:
    return A.normalize(V.long_results(spark, d), "v", "zscore-durbin", "y").select("peak_label", "ms_file_label", F.round("y", 6).alias("y"))


@query("i6_metric_source", "SELECT r.peak_label, r.ms_file_label, c.concentration FROM long_results r LEFT JOIN (SELECT ' ' || peak_label AS p, ms_file_label || ' ' AS f, m * 2 AS concentration FROM long_results WHERE n % 2 = 0) c ON trim(r.peak_label) = trim(c.p) AND trim(r.ms_file_label) = trim(c.f)", "long_results")
def i6(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d)
    other = rows.filter("n % 2 = 0").select(F.concat(F.lit(" "), "peak_label").alias("peak_label"), F.concat("ms_file_label", F.lit(" ")).alias("ms_file_label"), (F.col("m") * 2).alias("concentration"))
    return J.join_concentrations(rows, other).select("peak_label", "ms_file_label", "concentration")


@query("i7_group_labels", "SELECT ms_file_label, coalesce(nullif(group_1, ''), 'group_1 (unset)') AS grp FROM samples", "samples")
def i7(spark: SparkSession, d: str) -> DataFrame:
    return V.samples(spark, d).select("ms_file_label", A.group_label(F.col("group_1"), "group_1").alias("grp"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query("i8_pca")
def i8(spark: SparkSession, d: str) -> DataFrame:
    scores, _, _ = A.pca(_vectors(spark, d), "vec_id", "v", 5)
    return scores.select("vec_id", *[F.round(F.col("scores")[k], 6).alias(f"pc{k + 1}") for k in range(5)])


@query("i9_rank_by_loading")
def i9(spark: SparkSession, d: str) -> DataFrame:
    _, loadings, _ = A.pca(_vectors(spark, d), "vec_id", "v", 5)
    return A.rank_by_loading([f"d{k}" for k in range(len(loadings))], loadings, spark)


# The components of a whole matrix share out its variance.
@query("i8_matrix_variance", "WITH cells AS (SELECT f.ms_file_label, p.peak_label, coalesce(m, 0) AS m FROM (SELECT DISTINCT ms_file_label FROM long_results) f CROSS JOIN (SELECT DISTINCT peak_label FROM long_results) p LEFT JOIN long_results r ON r.ms_file_label = f.ms_file_label AND r.peak_label = p.peak_label) SELECT round(sum(v), 4) AS variance, 1.0::DOUBLE AS ratio FROM (SELECT peak_label, var_samp(m) AS v FROM cells GROUP BY 1)", "long_results")
def i8m(spark: SparkSession, d: str) -> DataFrame:
    scores, parts, _ = A.matrix_pca(V.long_results(spark, d), "m", KINDS)
    own = scores.select(F.posexplode("scores").alias("k", "x")).groupBy("k").agg(F.var_samp("x").alias("v"))
    return own.agg(F.round(F.sum("v"), 4).alias("variance")).crossJoin(parts.agg(F.round(F.max("cumulative"), 9).alias("ratio")))


@query("i8_matrix_pca")
def i8p(spark: SparkSession, d: str) -> DataFrame:
    scores, parts, _ = A.matrix_pca(V.long_results(spark, d), "m", KINDS)
    rows = scores.select("ms_file_label", F.posexplode("scores").alias("k", "score"))
    return rows.join(parts, F.col("k") + 1 == F.col("component")).select("ms_file_label", "component", F.round("score", 6).alias("score"), F.round("ratio", 9).alias("ratio"), F.round("cumulative", 9).alias("cumulative"))


@query("i9_matrix_loading")
def i9m(spark: SparkSession, d: str) -> DataFrame:
    return A.matrix_pca(V.long_results(spark, d), "m", KINDS)[2]


@query("i10_group_summary", "SELECT peak_label, sample_type, round(avg(v), 4) AS mean, round(stddev_samp(v) / sqrt(count(v)), 4) AS sem, count(v) AS n FROM long_results JOIN users USING (ms_file_label) GROUP BY 1, 2", "long_results users")
def i10(spark: SparkSession, d: str) -> DataFrame:
    out = A.group_summary(V.long_results(spark, d).join(V.users(spark, d), "ms_file_label"), "v", ["peak_label", "sample_type"])
    return out.withColumns({"mean": F.round("mean", 4), "sem": F.round("sem", 4)})


@query("i11_welch_t_test")
def i11(spark: SparkSession, d: str) -> DataFrame:
    return A.welch_t_test(V.long_results(spark, d).join(V.users(spark, d), "ms_file_label"), "v", "color")


@query("i12_anova")
def i12(spark: SparkSession, d: str) -> DataFrame:
    return A.anova(V.long_results(spark, d).join(V.users(spark, d), "ms_file_label"), "v", "sample_type")


WELCH = """WITH g AS (SELECT peak_label, color, count(v) AS n, avg(v) AS m, var_samp(v) / count(v) AS e FROM long_results JOIN users USING (ms_file_label) GROUP BY 1, 2)
    SELECT a.peak_label, round((a.m - b.m) / sqrt(a.e + b.e), 6) AS t, round((a.e + b.e) * (a.e + b.e) / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)), 4) AS df FROM g a JOIN g b ON a.peak_label = b.peak_label AND a.color < b.color WHERE a.n >= 2 AND b.n >= 2"""


@query("i11_welch_statistic", WELCH, "long_results users")
def i11b(spark: SparkSession, d: str) -> DataFrame:
    return i11(spark, d).select("peak_label", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("i12_anova_statistic", """WITH r AS (SELECT * FROM long_results JOIN users USING (ms_file_label)), g AS (SELECT peak_label, sample_type, count(v) AS n, avg(v) AS m FROM r GROUP BY 1, 2), t AS (SELECT peak_label, avg(v) AS grand, count(v) AS n FROM r GROUP BY 1),
    b AS (SELECT peak_label, sum(g.n * (m - grand) * (m - grand)) AS ssb, count(*) AS k FROM g JOIN t USING (peak_label) GROUP BY 1), w AS (SELECT r.peak_label, sum((v - g.m) * (v - g.m)) AS ssw FROM r JOIN g ON r.peak_label = g.peak_label AND r.sample_type = g.sample_type GROUP BY 1)
    SELECT peak_label, round((ssb / (k - 1)) / (ssw / (t.n - k)), 6) AS f FROM b JOIN w USING (peak_label) JOIN t USING (peak_label)""", "long_results users")
def i12b(spark: SparkSession, d: str) -> DataFrame:
    return i12(spark, d).select("peak_label", F.round("f", 6).alias("f"))


@query("i13_distribution_span", "SELECT peak_label, round(quantile_cont(intensity, 0.01), 6) AS q01, round(quantile_cont(intensity, 0.99), 6) AS q99 FROM trace_points GROUP BY 1", "trace_points")
def i13(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution_span(V.trace_points(spark, d), "intensity", ["peak_label"]).select("peak_label", F.round("q01", 6).alias("q01"), F.round("q99", 6).alias("q99"))


@query("i14_qc_series", f"SELECT peak_label, ms_file_label, coalesce(nullif(group_1, ''), 'group_1 (unset)') AS grp, CAST(row_number() OVER (PARTITION BY peak_label ORDER BY acquisition_datetime ASC NULLS LAST, ms_file_label) AS INTEGER) AS number, round({Z}, 6) AS y FROM long_results JOIN users USING (ms_file_label) WINDOW w AS (PARTITION BY peak_label)", "long_results users")
def i14(spark: SparkSession, d: str) -> DataFrame:
    return A.qc_series(V.long_results(spark, d), V.users(spark, d), "v").select("peak_label", "ms_file_label", F.col("group").alias("grp"), "number", F.round("normalized", 6).alias("y"))


@query("i15_color_map", "WITH g AS (SELECT coalesce(nullif(group_1, ''), 'group_1 (unset)') AS grp, min(CASE WHEN group_1 = 'g1' THEN color END) AS own, count(*) AS n FROM samples GROUP BY 1) SELECT grp, n, CASE WHEN row_number() OVER (ORDER BY n DESC, grp) = 1 THEN '#BBBBBB' ELSE coalesce(own, CASE (dense_rank() OVER (ORDER BY grp) - 1) % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END) END AS color FROM g", "samples")
def i15(spark: SparkSession, d: str) -> DataFrame:
    rows = V.samples(spark, d).withColumn("color", F.when(F.col("group_1") == "g1", F.col("color")))
    return A.color_map(rows, "group_1", ["red", "green", "blue"], grey_largest=True).withColumnRenamed("group", "grp")


@query("i16_sample_distances", "WITH r AS (SELECT peak_label, ms_file_label, n::DOUBLE AS n FROM long_results WHERE peak_label < 'p' OR ms_file_label < 'U5'), l AS (SELECT peak_label, sum(n * n) AS nn FROM r GROUP BY 1), dots AS (SELECT x.peak_label AS a, y.peak_label AS b, sum(x.n * y.n) AS dot FROM r x JOIN r y ON x.ms_file_label = y.ms_file_label AND x.peak_label < y.peak_label GROUP BY 1, 2) SELECT x.peak_label AS a, y.peak_label AS b, round(sqrt(greatest(x.nn + y.nn - 2 * coalesce(dot, 0), 0)), 6) AS distance FROM l x JOIN l y ON x.peak_label < y.peak_label LEFT JOIN dots ON dots.a = x.peak_label AND dots.b = y.peak_label", "long_results")
def i16(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d).filter("peak_label < 'p' OR ms_file_label < 'U5'").withColumn("n", F.col("n").cast("double"))
    return A.sample_distances(rows, "peak_label", "ms_file_label", "n", digits=6)


# All files over all peaks.
@query("i16_file_distances", "WITH l AS (SELECT ms_file_label, sum(n * n) AS nn FROM long_results GROUP BY 1), dots AS (SELECT x.ms_file_label AS a, y.ms_file_label AS b, sum(x.n * y.n) AS dot FROM long_results x JOIN long_results y ON x.peak_label = y.peak_label AND x.ms_file_label < y.ms_file_label GROUP BY 1, 2) SELECT x.ms_file_label AS a, y.ms_file_label AS b, round(sqrt(greatest(x.nn + y.nn - 2 * coalesce(dot, 0), 0)), 6) AS distance FROM l x JOIN l y ON x.ms_file_label < y.ms_file_label LEFT JOIN dots ON dots.a = x.ms_file_label AND dots.b = y.ms_file_label", "long_results")
def i16_files(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d).withColumn("n", F.col("n").cast("double"))
    return A.sample_distances(rows, "ms_file_label", "peak_label", "n", digits=6)


# ------------------------------------------------------------------ J
# Standards: every file whose number of points is even, with a concentration that follows the signal.
STD = "std AS (SELECT peak_label, ms_file_label AS ms_file, exp(0.9 * ln(v) + (n % 3) / 10.0)::DOUBLE AS std_conc FROM long_results WHERE n % 2 = 0), train AS (SELECT r.peak_label, r.ms_file_label AS ms_file, r.v AS value, s.std_conc FROM long_results r JOIN std s ON s.peak_label = r.peak_label AND s.ms_file = r.ms_file_label)"


def standards(spark: SparkSession, d: str) -> DataFrame:
    conc = F.exp(F.log("v") * 0.9 + (F.col("n") % 3) / 10.0)
    return V.long_results(spark, d).filter("n % 2 = 0").select("peak_label", F.col("ms_file_label").alias("ms_file"), conc.alias("std_conc"))


def training(spark: SparkSession, d: str) -> DataFrame:
    return J.training_set(V.long_results(spark, d), standards(spark, d), "v")


@query("j1_common_peaks", f"WITH {STD} SELECT DISTINCT peak_label FROM std", "long_results")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return J.common_peaks(V.long_results(spark, d), standards(spark, d))


@query("j2_melt_standards", "SELECT peak_label, k AS ms_file, CASE k WHEN 'a' THEN n::DOUBLE ELSE m END AS std_conc FROM (SELECT ms_file_label AS peak_label, n, m FROM long_results) CROSS JOIN (VALUES ('a'), ('b')) t(k)", "long_results")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return J.melt_standards(V.long_results(spark, d).select(F.col("ms_file_label").alias("peak_label"), F.col("n").alias("a"), F.col("m").alias("b")))


@query("j3_training_set", f"WITH {STD} SELECT peak_label, ms_file, round(value, 4) AS value, round(std_conc, 6) AS std_conc FROM train", "long_results")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return training(spark, d).withColumns({"value": F.round("value", 4), "std_conc": F.round("std_conc", 6)})


def _fit(spark: SparkSession, d: str, mode: str) -> DataFrame:
    point = F.struct(F.log("std_conc").alias("y"), F.log("value").alias("x"))
    rows = training(spark, d).groupBy("peak_label").agg(F.array_sort(F.collect_list(point)).alias("p")).select("peak_label", J.fit(F.col("p"), mode, (0.95, 1.15)).alias("f"))
    return rows.select("peak_label", *[F.round(f"f.{c}", 6).alias(c) for c in ("slope", "intercept", "residual")])


def _fit_sql(slope: str, over: str) -> str:
    return f"""WITH {STD}, p AS (SELECT peak_label, ln(value) AS x, ln(std_conc) AS y FROM train), s AS (SELECT peak_label, {slope} AS slope, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1)
        SELECT peak_label, round(any_value(slope), 6) AS slope, round(any_value(my - slope * mx), 6) AS intercept, round(sum((y - (my - slope * mx) - slope * x) * (y - (my - slope * mx) - slope * x)) / ({over}), 6) AS residual FROM p JOIN s USING (peak_label) GROUP BY 1"""


@query("j4_fit_fixed_slope", _fit_sql("1.0::DOUBLE", "count(*) * count(*)"), "long_results")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, J.FIXED)


@query("j5_fit_free_slope", _fit_sql("regr_slope(y, x)", "count(*)"), "long_results")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, J.FREE)


@query("j6_fit_bounded_slope", _fit_sql("greatest(least(regr_slope(y, x), 1.15), 0.95)", "count(*) * count(*)"), "long_results")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, J.BOUNDED)


def _range_sql(mode: str, low: float = 0.0, high: float = 0.0) -> str:
    """CTEs of the linear range: points with running sums, the search as a recursion over the ends, and each peak's last state."""
    slope = {"free": "CASE WHEN var = 0 THEN 1 ELSE cov / var END", "bounded": f"greatest(least(CASE WHEN var = 0 THEN 1 ELSE cov / var END, {high}), {low})"}[mode]
    over = "k" if mode == "free" else "k * k"
    return f"""
        pts AS (SELECT peak_label, ln(value) AS x, ln(std_conc) AS y FROM train WHERE value > 1e-11 AND std_conc > 1e-11),
        mid AS (SELECT peak_label, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts GROUP BY 1),
        c AS (SELECT peak_label, row_number() OVER w AS i, x - mx AS x, y - my AS y, x AS x0, y AS y0, sum(x - mx) OVER w AS sx, sum(y - my) OVER w AS sy, sum((x - mx) * (x - mx)) OVER w AS sxx, sum((x - mx) * (y - my)) OVER w AS sxy, sum((y - my) * (y - my)) OVER w AS syy
              FROM pts JOIN mid USING (peak_label) WINDOW w AS (PARTITION BY peak_label ORDER BY y, x ROWS UNBOUNDED PRECEDING)),
        ends(peak_label, lo, hi) AS (
          SELECT peak_label, CAST(1 AS BIGINT), n FROM mid WHERE n > 2
          UNION ALL
          SELECT peak_label, CASE WHEN e1 > e2 THEN lo + 1 ELSE lo END, CASE WHEN e1 > e2 THEN hi ELSE hi - 1 END FROM (
            SELECT *, (a_y - icpt - slope * a_x) * (a_y - icpt - slope * a_x) AS e1, (b_y - icpt - slope * b_x) * (b_y - icpt - slope * b_x) AS e2,
                   (syy + k * icpt * icpt + slope * slope * sxx - 2 * icpt * sy - 2 * slope * sxy + 2 * slope * icpt * sx) / ({over}) AS residual FROM (
              SELECT *, (sy - slope * sx) / k AS icpt FROM (SELECT *, {slope} AS slope FROM (SELECT *, sxx - sx * sx / k AS var, sxy - sx * sy / k AS cov FROM (
                SELECT e.peak_label, lo, hi, CAST(hi - lo + 1 AS DOUBLE) AS k, a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y, b.sx - a.sx + a.x AS sx, b.sy - a.sy + a.y AS sy, b.sxx - a.sxx + a.x * a.x AS sxx, b.sxy - a.sxy + a.x * a.y AS sxy, b.syy - a.syy + a.y * a.y AS syy
                FROM ends e JOIN c a ON a.peak_label = e.peak_label AND a.i = lo JOIN c b ON b.peak_label = e.peak_label AND b.i = hi)))))
          WHERE (residual > 0.01 OR e1 > 0.2 OR e2 > 0.2) AND k > 3
        ),
        last AS (SELECT peak_label, max(lo) AS lo, min(hi) AS hi FROM ends GROUP BY 1),
        kept AS (SELECT c.peak_label, x0 AS x, y0 AS y FROM c LEFT JOIN last USING (peak_label) WHERE lo IS NULL OR i BETWEEN lo AND hi),
        sums AS (SELECT peak_label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS var, covar_pop(x, y) AS cov, min(y) AS y_min, max(y) AS y_max FROM kept GROUP BY 1),
        lines AS (SELECT *, CASE WHEN n > 2 THEN {slope} ELSE 1 END AS slope FROM sums),
        fitted AS (SELECT *, CASE WHEN n > 2 THEN my - slope * mx ELSE 0 END AS intercept FROM lines),
        errors AS (SELECT k.peak_label, sum((y - intercept - slope * x) * (y - intercept - slope * x)) AS sse FROM kept k JOIN fitted USING (peak_label) GROUP BY 1),
        found AS (SELECT peak_label, slope, intercept, y_min AS lin_range_min, y_max AS lin_range_max, n AS n_points, CASE WHEN n > 2 THEN sse / ({over.replace("k", "n")}) ELSE 0 END AS residual FROM fitted JOIN errors USING (peak_label))
    """


@query("j7_linear_range", f"WITH RECURSIVE {STD}, {_range_sql('free')} SELECT peak_label, m.n, n_points AS n_kept, round(residual, 8) AS residual FROM found JOIN mid m USING (peak_label)", "long_results")
def j7(spark: SparkSession, d: str) -> DataFrame:
    point = F.struct(F.log("std_conc").alias("y"), F.log("value").alias("x"))
    rows = training(spark, d).groupBy("peak_label").agg(F.array_sort(F.collect_list(point)).alias("p"))
    rows = rows.select("peak_label", F.size("p").cast("long").alias("n"), J.linear_range(F.col("p"), J.FREE).alias("r"))
    return rows.select("peak_label", "n", F.size("r.points").cast("long").alias("n_kept"), F.round("r.fit.residual", 8).alias("residual"))


def curves(spark: SparkSession, d: str) -> DataFrame:
    return J.calibration_curves(training(spark, d), J.FREE)


@query("j8_calibration_curves", f"WITH RECURSIVE {STD}, {_range_sql('free')} SELECT peak_label, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(lin_range_min, 8) AS lin_range_min, round(lin_range_max, 8) AS lin_range_max, n_points, round(residual, 8) AS residual, round(exp(lin_range_min), 4) AS lloq, round(exp(lin_range_max), 4) AS uloq FROM found", "long_results")
def j8(spark: SparkSession, d: str) -> DataFrame:
    out = curves(spark, d).withColumn("n_points", F.col("n_points").cast("long"))
    return out.withColumns({c: F.round(c, n) for c, n in (("slope", 6), ("intercept", 6), ("lin_range_min", 8), ("lin_range_max", 8), ("residual", 8), ("lloq", 4), ("uloq", 4))})


# Curves that SQL knows too: slope 1, intercept and range from a peak's own values.
CURVES = "curves AS (SELECT peak_label, 1.0::DOUBLE AS slope, -1.0::DOUBLE AS intercept, ln(min(v)) AS lin_range_min, ln(max(v)) - 1.5 AS lin_range_max, min(v) AS lloq, max(v) AS uloq FROM long_results GROUP BY 1)"


def plain_curves(spark: SparkSession, d: str) -> DataFrame:
    rows = V.long_results(spark, d).groupBy("peak_label").agg(F.min("v").alias("lloq"), F.max("v").alias("uloq"))
    return rows.select("peak_label", F.lit(1.0).alias("slope"), F.lit(-1.0).alias("intercept"), F.log("lloq").alias("lin_range_min"), (F.log("uloq") - 1.5).alias("lin_range_max"), "lloq", "uloq")


PRED = "exp(slope * ln(value + 1e-12) + intercept)"


@query("j9_predict_concentration", f"WITH {CURVES}, x AS (SELECT peak_label, ms_file_label, v AS value FROM long_results) SELECT peak_label, ms_file_label, round({PRED}, 6) AS pred_conc, CASE WHEN {PRED} < exp(lin_range_min) OR {PRED} > exp(lin_range_max) THEN 0 ELSE 1 END AS in_range FROM x JOIN curves USING (peak_label)", "long_results")
def j9(spark: SparkSession, d: str) -> DataFrame:
    values = V.long_results(spark, d).select("peak_label", "ms_file_label", F.col("v").alias("value"))
    return J.predict_concentration(values, plain_curves(spark, d)).select("peak_label", "ms_file_label", F.round("pred_conc", 6).alias("pred_conc"), "in_range")


@query("j10_training_frame", f"WITH {STD}, {CURVES} SELECT peak_label, ms_file, round(CASE WHEN std_conc BETWEEN exp(lin_range_min - 1e-8) AND exp(lin_range_max + 1e-8) THEN std_conc END, 6) AS true_conc, round({PRED}, 6) AS pred_conc, CASE WHEN {PRED} < exp(lin_range_min) OR {PRED} > exp(lin_range_max) THEN 0 ELSE 1 END AS in_range FROM train JOIN curves USING (peak_label) WHERE value > 0", "long_results")
def j10(spark: SparkSession, d: str) -> DataFrame:
    out = J.training_frame(training(spark, d), plain_curves(spark, d))
    return out.select("peak_label", "ms_file", F.round("true_conc", 6).alias("true_conc"), F.round("pred_conc", 6).alias("pred_conc"), "in_range")


@query("j11_concentration_table", f"WITH {CURVES}, x AS (SELECT peak_label, ms_file_label, v AS value FROM long_results) SELECT peak_label, ms_file_label, round({PRED}, 6) AS pred_conc, unit FROM x JOIN curves USING (peak_label) LEFT JOIN (SELECT event_type AS peak_label, 'mM' AS unit FROM events WHERE event_type <> 'error' GROUP BY 1) USING (peak_label)", "long_results")
def j11(spark: SparkSession, d: str) -> DataFrame:
    values = V.long_results(spark, d).select("peak_label", "ms_file_label", F.col("v").alias("value"))
    units = V.trace_targets(spark, d).filter("peak_label <> 'error'").select("peak_label", F.lit("mM").alias("unit"))
    return J.concentration_table(J.predict_concentration(values, plain_curves(spark, d)), units).select("peak_label", "ms_file_label", F.round("pred_conc", 6).alias("pred_conc"), "unit")


# All outputs of the job in one long table: curves, concentrations and the training frame.
J12 = f"""WITH RECURSIVE {STD}, {_range_sql('bounded', 0.85, 1.15)},
    pred AS (SELECT peak_label, ms_file_label, exp(slope * ln(v + 1e-12) + intercept) AS p, exp(lin_range_min) AS lo, exp(lin_range_max) AS hi FROM long_results LEFT JOIN found USING (peak_label)),
    seen AS (SELECT t.peak_label, ms_file, std_conc, exp(slope * ln(value + 1e-12) + intercept) AS p, exp(lin_range_min - 1e-8) AS lo, exp(lin_range_max + 1e-8) AS hi FROM train t LEFT JOIN found USING (peak_label) WHERE value > 0)
    SELECT 'curve' AS kind, peak_label, 'n' || n_points AS name, round(slope, 5) AS a, round(intercept, 5) AS b FROM found
    UNION ALL SELECT 'concentration', peak_label, ms_file_label, round(p, 4), CASE WHEN p IS NULL THEN NULL WHEN p < lo OR p > hi THEN 0.0 ELSE 1.0 END FROM pred
    UNION ALL SELECT 'training', peak_label, ms_file, round(CASE WHEN std_conc BETWEEN lo AND hi THEN std_conc END, 4), round(p, 4) FROM seen"""


@query("j12_calibrate", J12, "long_results")
def j12(spark: SparkSession, d: str) -> DataFrame:
    done = J.calibrate(V.long_results(spark, d), standards(spark, d), "v", J.BOUNDED, (0.85, 1.15))
    curve = done["curves"].select(F.lit("curve").alias("kind"), "peak_label", F.concat(F.lit("n"), "n_points").alias("name"), F.round("slope", 5).alias("a"), F.round("intercept", 5).alias("b"))
    concentration = done["concentrations"].select(F.lit("concentration"), "peak_label", "ms_file_label", F.round("pred_conc", 4), F.col("in_range").cast("double"))
    seen = done["training"].select(F.lit("training"), "peak_label", "ms_file", F.round("true_conc", 4), F.round("pred_conc", 4))
    return curve.union(concentration).union(seen)
