"""Queries whose traces are thinned by largest-triangle-three-buckets, which SQL says as a recursion over buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators import extract as E
from ionlake.operators import rt as H
from ionlake.operators import traces as X
from ionlake.plans import views as V
from ionlake.plans.base import query
from ionlake.plans.extract_queries import EXISTING, MATCHED, TOP1, existing
from ionlake.plans.trace_queries import APEX, SHIFT


def lttb_sql(source: str, n: int, least: int | None = None) -> str:
    """CTEs up to ``thinned`` (peak_label, ms_file_label, t, y) of ``source`` (the same columns), a trace a row."""
    least = max(2 * n, 10) if least is None else least
    high = f"CASE WHEN k < {n - 3} THEN CAST(floor((k + 1) * w) AS BIGINT) + 1 ELSE size - 1 END"
    return f"""
        traced AS (SELECT *, CAST(len(t) AS BIGINT) AS size, (len(t) - 2)::DOUBLE / {n - 2}::DOUBLE AS w, len(t) > {n} AND len(t) >= {least} AS thin FROM {source}),
        picked(peak_label, ms_file_label, k, place) AS (
          SELECT peak_label, ms_file_label, 0, 0::BIGINT FROM traced WHERE thin
          UNION ALL
          SELECT peak_label, ms_file_label, k + 1, c[list_position(a, list_max(a))] FROM (
            SELECT *, list_transform(c, lambda j: abs((t[place + 1] - mt) * (y[j + 1] - y[place + 1]) - (t[place + 1] - t[j + 1]) * (my - y[place + 1]))) AS a FROM (
              SELECT *, range(low, high) AS c, list_avg(t[high + 1:after]) AS mt, list_avg(y[high + 1:after]) AS my FROM (
                SELECT p.*, t, y, CAST(floor(k * w) AS BIGINT) + 1 AS low, {high} AS high, CASE WHEN k < {n - 3} THEN least(CAST(floor((k + 2) * w) AS BIGINT) + 1, size) ELSE size END AS after
                FROM picked p JOIN traced USING (peak_label, ms_file_label) WHERE k < {n - 2})))
        ),
        kept_places AS (SELECT peak_label, ms_file_label, list(place ORDER BY place) AS places FROM picked GROUP BY 1, 2),
        thinned AS (
          SELECT d.peak_label, d.ms_file_label, CASE WHEN thin THEN list_transform(list_append(places, size - 1), lambda j: t[j + 1]) ELSE t END AS t, CASE WHEN thin THEN list_transform(list_append(places, size - 1), lambda j: y[j + 1]) ELSE y END AS y
          FROM traced d LEFT JOIN kept_places USING (peak_label, ms_file_label)
        )
    """


TEXT = "len(t) AS n, array_to_string(list_transform(t, lambda x: CAST(round(x * 10) AS BIGINT)), ',') AS times, array_to_string(list_transform(y, lambda x: CAST(round(x * 10) AS BIGINT)), ',') AS intensities"


def text(times: str = "scan_time", intensities: str = "intensity") -> list[F.Column]:
    said = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 10).cast("long").cast("string")), ",")
    return [F.size(times).cast("long").alias("n"), said(times).alias("times"), said(intensities).alias("intensities")]


@query("f1_lttb_points", f"WITH RECURSIVE given AS (SELECT peak_label, ms_file_label, scan_time AS t, intensity AS y FROM traces), {lttb_sql('given', 8, 9)} SELECT peak_label, ms_file_label, {TEXT} FROM thinned", "traces")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return X.lttb(V.traces(spark, d), 8, least=9).select("peak_label", "ms_file_label", *text())


FULL = f"""
    matched AS ({MATCHED}), top1 AS ({TOP1}), pairs AS ({EXISTING}),
    filled AS (
      SELECT t.peak_label, s.ms_file_label, s.scan_id, s.scan_time, coalesce(round(m.intensity, 0), 1) AS intensity
      FROM pairs t JOIN (SELECT DISTINCT ms_file_label, scan_id, scan_time FROM points) s USING (ms_file_label) LEFT JOIN top1 m ON m.peak_label = t.peak_label AND m.ms_file_label = s.ms_file_label AND m.scan_id = s.scan_id
    ),
    whole AS (SELECT peak_label, ms_file_label, list(scan_time ORDER BY scan_time, scan_id) AS t, list(intensity ORDER BY scan_time, scan_id) AS y FROM filled GROUP BY 1, 2)
"""


@query("e6_full_range_thinned", f"WITH RECURSIVE {FULL}, {lttb_sql('whole', 12)} SELECT peak_label, ms_file_label, {TEXT} FROM thinned", "points targets samples")
def e6(spark: SparkSession, d: str) -> DataFrame:
    points, targets = V.points(spark, d), V.targets(spark, d)
    out = E.extract_full_range(points, targets, E.pending_full_range(existing(spark, d), targets), E.scan_lookup(points), n=12)
    return out.select("peak_label", "ms_file_label", *text("scan_time_full_ds", "intensity_full_ds"))


@query(
    "f13_preview_thinned",
    f"""
    WITH RECURSIVE {APEX}, ref AS (SELECT peak_label, median(apex) AS reference FROM apex GROUP BY 1),
    moved AS (
      SELECT p.peak_label, p.ms_file_label, event_id, scan_time + coalesce(reference - apex, 0) AS t, intensity AS y, rt_min, rt_max
      FROM trace_points p JOIN trace_targets USING (peak_label) JOIN users u USING (ms_file_label) LEFT JOIN apex a ON a.peak_label = p.peak_label AND a.ms_file_label = p.ms_file_label LEFT JOIN ref r ON r.peak_label = p.peak_label WHERE u.use_for_processing
    ),
    cut AS (SELECT peak_label, ms_file_label, list(t ORDER BY t, event_id) AS t, list(y ORDER BY t, event_id) AS y FROM moved WHERE t BETWEEN rt_min - 2 AND rt_max + 2 GROUP BY 1, 2), {lttb_sql('cut', 4)}
    SELECT peak_label, ms_file_label, {TEXT} FROM thinned
    """,
    "trace_points trace_targets users",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    targets, users = V.trace_targets(spark, d), V.users(spark, d).filter("use_for_processing")
    return X.preview_traces(V.traces(spark, d), targets, users, H.rt_alignment(V.traces(spark, d), targets), n=4).select("peak_label", "ms_file_label", *text())


@query(
    "f16_built_thinned",
    f"""
    WITH RECURSIVE given AS (SELECT peak_label, ms_file_label, scan_time AS t, intensity AS y FROM traces), {lttb_sql('given', 5)},
    s AS (SELECT peak_label, ms_file_label, unnest(t) AS t, unnest(y) AS y, unnest(range(1, len(t) + 1)) AS k FROM thinned),
    g AS (SELECT *, y > 20 AS sig, k - row_number() OVER (PARTITION BY peak_label, ms_file_label, y > 20 ORDER BY k) AS island FROM s),
    r AS (SELECT *, sig AND count(*) OVER (PARTITION BY peak_label, ms_file_label, sig, island) >= 3 AS run FROM g),
    kept AS (SELECT *, run OR coalesce(lag(run) OVER w, false) OR coalesce(lead(run) OVER w, false) AS keep FROM r WINDOW w AS (PARTITION BY peak_label, ms_file_label ORDER BY k))
    SELECT k.peak_label, k.ms_file_label, count(*) AS n, round(sum(k.t + {SHIFT}), 2) AS total, round(sum(k.y), 4) AS signal FROM kept k JOIN users u USING (ms_file_label) WHERE keep GROUP BY 1, 2
    """,
    "traces users",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    made = X.build_traces(V.traces(spark, d).join(V.users(spark, d), "ms_file_label"), F.length("group_1") * 0.5, n=5, baseline=20.0, width=3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return made.select("peak_label", "ms_file_label", F.size("scan_time").cast("long").alias("n"), F.round(total("scan_time"), 2).alias("total"), F.round(total("intensity"), 4).alias("signal"))
