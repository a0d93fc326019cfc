"""Peak metrics of chromatograms (section G).

``peak_metrics`` works inside the row: higher-order functions on the sliced arrays, no
explode, no shuffle. ``peak_properties`` is the relational form with windows; the two agree
where both are defined and differ where the data model says so (empty windows, median).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.operators.traces import first_max, pairs, slice_window

PAIR = ["peak_label", "ms_file_label"]


def rt_shift_for_file(shifts_json: Column, file: Column) -> Column:
    """G1: the file's number in a JSON object of file -> shift; missing or not a number is 0."""
    found = F.from_json(shifts_json, "map<string,string>")
    return F.coalesce(F.try_element_at(found, file).try_cast("double"), F.lit(0.0))


def trapezoid(t: Column, i: Column) -> Column:
    """Area under the points, 0 for less than two."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    ahead = F.zip_with(F.slice(t, 2, n), F.slice(i, 2, n), lambda a, b: F.struct(a.alias("t"), b.alias("i")))
    here = F.zip_with(F.slice(t, 1, n), F.slice(i, 1, n), lambda a, b: F.struct(a.alias("t"), b.alias("i")))
    parts = F.zip_with(here, ahead, lambda a, b: (a["i"] + b["i"]) / 2.0 * (b["t"] - a["t"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def peak_metrics(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """The metrics of each row's window, with the sliced arrays; other columns stay.

    The row of an empty window stays: area, max, min, mean and median 0, n 0, the others null.
    """
    r0 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 0)
    out = rows.withColumn("_w", slice_window(low, high)).withColumn("_t", F.col("_w.t")).withColumn("_i", F.col("_w.i"))
    out = out.withColumn("_n", F.size("_i")).withColumn("_at", first_max(F.col("_i"))).withColumn("_max", F.array_max("_i"))
    # Half-even rounding of n / 2 + 1 picks the median's place, as the data model has it.
    median = F.get(F.array_sort("_i"), F.rint(F.col("_n") / 2 + 1).cast("int") - 1)
    # Added in order of time: another order may end on the other side of a half.
    top3 = F.coalesce(F.when(F.col("_at") > 1, F.get(F.col("_i"), (F.col("_at") - 2).cast("int"))), F.lit(0.0)) + F.col("_max") + F.coalesce(F.get(F.col("_i"), F.col("_at").cast("int")), F.lit(0.0))
    out = out.withColumns(
        {
            "peak_area": r0(trapezoid(F.col("_t"), F.col("_i"))),
            "peak_area_top3": F.round(top3, 0),
            "peak_max": r0(F.col("_max")),
            "peak_min": r0(F.array_min("_i")),
            "peak_mean": r0(F.when(F.col("_n") > 0, F.aggregate("_i", F.lit(0.0), lambda s, x: s + x) / F.col("_n"))),
            "peak_median": r0(median),
            "peak_n_datapoints": F.col("_n").cast("long"),
            "peak_rt_of_max": F.get(F.col("_t"), F.col("_at").cast("int") - 1),
            "window_time": F.col("_t"),
            "window_intensity": F.col("_i"),
        }
    )
    if "mz_arr" in rows.columns:
        place = F.array_position("intensity", F.col("peak_max"))
        out = out.withColumn("peak_mz_of_max", F.when(place > 0, F.get(F.col("mz_arr"), (place - 1).cast("int"))))
    return out.drop("_w", "_t", "_i", "_n", "_at", "_max")


def file_shifts(targets: DataFrame) -> DataFrame:
    """(peak_label, ms_file_label, shift) of targets with ``rt_align_shifts``, a map or a JSON object of file -> shift; what isn't a number goes."""
    shifts = F.col("rt_align_shifts") if dict(targets.dtypes)["rt_align_shifts"].startswith("map") else F.from_json("rt_align_shifts", "map<string,string>")
    rows = targets.select("peak_label", F.explode(shifts).alias("ms_file_label", "_text"))
    return rows.select("peak_label", "ms_file_label", F.col("_text").try_cast("double").alias("shift")).filter("shift IS NOT NULL")


def integrate(chromatograms: DataFrame, targets: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """Metrics of every chromatogram in its target's window, moved by the file's shift.

    ``targets`` has peak_label, rt_min, rt_max and, if aligned, rt_align_enabled; the shifts are
    ``shifts`` (peak_label, ms_file_label, shift) or else the targets' rt_align_shifts. They are
    joined as rows, so a chromatogram carries its own shift only. A file without one has 0.
    """
    columns = targets.columns
    if shifts is None and "rt_align_shifts" in columns:
        shifts = file_shifts(targets)
    aligned = F.coalesce("rt_align_enabled", F.lit(False)) if "rt_align_enabled" in columns else F.lit(shifts is not None)
    chosen = targets.select("peak_label", "rt_min", "rt_max", aligned.alias("rt_aligned"))
    rows = chromatograms.join(chosen, "peak_label")
    if shifts is None:
        rows = rows.withColumns({"rt_aligned": F.lit(False), "rt_shift": F.lit(0.0)})
    else:
        moved = shifts.select(*PAIR, F.col("shift").alias("_shift"))
        rows = rows.join(moved, PAIR, "left").withColumn("rt_shift", F.when(F.col("rt_aligned"), F.coalesce("_shift", F.lit(0.0))).otherwise(F.lit(0.0))).drop("_shift")
    return peak_metrics(rows, F.col("rt_min") - F.col("rt_shift"), F.col("rt_max") - F.col("rt_shift"))


def peak_properties(chromatograms: DataFrame, targets: DataFrame, samples: DataFrame, bookmarked: bool = False) -> DataFrame:
    """The relational form; pairs with empty windows are not in the result."""
    chosen = targets.filter("rt_min IS NOT NULL AND rt_max IS NOT NULL")
    if bookmarked:
        chosen = chosen.filter("bookmark")
    used = samples.filter("use_for_processing").select("ms_file_label")
    rows = chromatograms.join(chosen.select("peak_label", "rt_min", "rt_max"), "peak_label").join(used, "ms_file_label", "left_semi")
    points = rows.select(*PAIR, "rt_min", "rt_max", F.posexplode(pairs()).alias("pos", "p")).select(*PAIR, "pos", "rt_min", "rt_max", F.col("p.t").alias("t"), F.col("p.i").alias("i"))
    inside = F.col("t").between(F.col("rt_min"), F.col("rt_max"))
    order = Window.partitionBy(*PAIR, "inside").orderBy("t", "pos")
    points = points.withColumn("inside", inside)
    points = points.withColumns({"before": F.lag("i").over(order), "after": F.lead("i").over(order), "after_t": F.lead("t").over(order)})
    area = F.coalesce((F.col("i") + F.col("after")) / 2.0 * (F.col("after_t") - F.col("t")), F.lit(0.0))
    top3 = F.col("i") + F.coalesce("before", F.lit(0.0)) + F.coalesce("after", F.lit(0.0))
    best = F.max(F.when(F.col("inside"), F.struct("i", (-F.col("t")).alias("nt"), (-F.col("pos")).alias("np"), top3.alias("top3"))))
    win = lambda c: F.when(F.col("inside"), c)
    # Summed to six decimals, so that the order of the rows doesn't decide how a mean halfway is rounded.
    mean = F.sum(win(F.col("i").cast("decimal(28,6)"))).cast("double") / F.count(win(F.col("i")))
    out = points.groupBy(*PAIR).agg(
        F.sum("i").alias("total_intensity"), F.round(F.sum(win(area)), 0).alias("peak_area"), F.round(F.max(win(F.col("i"))), 0).alias("peak_max"), F.round(F.min(win(F.col("i"))), 0).alias("peak_min"),
        F.round(mean, 0).alias("peak_mean"), F.round(F.median(win(F.col("i"))), 0).alias("peak_median"), F.count(win(F.col("i"))).alias("peak_n_datapoints"), best.alias("_best"),
    )
    out = out.withColumns({"peak_area_top3": F.round("_best.top3", 0), "peak_rt_of_max": -F.col("_best.nt")})
    return out.filter("peak_n_datapoints > 0").drop("_best")
