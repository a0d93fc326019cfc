"""Array functions on chromatograms (section F and D4).

A trace is a row with ``scan_time`` and ``intensity`` arrays in time order. Everything but
the triangle downsampling is a Catalyst expression on the arrays: no explode, no shuffle.
Null arrays give null results, empty arrays empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_lists(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One array per value column, by ``order``; nulls stay in their places."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values])))
    out = rows.groupBy(*keys).agg(items.alias("_items"))
    return out.select(*keys, *[F.col(f"_items._{v}").alias(v) for v in values])


def pairs(scan_time: Column | str = "scan_time", intensity: Column | str = "intensity") -> Column:
    time, value = (F.col(c) if isinstance(c, str) else c for c in (scan_time, intensity))
    return F.zip_with(time, value, lambda t, i: F.struct(t.alias("t"), i.alias("i")))


def slice_window(low: Column, high: Column, trace: Column | None = None) -> Column:
    """array<struct<t, i>> of the points with low <= t <= high."""
    return F.filter(pairs() if trace is None else trace, lambda p: (p["t"] >= low) & (p["t"] <= high))


def first_max(values: Column) -> Column:
    """1-based place of the first largest value; null if there is none."""
    at = F.array_position(values, F.array_max(values))
    return F.when(at > 0, at)


def threshold_slice(trace: Column, threshold: Column | None = None) -> list[Column]:
    """n, top (max * 1.1), lowest, first and last time of the points not below the threshold."""
    kept = trace if threshold is None else F.filter(trace, lambda p: threshold.isNull() | (p["i"] >= threshold))
    i, t = F.transform(kept, lambda p: p["i"]), F.transform(kept, lambda p: p["t"])
    return [F.size(kept).alias("n"), (F.array_max(i) * 1.1).alias("y_max"), F.array_min(i).alias("y_min"), F.array_min(t).alias("t_min"), F.array_max(t).alias("t_max")]


def shift_trace(scan_time: Column, shift: Column) -> Column:
    """F8: every time plus the file's shift (null counts as 0)."""
    return F.transform(scan_time, lambda t: t + F.coalesce(shift, F.lit(0.0)))


def stride_downsample(values: Column, n: int = 50) -> Column:
    """over n values become the n at int(k * len / n)."""
    taken = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(values, F.floor(k * F.size(values) / n).cast("int")))
    return F.when(F.size(values) > n, taken).otherwise(values)


def sparsify(trace: Column, baseline: float = 1.0, eps: float = 0.0, width: int = 3, around: int = 1) -> Column:
    """points of runs above the baseline at least ``width`` long, and ``around`` neighbours of each.

    The signal is a string of 0 and 1; patterns with bounded look-around clear its short
    runs and mark neighbours, in time linear in the trace.
    """
    mask = F.array_join(F.transform(trace, lambda p: F.when(p["i"] > baseline + eps, "1").otherwise("0")), "")
    for n in range(1, width):
        mask = F.regexp_replace(mask, f"(?<!1)1{{{n}}}(?!1)", "0" * n)
    if around > 0:
        mask = F.regexp_replace(mask, f"0(?=0{{0,{around - 1}}}1)|(?<=10{{0,{around - 1}}})0", "2")
    marked = F.zip_with(trace, F.split(mask, ""), lambda p, x: F.struct(p.alias("p"), x.alias("x")))
    return F.when(F.size(trace) > 0, F.transform(F.filter(marked, lambda z: z["x"].isin("1", "2")), lambda z: z["p"])).otherwise(trace)


def y_range(trace: Column, low: Column, high: Column) -> list[Column]:
    """[min(0, smallest), largest * 1.05] in the window, and its logarithmic form."""
    i = F.transform(slice_window(low, high, trace), lambda p: p["i"])
    above = F.slice(F.array_sort(F.filter(i, lambda x: x > 1.0001)), 1, 5)
    middle = F.size(above)
    median = F.when(middle > 0, (F.get(above, F.floor((middle - 1) / 2).cast("int")) + F.get(above, F.floor(middle / 2).cast("int"))) / 2)
    return [
        F.least(F.lit(0.0), F.array_min(i)).alias("y_min"), (F.array_max(i) * 1.05).alias("y_max"),
        F.log10(median).alias("log_min"), F.when(F.array_max(i) > 0, F.log10(F.array_max(i) * 1.05)).alias("log_max"),
    ]


def log2p1(x: Column) -> Column:
    """F11."""
    return F.log2(x + 1)


def array_to_string(values: Column) -> Column:
    """comma list."""
    return F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))


def lttb_points(t: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Places that largest-triangle-three-buckets keeps (Steinarsson 2013)."""
    size = len(t)
    width = (size - 2) / (n - 2)
    edges = np.floor(np.arange(n - 1) * width).astype(np.int64) + 1
    out = np.zeros(n, np.int64)
    out[-1] = size - 1
    at = 0
    for k in range(n - 2):
        low, high = edges[k], edges[k + 1] if k < n - 3 else size - 1
        after = slice(high, min(edges[k + 2], size) if k < n - 3 else size)
        mean_t, mean_y = t[after].mean(), y[after].mean()
        area = np.abs((t[at] - mean_t) * (y[low:high] - y[at]) - (t[at] - t[low:high]) * (mean_y - y[at]))
        at = low + int(np.argmax(area))
        out[k + 1] = at
    return out


def lttb(rows: DataFrame, n: int = 1000, time_col: str = "scan_time", value_col: str = "intensity", least: int | None = None) -> DataFrame:
    """traces of over n points, and at least max(2n, 10), come down to n; all other columns stay."""
    least = max(2 * n, 10) if least is None else least
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(names.index(c)) for c in (time_col, value_col)]
            sizes = [c.value_lengths().fill_null(0).to_numpy() for c in lists]
            times, values = (c.flatten() for c in lists)
            t, y = (np.asarray(v.to_numpy(zero_copy_only=False), float) for v in (times, values))
            start = np.cumsum(sizes[0]) - sizes[0]
            keep = np.ones(len(t), bool)
            if len(t) == len(y):
                for k in np.flatnonzero((sizes[0] == sizes[1]) & (sizes[0] > n) & (sizes[0] >= least)):
                    part = slice(start[k], start[k] + sizes[0][k])
                    keep[part] = False
                    keep[start[k] + lttb_points(t[part], np.nan_to_num(y[part]), n)] = True
            if keep.all():
                yield batch
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([start, [len(t)]])], pa.int32())
            columns = list(batch.columns)
            for name, old, flat in zip((time_col, value_col), lists, (times, values), strict=True):
                columns[names.index(name)] = pa.ListArray.from_arrays(offsets, flat.filter(pa.array(keep)), type=old.type, mask=old.is_null())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows if n <= 2 else rows.mapInArrow(run, rows.schema)


def has_visible_points(traces: DataFrame, keys: list[str], baseline: float = 1.0, width: int = 3) -> DataFrame:
    """whether any point of a key's traces is left after sparsifying."""
    return traces.withColumn("_seen", F.size(sparsify(pairs(), baseline, 0.0, width)) > 0).groupBy(*keys).agg(F.bool_or("_seen").alias("visible"))


def top_contrast_samples(traces: DataFrame, n: int = 5) -> DataFrame:
    """per peak the n files with the largest max - min of intensity, ties by file.

    The n best of each part of a peak's files are ranked, at most 256 n: no task sorts all files of a peak.
    """
    span = (F.array_max("intensity") - F.array_min("intensity")).alias("contrast")
    spans = traces.select("peak_label", "ms_file_label", span)
    order = [F.desc_nulls_last("contrast"), F.col("ms_file_label")]
    parts = spans.withColumn("_part", F.pmod(F.xxhash64("ms_file_label"), F.lit(256)))
    near = parts.withColumn("_own", F.row_number().over(Window.partitionBy("peak_label", "_part").orderBy(*order))).filter(F.col("_own") <= n)
    place = F.row_number().over(Window.partitionBy("peak_label").orderBy(*order))
    return near.withColumn("place", place).filter(F.col("place") <= n).select("peak_label", "ms_file_label", "contrast", "place")


def group_neighbors(samples: DataFrame, group: str, n: int = 10, seed: int = 0) -> DataFrame:
    """for each file, up to n others of its group (null is a group), by a hash of the file.

    Each group is ranked once by hash; a file's neighbours are the n after it in that order,
    wrapping round, so the work is n per file whatever the group's size.
    """
    from ionlake.operators.ranks import rank_in_group

    rows = samples.select("ms_file_label", F.col(group).alias("_g")).withColumnRenamed("_g", group)
    sizes = rows.groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rank_in_group(rows, [group], [F.xxhash64("ms_file_label", F.lit(seed)), F.col("ms_file_label")], "_at1")
    rows = rows.join(sizes, F.col(group).eqNullSafe(F.col("_of"))).withColumn("_k", F.col("_at1") - 1).drop("_of", "_at1")
    steps = F.explode(F.sequence(F.lit(1), F.least(F.lit(n), (F.col("_n") - 1).cast("int"))))
    asks = rows.filter("_n > 1").select(F.col("ms_file_label").alias("of"), F.col(group).alias("_g"), "_k", "_n", steps.alias("_step"))
    asks = asks.select("of", "_g", ((F.col("_k") + F.col("_step")) % F.col("_n")).alias("_at"))
    answers = rows.select(F.col(group).alias("_h"), F.col("_k").alias("_there"), F.col("ms_file_label").alias("neighbor"))
    return asks.join(answers, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_at") == F.col("_there"))).select("of", "neighbor")


def preview_slice(traces: DataFrame, targets: DataFrame, samples: DataFrame, around: float = 2.0) -> DataFrame:
    """the traces of the given targets and samples, cut to the target's window and ``around`` seconds on both sides; empty ones go.

    ``targets`` may be one page of a list; its other columns stay.
    """
    rows = traces.join(targets.select("peak_label", "rt_min", "rt_max"), "peak_label").join(samples.select("ms_file_label").distinct(), "ms_file_label", "left_semi")
    rows = rows.withColumn("_w", slice_window(F.col("rt_min") - around, F.col("rt_max") + around)).filter(F.size("_w") > 0)
    return rows.withColumns({"scan_time": F.col("_w.t"), "intensity": F.col("_w.i")}).drop("_w")


def preview_traces(traces: DataFrame, targets: DataFrame, samples: DataFrame, shifts: DataFrame | None = None, ms_type: str = "ms1", around: float = 2.0, n: int = 100) -> DataFrame:
    """what a preview draws: traces moved by their stored shift, cut to the window, thinned (ms1 to n points, ms2 sparsified).

    Adds for each target ``top`` and ``least_positive`` (for the axis) and orders files by ``place``:
    larger sample types first, then by type and file. ``shifts`` has peak_label, ms_file_label, shift.
    """
    if shifts is not None:
        rows = traces.join(shifts.select("peak_label", "ms_file_label", F.col("shift").alias("_shift")), ["peak_label", "ms_file_label"], "left")
        traces = rows.withColumn("scan_time", shift_trace(F.col("scan_time"), F.col("_shift"))).drop("_shift")
    cut = preview_slice(traces, targets, samples, around).select("peak_label", "ms_file_label", "scan_time", "intensity")
    if ms_type == "ms1":
        thin = lttb(cut, n)
    else:
        thin = cut.withColumn("_s", sparsify(pairs(), baseline=10.0, width=1)).withColumns({"scan_time": F.col("_s.t"), "intensity": F.col("_s.i")}).drop("_s")
    own = samples.select("ms_file_label", "sample_type").distinct()
    thin = thin.join(own, "ms_file_label")
    sizes = thin.groupBy("peak_label", "sample_type").agg(F.count(F.lit(1)).alias("n_of_type"))
    axis = thin.groupBy("peak_label").agg(F.max(F.array_max("intensity")).alias("top"), F.min(F.array_min(F.filter("intensity", lambda x: x > 0))).alias("least_positive"))
    out = thin.join(sizes, (thin["peak_label"] == sizes["peak_label"]) & thin["sample_type"].eqNullSafe(sizes["sample_type"])).drop(sizes["peak_label"]).drop(sizes["sample_type"])
    place = F.struct((-F.col("n_of_type")).alias("n"), "sample_type", "ms_file_label")
    return out.join(axis, "peak_label").withColumn("place", place).drop("n_of_type")


def build_traces(traces: DataFrame, shift: Column | None = None, n: int | None = None, baseline: float = 1.0, width: int = 1) -> DataFrame:
    """F16: traces for line plots: thinned to n points if asked, sparsified, then moved by ``shift``; traces with nothing left go."""
    rows = traces if n is None else lttb(traces, n)
    rows = rows.withColumn("_s", sparsify(pairs(), baseline=baseline, width=width)).filter(F.size("_s") > 0)
    rows = rows.withColumns({"scan_time": F.col("_s.t"), "intensity": F.col("_s.i")}).drop("_s")
    return rows if shift is None else rows.withColumn("scan_time", shift_trace(F.col("scan_time"), shift))
