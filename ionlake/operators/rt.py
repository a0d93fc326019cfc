"""Alignment and envelopes (section H) and the peak fit (G6, G7); combined traces and spans (H1 to H3) are in ``combined``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.operators.combined import combine_traces, optimize_rt_spans  # noqa: F401  (H1 to H3)
from ionlake.operators.traces import first_max, pairs, slice_window

# ------------------------------------------------------------------ H4-H7
def apex_time(low: Column, high: Column) -> Column:
    """Time of the first largest point in the window, or null."""
    w = slice_window(low, high)
    at = first_max(F.transform(w, lambda p: p["i"]))
    return F.get(F.transform(w, lambda p: p["t"]), (at - 1).cast("int"))


def rt_alignment(traces: DataFrame, targets: DataFrame) -> DataFrame:
    """H4: per peak and file the apex, the peak's reference (median apex) and the shift; no point in the window gives 0."""
    rows = traces.join(targets.select("peak_label", "rt_min", "rt_max"), "peak_label").select("peak_label", "ms_file_label", apex_time(F.col("rt_min"), F.col("rt_max")).alias("apex"))
    middle = rows.groupBy("peak_label").agg(F.median("apex").alias("reference"))
    return rows.join(middle, "peak_label").withColumn("shift", F.coalesce(F.col("reference") - F.col("apex"), F.lit(0.0)))


def shift_by_sample_type(shifts: DataFrame, samples: DataFrame) -> DataFrame:
    """H5: median shift per peak and sample type; a file without one counts as 0."""
    return shifts.join(samples.select("ms_file_label", "sample_type"), "ms_file_label").groupBy("peak_label", "sample_type").agg(F.median(F.coalesce("shift", F.lit(0.0))).alias("shift"))


def save_alignment(targets: DataFrame, shifts: DataFrame) -> DataFrame:
    """H7: targets with reference, map of file to shift, and span; targets without shifts have nulls."""
    made = shifts.groupBy("peak_label").agg(F.first("reference").alias("rt_align_reference_rt"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ms_file_label", "shift")))).alias("rt_align_shifts"))
    out = targets.join(made, "peak_label", "left").withColumn("rt_align_enabled", F.col("rt_align_shifts").isNotNull())
    on = lambda c: F.when(F.col("rt_align_enabled"), F.col(c))
    return out.withColumns({"rt_align_rt_min": on("rt_min"), "rt_align_rt_max": on("rt_max")})


def alignment_state(targets: DataFrame, shifts: DataFrame) -> DataFrame:
    """H6: active if enabled and shifts are there; span falls back to the target's, reference to the median apex."""
    medians = shifts.groupBy("peak_label").agg(F.median("apex").alias("_median"))
    rows = targets.join(medians, "peak_label", "left")
    return rows.select(
        "peak_label", (F.coalesce("rt_align_enabled", F.lit(False)) & (F.coalesce(F.size("rt_align_shifts"), F.lit(0)) > 0)).alias("active"),
        F.coalesce("rt_align_rt_min", "rt_min").alias("span_min"), F.coalesce("rt_align_rt_max", "rt_max").alias("span_max"), F.coalesce("rt_align_reference_rt", "_median").alias("reference"),
    )


# ------------------------------------------------------------------ H8
def envelope(traces: DataFrame, targets: DataFrame, samples: DataFrame, bins: int = 500, full_range: bool = False, ms_type: str | None = None) -> DataFrame:
    """H8, C11: for all peaks, points at or over the threshold in equal time bins of the peak, per sample type and colour.

    The peak's bounds are an aggregate joined back; counts of distinct files are by type. With
    ``ms_type`` only traces of that type count, and a peak that has none of type ms2 is shown from ms1.
    ``full_range`` takes the downsampled full-range arrays; there are none of ms2, which keeps its own.
    Samples that aren't used for optimization are left out where the table says so.
    """
    bins = min(max(int(bins), 10), 2000)
    if "use_for_optimization" in samples.columns:
        samples = samples.filter("use_for_optimization")
    if ms_type is not None:
        own = traces.filter(F.col("ms_type") == ms_type)
        if ms_type == "ms2":
            own = own.unionByName(traces.filter("ms_type = 'ms1'").join(own.select("peak_label").distinct(), "peak_label", "left_anti"))
        traces = own
    if full_range:
        full = F.lit(True) if "ms_type" not in traces.columns else F.col("ms_type") != "ms2"
        traces = traces.withColumns({c: F.when(full, F.col(f"{c}_full_ds")).otherwise(F.col(c)) for c in ("scan_time", "intensity")})
    rows = traces.join(targets.select("peak_label", F.coalesce("intensity_threshold", F.lit(0.0)).alias("_least")), "peak_label")
    rows = rows.withColumn("p", F.explode(F.filter(pairs(), lambda p: p["i"] >= F.col("_least")))).select("peak_label", "ms_file_label", F.col("p.t").alias("t"), F.col("p.i").alias("i"))
    points = rows.join(samples.select("ms_file_label", "sample_type", "color"), "ms_file_label")
    bounds = points.groupBy("peak_label").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    which = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("t") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9) * bins)))
    binned = points.join(bounds, "peak_label").withColumn("bin_idx", which.cast("int"))
    files = points.groupBy("peak_label", "sample_type").agg(F.count_distinct("ms_file_label").alias("sample_count"))
    out = binned.groupBy("peak_label", "sample_type", "color", "bin_idx").agg(F.avg("t").alias("rt"), F.min("i").alias("min_int"), F.max("i").alias("max_int"), F.avg("i").alias("mean_int"), F.count(F.lit(1)).alias("count"))
    return out.join(files, ["peak_label", "sample_type"])


# ------------------------------------------------------------------ G6, G7
# Chebyshev fit of the scaled complementary error function, relative error 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _scaled_erfc(z: np.ndarray) -> np.ndarray:
    """exp(z * z) * erfc(z) for z >= 0."""
    t = 1 / (1 + 0.5 * z)
    total = np.zeros_like(t)
    for c in reversed(ERFC):
        total = total * t + c
    return t * np.exp(total)


def emg_and_slopes(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentially modified Gaussians at the times ``x`` (traces, points) and their derivatives by amplitude, centre, sigma and rate (traces, 4).

    Where the error function's argument is positive, its product with the exponential is a
    Gaussian times the scaled function, which neither overflows nor loses digits.
    """
    a, mu, sigma, rate = (p[:, k, None] for k in range(4))
    d = x - mu
    z = (rate * sigma * sigma - d) / (sigma * math.sqrt(2))
    with np.errstate(over="ignore", under="ignore"):
        bell = np.exp(-0.5 * (d / sigma) ** 2)
        scaled = _scaled_erfc(np.abs(z))
        tail = np.where(z >= 0, bell * scaled, 2 * np.exp(np.minimum(rate * (-d + rate * sigma * sigma / 2), 700)) - bell * scaled)
        f = a * rate / 2 * tail
        g = a * rate * bell / math.sqrt(math.pi)
        slopes = np.stack(
            [
                rate / 2 * tail,
                rate * f - g / (sigma * math.sqrt(2)),
                rate * rate * sigma * f - g * (d / (sigma * sigma) + rate) / math.sqrt(2),
                f / rate + (rate * sigma * sigma - d) * f - g * sigma / math.sqrt(2),
            ],
            axis=-1,
        )
    return np.nan_to_num(f, nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(slopes, nan=0.0, posinf=0.0, neginf=0.0)


def emg(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return emg_and_slopes(np.atleast_2d(x), np.atleast_2d(p))[0][0]


# Fixed values of the fit: fewest points, least and most centre (by the trace), sigma and rate, start of the rate, steps.
LEAST_POINTS, SIGMAS, RATES, START_RATE, STEPS = 5, (0.01, 50.0), (0.1, 20.0), 1.0, 100
#: R² under which a fit is tried from a second start.
ANEW = 0.99
#: Cells of the matrices that are fitted together.
FIT_CELLS = 1 << 17


def _fit_together(t: np.ndarray, y: np.ndarray, weight: np.ndarray, expected: np.ndarray, by_moments: bool = False) -> np.ndarray:
    """(traces, 6): area, sigma, rate, asymmetry, rt, R² of padded traces. Bounded Levenberg-Marquardt, each trace with its own damping.

    It starts from the trace's height and length, or, ``by_moments``, from its area, mean and variance.
    """
    rows = np.arange(len(t))
    height, span = y.max(axis=1), t[:, -1] - t[:, 0]
    start = np.where(np.isnan(expected) | (expected == 0), t[rows, y.argmax(axis=1)], expected)
    low = np.stack([np.zeros(len(t)), t.min(axis=1), np.full(len(t), SIGMAS[0]), np.full(len(t), RATES[0])], axis=1)
    high = np.stack([np.full(len(t), 1e12), t.max(axis=1), np.full(len(t), SIGMAS[1]), np.full(len(t), RATES[1])], axis=1)
    p = np.stack([height * 2, start, span / 10, np.full(len(t), START_RATE)], axis=1)
    if by_moments:
        mass = np.maximum(y, 0) * weight
        mean = (mass * t).sum(axis=1) / mass.sum(axis=1)
        half = np.sqrt(np.maximum((mass * (t - mean[:, None]) ** 2).sum(axis=1) / mass.sum(axis=1) / 2, 1e-12))
        p = np.stack([((y[:, 1:] + y[:, :-1]) / 2 * np.diff(t, axis=1)).sum(axis=1), mean - half, half, 1 / half], axis=1)
    p = np.clip(p, low, high)
    unit = np.stack([np.maximum(height, 1e-9), np.maximum(span, 1e-9), np.maximum(span, 1e-9), np.ones(len(t))], axis=1)
    f, slopes = emg_and_slopes(t, p)
    r, j = (y - f) * weight, slopes * unit[:, None, :] * weight[:, :, None]
    cost, damping, taken = (r * r).sum(axis=1), np.full(len(t), 1e-2), np.zeros(len(t), int)
    active = rows
    while len(active):
        jt = j[active].transpose(0, 2, 1)
        g = (jt @ r[active][:, :, None])[:, :, 0]
        free = ~(((p[active] <= low[active]) & (g < 0)) | ((p[active] >= high[active]) & (g > 0)))  # a bound that the step would leave holds its parameter
        h = (jt @ j[active]) * (free[:, :, None] & free[:, None, :])
        diagonal = np.einsum("nkk->nk", h).copy()
        h[:, range(4), range(4)] = np.where(free, diagonal + damping[active, None] * np.maximum(diagonal, 1e-12), 1.0)
        step = np.linalg.solve(h, (g * free)[:, :, None])[:, :, 0]
        q = np.clip(p[active] + step * unit[active], low[active], high[active])
        f, slopes = emg_and_slopes(t[active], q)
        rq = (y[active] - f) * weight[active]
        new = (rq * rq).sum(axis=1)
        better = new < cost[active]
        at = active[better]
        gain = cost[at] - new[better]
        p[at], r[at], cost[at] = q[better], rq[better], new[better]
        j[at] = slopes[better] * unit[at][:, None, :] * weight[at][:, :, None]
        taken[at] += 1
        small = np.zeros(len(active), bool)
        small[better] = gain <= 1e-7 * cost[at]
        damping[active] = np.where(better, np.maximum(damping[active] / 5, 1e-10), damping[active] * 4)
        active = active[free.any(axis=1) & ~small & (damping[active] < 1e8) & (taken[active] < STEPS)]
    fitted = y - r
    area = ((fitted[:, 1:] + fitted[:, :-1]) / 2 * np.diff(t, axis=1)).sum(axis=1)
    mean = (y * weight).sum(axis=1, keepdims=True) / weight.sum(axis=1, keepdims=True)
    total = (((y - mean) * weight) ** 2).sum(axis=1)
    return np.stack([area, p[:, 2], p[:, 3], p[:, 3] / p[:, 2], p[:, 1], np.where(total > 0, 1 - cost / np.where(total > 0, total, 1), 0.0)], axis=1)


def fit_peaks(traces: list[tuple[np.ndarray, np.ndarray, float | None]]) -> list[tuple[bool, float, float, float, float, float, float]]:
    """Success, area, sigma, tau (the rate), asymmetry, rt, R² of (times, intensities, expected time); traces of like length are fitted together."""
    out: list[tuple] = []
    fit = []
    for k, (t, y, expected) in enumerate(traces):
        if len(t) < LEAST_POINTS:
            out.append((False, float(np.trapezoid(y, t)) if len(y) > 1 else 0.0, 0.0, 0.0, 0.0, float(expected or 0.0), 0.0))
        elif not y.max() > 0:
            out.append((False, 0.0, 0.0, 0.0, 0.0, float(expected or t[int(np.argmax(y))]), 0.0))
        else:
            out.append(())
            fit.append(k)
    fit.sort(key=lambda k: len(traces[k][0]))
    at = 0
    while at < len(fit):
        to = at + 1
        while to < len(fit) and (to + 1 - at) * len(traces[fit[to]][0]) <= FIT_CELLS:
            to += 1
        some, width = fit[at:to], len(traces[fit[to - 1]][0])
        t, y, weight = np.zeros((len(some), width)), np.zeros((len(some), width)), np.zeros((len(some), width))
        for n, k in enumerate(some):
            size = len(traces[k][0])
            t[n, :size], t[n, size:] = traces[k][0], traces[k][0][-1]
            y[n, :size], weight[n, :size] = traces[k][1], 1.0
        expected = np.array([np.nan if traces[k][2] is None else traces[k][2] for k in some], float)
        found = _fit_together(t, y, weight, expected)
        poor = np.flatnonzero(found[:, 5] < ANEW)
        if len(poor):  # another start may lead to a better minimum
            again = _fit_together(t[poor], y[poor], weight[poor], expected[poor], by_moments=True)
            found[poor] = np.where((again[:, 5] > found[poor, 5])[:, None], again, found[poor])
        for k, row in zip(some, found.tolist(), strict=True):
            out[k] = (True, *row)
        at = to
    return out


def fit_peak(t: np.ndarray, y: np.ndarray, expected: float | None) -> tuple[bool, float, float, float, float, float, float]:
    """G6 for one trace."""
    return fit_peaks([(np.asarray(t, float), np.asarray(y, float), expected)])[0]


FIT = "peak_label string, ms_file_label string, fit_success boolean, peak_area_fitted double, peak_sigma double, peak_tau double, peak_asymmetry double, peak_rt_fitted double, fit_r_squared double"


def fit_pending(results: DataFrame, bookmarked: DataFrame | None = None) -> DataFrame:
    """Rows without a successful fit, of bookmarked targets only if those are given."""
    rows = results.filter(~F.coalesce("fit_success", F.lit(False)))
    return rows if bookmarked is None else rows.join(bookmarked.select("peak_label").distinct(), "peak_label", "left_semi")


def fit_emg(results: DataFrame) -> DataFrame:
    """A fit per row of (peak_label, ms_file_label, window_time, window_intensity, rt).

    Rows are independent and dear, so they are dealt evenly first; a batch's traces are fitted together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FIT.split(", ")]
        for b in batches:
            array = lambda x: np.asarray(x if x is not None else [], float)
            traces = [(array(t), array(y), None if rt is None or rt != rt else float(rt)) for t, y, rt in zip(b["window_time"], b["window_intensity"], b["rt"], strict=True)]
            rows = [(peak, file, *found) for peak, file, found in zip(b["peak_label"], b["ms_file_label"], fit_peaks(traces), strict=True)]
            yield pd.DataFrame(rows, columns=names)

    rows = results.select("peak_label", "ms_file_label", "window_time", "window_intensity", "rt")
    dealt = rows.repartition(max(1, int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "peak_label", "ms_file_label")
    return dealt.mapInPandas(run, FIT)
