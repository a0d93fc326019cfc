"""Calibration curves and concentrations (section J).

The standards of a peak, up to a number, are a sorted array inside one row; the linear range is a fold
that drops the worse end until the fit is good, in expressions, linear in the array, with no grouped
Python. Peaks with more standards are searched in ``large_standards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.operators.large_standards import large_curves

RESIDUAL, END = 0.01, 0.2
FIXED, FREE, BOUNDED = "fixed", "free", "bounded"


def common_peaks(results: DataFrame, standards: DataFrame) -> DataFrame:
    """Peak labels that both have."""
    return results.select("peak_label").distinct().join(standards.select("peak_label").distinct(), "peak_label", "left_semi")


def melt_standards(wide: DataFrame) -> DataFrame:
    """(peak_label, ms_file, std_conc) of a peak-by-file table."""
    files = [c for c in wide.columns if c != "peak_label"]
    return wide.select("peak_label", *[F.col(f"`{c}`").cast("double").alias(c) for c in files]).unpivot(["peak_label"], files, "ms_file", "std_conc")


def plain_file(name: Column) -> Column:
    return F.replace(F.element_at(F.split(name, "/"), -1), F.lit(".mzXML"), F.lit(""))


def training_set(results: DataFrame, standards: DataFrame, metric: str) -> DataFrame:
    """(peak_label, ms_file, value, std_conc) of results that have a standard; null values go."""
    rows = results.select("peak_label", plain_file(F.col("ms_file_label")).alias("ms_file"), F.col(metric).cast("double").alias("value"))
    return rows.filter("value IS NOT NULL").join(standards.filter("std_conc IS NOT NULL"), ["peak_label", "ms_file"])


def fit(points: Column, mode: str = FIXED, interval: tuple[float, float] = (0.85, 1.15)) -> Column:
    """struct(slope, intercept, residual, first, last) of array<struct<y, x>>.

    Residuals are over N^2 for a fixed or bounded slope and over N for a free one.
    """
    n = F.size(points).cast("double")
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))
    means = F.struct((total(lambda p: p["x"]) / n).alias("x"), (total(lambda p: p["y"]) / n).alias("y"), points.alias("p"))

    def line(m: Column) -> Column:
        over = lambda f: F.aggregate(m["p"], F.lit(0.0), lambda s, p: s + f(p))
        var, cov = over(lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"])), over(lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"]))
        slope = F.lit(1.0) if mode == FIXED else F.when(var == 0, 1.0).otherwise(cov / var)
        if mode == BOUNDED:
            slope = F.greatest(F.least(slope, F.lit(max(interval))), F.lit(min(interval)))
        return F.struct(slope.alias("slope"), m["x"].alias("x"), m["y"].alias("y"), m["p"].alias("p"))

    def done(s: Column) -> Column:
        icpt = s["y"] - s["slope"] * s["x"]
        err = lambda p: (p["y"] - icpt - s["slope"] * p["x"]) * (p["y"] - icpt - s["slope"] * p["x"])
        k = F.size(s["p"]).cast("double")
        residual = F.aggregate(s["p"], F.lit(0.0), lambda a, p: a + err(p)) / (k if mode == FREE else k * k)
        return F.struct(s["slope"].alias("slope"), icpt.alias("intercept"), residual.alias("residual"), err(F.get(s["p"], F.lit(0))).alias("first"), err(F.element_at(s["p"], -1)).alias("last"))

    # A one-element transform binds a value once, so that later parts don't compute it again.
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(bind(means, line), done)


def linear_range(points: Column, mode: str = FIXED, interval: tuple[float, float] = (0.85, 1.15)) -> Column:
    """struct(points, fit) after dropping the worse end while the fit is poor and over 3 points are left; ``points`` are sorted by y, then x.

    The search carries the ends and the sums of what is left, about the mean of all points, so a
    drop costs one subtraction and the whole search is linear in the points.
    """
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.greatest(F.size(points), F.lit(1))
    names = ("sx", "sy", "sxx", "sxy", "syy")

    def terms(p: Column, m: Column) -> list[Column]:
        x, y = p["x"] - m["x"], p["y"] - m["y"]
        return [x, y, x * x, x * y, y * y]

    def search(m: Column) -> Column:
        zero = F.struct(F.lit(0).alias("lo"), (F.size(points) - 1).alias("hi"), *[F.lit(0.0).alias(c) for c in names])
        start = F.aggregate(points, zero, lambda s, p: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), *[(s[c] + v).alias(c) for c, v in zip(names, terms(p, m), strict=True)]))

        def line(s: Column) -> Column:
            k = (s["hi"] - s["lo"] + 1).cast("double")
            var, cov = s["sxx"] - s["sx"] * s["sx"] / k, s["sxy"] - s["sx"] * s["sy"] / k
            slope = F.lit(1.0) if mode == FIXED else F.when(var <= 1e-12 * F.greatest(F.lit(1e-12), s["sxx"]), 1.0).otherwise(cov / var)
            if mode == BOUNDED:
                slope = F.greatest(F.least(slope, F.lit(max(interval))), F.lit(min(interval)))
            return F.struct(k.alias("k"), slope.alias("slope"))

        def step(s: Column, _: Column) -> Column:
            def judged(f: Column) -> Column:
                b = (s["sy"] - f["slope"] * s["sx"]) / f["k"]
                return F.struct(f["k"].alias("k"), f["slope"].alias("slope"), b.alias("b"))

            def moved(f: Column) -> Column:
                m1, b, k = f["slope"], f["b"], f["k"]
                sse = s["syy"] + k * b * b + m1 * m1 * s["sxx"] - 2 * b * s["sy"] - 2 * m1 * s["sxy"] + 2 * m1 * b * s["sx"]
                error = lambda p: (p["y"] - m["y"] - b - m1 * (p["x"] - m["x"])) * (p["y"] - m["y"] - b - m1 * (p["x"] - m["x"]))
                first, last = error(F.get(points, s["lo"])), error(F.get(points, s["hi"]))
                poor = ((sse / (k if mode == FREE else k * k) > RESIDUAL) | (first > END) | (last > END)) & (k > 3)
                gone = F.when(first > last, F.get(points, s["lo"])).otherwise(F.get(points, s["hi"]))
                at = F.when(first > last, 1).otherwise(0)
                less = F.struct((s["lo"] + at).alias("lo"), (s["hi"] - 1 + at).alias("hi"), *[(s[c] - v).alias(c) for c, v in zip(names, terms(gone, m), strict=True)])
                return F.when(poor, less).otherwise(s)

            return bind(bind(line(s), judged), moved)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1))), start, step)

    ends = bind(F.struct(mean("x").alias("x"), mean("y").alias("y")), search)
    kept = bind(ends, lambda e: F.slice(points, e["lo"] + 1, F.greatest(e["hi"] - e["lo"] + 1, F.lit(0))))
    return bind(kept, lambda q: F.struct(q.alias("points"), fit(q, mode, interval).alias("fit")))


#: Standards of a peak up to which they are an array of one row.
MANY = 200_000


def calibration_curves(training: DataFrame, mode: str = FIXED, interval: tuple[float, float] = (0.85, 1.15)) -> DataFrame:
    """Per peak slope, intercept, linear range of log concentration, points, residual, LLOQ, ULOQ.

    Peaks with more than MANY standards are searched from both ends of written ranges; the others' standards are arrays.
    """
    good = (F.col("value") > 1e-11) & (F.col("std_conc") > 1e-11)
    counts = training.filter(good).groupBy("peak_label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MANY).select("peak_label")
    if counts.isEmpty():
        return _ends_as_values(_array_curves(training, mode, interval))
    points = training.filter(good).join(counts, "peak_label", "left_semi").select("peak_label", F.log("std_conc").alias("y"), F.log("value").alias("x"))
    large = large_curves(points, mode, interval, RESIDUAL, END)
    return _ends_as_values(_array_curves(training.join(counts, "peak_label", "left_anti"), mode, interval).unionByName(large))


def _ends_as_values(curves: DataFrame) -> DataFrame:
    return curves.withColumns({"lloq": F.exp("lin_range_min"), "uloq": F.exp("lin_range_max")})


def _array_curves(training: DataFrame, mode: str, interval: tuple[float, float]) -> DataFrame:
    good = (F.col("value") > 1e-11) & (F.col("std_conc") > 1e-11)
    point = F.when(good, F.struct(F.log("std_conc").alias("y"), F.log("value").alias("x")))
    rows = training.groupBy("peak_label").agg(F.array_sort(F.collect_list(point)).alias("all"))
    found = rows.withColumn("found", F.when(F.size("all") > 2, linear_range(F.col("all"), mode, interval)))
    kept = F.coalesce(F.col("found.points"), F.col("all"))
    return found.select(
        "peak_label", F.coalesce("found.fit.slope", F.lit(1.0)).alias("slope"), F.coalesce("found.fit.intercept", F.lit(0.0)).alias("intercept"), F.get(kept, F.lit(0))["y"].alias("lin_range_min"),
        F.get(kept, F.size(kept) - 1)["y"].alias("lin_range_max"), F.size(kept).alias("n_points"), F.coalesce("found.fit.residual", F.lit(0.0)).alias("residual"),
    )


def predict_concentration(values: DataFrame, curves: DataFrame) -> DataFrame:
    """pred_conc and in_range (1 or 0) for each value; null values count as 0, a peak without a curve gives null."""
    c = curves.select("peak_label", "slope", "intercept", "lin_range_min", "lin_range_max")
    value = F.coalesce("value", F.lit(0.0))
    out = values.join(c, "peak_label", "left").withColumn("pred_conc", F.exp(F.col("slope") * F.log(value + 1e-12) + F.col("intercept")))
    outside = (F.col("pred_conc") < F.exp("lin_range_min")) | (F.col("pred_conc") > F.exp("lin_range_max"))
    flag = F.when(F.col("pred_conc").isNotNull(), F.when(outside, 0).otherwise(1))
    return out.withColumn("in_range", flag).drop("slope", "intercept", "lin_range_min", "lin_range_max")


def training_frame(training: DataFrame, curves: DataFrame) -> DataFrame:
    """True concentrations, null outside the curve's range, with predictions, for values above 0."""
    ends = curves.select("peak_label", F.exp(F.col("lin_range_min") - 1e-8).alias("_lo"), F.exp(F.col("lin_range_max") + 1e-8).alias("_hi"), "lloq", "uloq")
    rows = predict_concentration(training, curves).join(ends, "peak_label", "left")
    true = F.when(~((F.col("std_conc") < F.col("_lo")) | (F.col("std_conc") > F.col("_hi"))), F.col("std_conc"))
    return rows.filter("value > 0").withColumn("true_conc", true).drop("_lo", "_hi", "std_conc")


def concentration_table(predicted: DataFrame, units: DataFrame) -> DataFrame:
    """Predictions with the peak's unit."""
    return predicted.join(units.select("peak_label", "unit"), "peak_label", "left")


def join_concentrations(results: DataFrame, concentrations: DataFrame) -> DataFrame:
    """Concentration by trimmed text of peak and file."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    other = concentrations.select(text("peak_label").alias("_p"), text("ms_file_label").alias("_f"), "concentration")
    return results.join(other, (text("peak_label") == F.col("_p")) & (text("ms_file_label") == F.col("_f")), "left").drop("_p", "_f")


def calibrate(results: DataFrame, standards: DataFrame, metric: str, mode: str = FIXED, interval: tuple[float, float] = (0.85, 1.15), units: DataFrame | None = None) -> dict[str, DataFrame]:
    """Curves, concentrations and training frame for a metric of the results."""
    allowed = {"peak_area", "peak_area_top3", "peak_max", "peak_mean", "peak_median", "peak_area_fitted", "v", "m"}
    if metric not in allowed:
        raise ValueError(f"unknown metric {metric}")
    training = training_set(results, standards, metric)
    curves = calibration_curves(training, mode, interval)
    values = results.filter(F.col(metric).isNotNull()).select("peak_label", "ms_file_label", F.col(metric).cast("double").alias("value"))
    predicted = predict_concentration(values, curves)
    return {"curves": curves, "concentrations": concentration_table(predicted, units) if units is not None else predicted, "training": training_frame(training, curves)}
