"""Sample-by-target analysis (section I). Everything stays in long form until a matrix is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ionlake.operators.quantiles import exact_quantiles
from ionlake.operators.ranks import rank_in_group
from ionlake.operators.tiles import pair_distances
from ionlake.operators.wide_pca import cells_of, sum_by, wide_components
from ionlake.sources.staging import staged


#: What a row of the sample matrix says of its file, as far as the samples have it.
META = ("ms_file_label", "ms_type", "sample_type", "group_1", "group_2", "group_3", "group_4", "group_5")


def columns_by_type(targets: DataFrame) -> list[str]:
    """Peak labels in order of ms_type, then label: the matrix's columns (one row a target)."""
    return [r["peak_label"] for r in targets.select("ms_type", "peak_label").distinct().orderBy(F.asc_nulls_last("ms_type"), "peak_label").collect()]


def sample_matrix(results: DataFrame, samples: DataFrame, metric: str, labels: list[str], meta: tuple[str, ...] = META) -> DataFrame:
    """A row per analysed file, a column per peak label; labels are given (``columns_by_type``), so no extra pass finds them."""
    used = samples.filter(F.coalesce("use_for_analysis", F.lit(True))) if "use_for_analysis" in samples.columns else samples
    meta = tuple(c for c in meta if c in samples.columns)
    values = results.groupBy("ms_file_label").pivot("peak_label", labels).agg(F.first(metric, ignorenulls=True))
    return used.select(*meta).join(values, "ms_file_label").select(*meta, *[F.col(f"`{x}`") for x in labels])


def clean_long(rows: DataFrame, metric: str) -> DataFrame:
    """Every (file, peak) of files and peaks that have any finite value; others' gaps are 0."""
    value = F.when(~F.isnan(metric) & (F.abs(metric) != float("inf")), F.col(metric))
    finite = rows.withColumn(metric, value).filter(F.col(metric).isNotNull())
    grid = finite.select("ms_file_label").distinct().crossJoin(finite.select("peak_label").distinct())
    return grid.join(finite, ["ms_file_label", "peak_label"], "left").withColumn(metric, F.coalesce(metric, F.lit(0.0))).select("ms_file_label", "peak_label", metric)


def zscore(rows: DataFrame, metric: str, out: str = "z") -> DataFrame:
    """(x - mean) / population std per peak, 0 where std is 0.

    Statistics are a combined aggregate joined back, so that no peak's rows meet in one task.
    """
    stats = rows.groupBy("peak_label").agg(F.avg(metric).alias("_mean"), F.stddev_pop(metric).alias("_std"))
    return rows.join(stats, "peak_label").withColumn(out, F.when(F.col("_std") > 0, (F.col(metric) - F.col("_mean")) / F.col("_std")).otherwise(0.0)).drop("_mean", "_std")


def rocke_durbin(z: Column, c: float = 10.0) -> Column:
    """I4."""
    return F.log((z + F.sqrt(z * z + c * c)) / 2)


def normalize(rows: DataFrame, metric: str, mode: str, out: str = "normalized") -> DataFrame:
    """None, zscore, durbin or zscore-durbin."""
    if mode == "none":
        return rows.withColumn(out, F.col(metric))
    if mode == "durbin":
        return rows.withColumn(out, rocke_durbin(F.col(metric)))
    scored = zscore(rows, metric, out)
    return scored if mode == "zscore" else scored.withColumn(out, rocke_durbin(F.col(out)))


def group_label(column: Column, field: str) -> Column:
    """I7."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(f"{field} (unset)"))


def pca(rows: DataFrame, key: str, vector: str, k: int, covariance_width: int = 1000) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """I8: (scores, loadings, explained-variance ratio) of centred vectors; signs make the largest loading positive.

    Up to ``covariance_width`` columns, the covariance is summed over partitions, and half of width * width
    numbers reach the driver. Wider rows go to ``sparse_pca``.
    """
    first = rows.select(vector).first()
    if first is None:
        raise ValueError("no rows")
    width = len(first[0])
    if width > covariance_width:
        return sparse_pca(rows.select(key, F.sequence(F.lit(0), F.lit(width - 1)).alias("at"), F.col(vector).cast("array<double>").alias("x")), key, width, k)
    origin = np.asarray(first[0], float)  # near the data, so that the sums of squares keep their digits

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float) - origin
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        cells = np.concatenate([[n], total, square[np.triu_indices(width)]])
        yield pd.DataFrame({"i": np.arange(len(cells)), "x": cells})

    cells = rows.select(vector).mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()
    flat = cells.column("x").to_numpy()
    n, total, square = int(flat[0]), flat[1 : width + 1], np.zeros((width, width))
    square[np.triu_indices(width)] = flat[width + 1 :]
    square = square + np.triu(square, 1).T
    cov = (square - np.outer(total, total) / n) / max(n - 1, 1)
    mean = origin + total / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(k, width, n)]
    values_kept, parts = np.maximum(values[order], 0), vectors[:, order]
    parts = signed(parts)
    ratio = values_kept / max(np.maximum(values, 0).sum(), 1e-300)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) if len(b) else np.zeros((0, width))
            yield pd.DataFrame({key: b[key], "scores": list((x - mean) @ parts)})

    scores = rows.select(key, vector).mapInPandas(project, f"{key} {dict(rows.dtypes)[key]}, scores array<double>")
    return scores, parts * np.sqrt(values_kept), ratio


def signed(parts: np.ndarray) -> np.ndarray:
    """Components whose largest loading is positive."""
    return parts * np.sign(parts[np.abs(parts).argmax(0), np.arange(parts.shape[1])]) if parts.size else parts


def sparse_pca(rows: DataFrame, key: str, width: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """I8 for any width: as ``pca``, of rows (key, at, x) with the numbers of their columns and the values there; others are 0.

    The rows are written once and read a few dozen times; width * 160 numbers are on the driver, never width * width.
    """
    written = staged(rows.select(key, F.col("at").cast("array<int>").alias("at"), F.col("x").cast("array<double>").alias("x")), "pca")
    mean, parts, values, total = wide_components(written, width, k)
    parts = signed(parts)
    shift = mean @ parts

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, column, value = cells_of(batch)
            scores = sum_by(row, parts[column] * value[:, None], len(batch)) - shift
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * parts.shape[1], pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "scores"])

    scores = written.mapInArrow(project, f"{key} {dict(rows.dtypes)[key]}, scores array<double>")
    return scores, parts * np.sqrt(values), values / max(total, 1e-300)


def matrix_pca(rows: DataFrame, metric: str, labels: list[str], k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I8, I9 on the sample-by-target matrix in long form: (scores by file, components with ratio and cumulative ratio, loadings ranked).

    Missing and non-finite cells are 0. At most min(files, targets, k) components.
    """
    spark = rows.sparkSession
    clean = rows.withColumn(metric, F.when(~F.isnan(metric) & (F.abs(metric) != float("inf")), F.col(metric)))
    wide = clean.groupBy("ms_file_label").pivot("peak_label", labels).agg(F.first(metric, ignorenulls=True))
    vectors = wide.select("ms_file_label", F.array(*[F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) for x in labels]).alias("v"))
    scores, loadings, ratio = pca(vectors, "ms_file_label", "v", k)
    parts = [(j + 1, float(r), float(c)) for j, (r, c) in enumerate(zip(ratio, np.cumsum(ratio), strict=True))]
    return scores, spark.createDataFrame(parts, "component int, ratio double, cumulative double"), rank_by_loading(labels, loadings, spark)


def group_summary(rows: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean, SEM (n - 1) and count."""
    return rows.groupBy(*keys).agg(F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("sem"), F.count(metric).alias("n"))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    from math import lgamma

    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        direct = front * _beta_fraction(a, b, np.where(low, x, 0.5)) / a
        other = 1 - front * _beta_fraction(b, a, np.where(low, 0.5, 1 - x)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, direct, other)))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = incomplete_beta(df[ok].to_numpy() / 2, np.full(ok.sum(), 0.5), (df[ok] / (df[ok] + t[ok] ** 2)).to_numpy())
    return out


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of F."""
    ok = f.notna() & (df1 > 0) & (df2 > 0)
    out = pd.Series(np.nan, index=f.index)
    if ok.any():
        out[ok] = incomplete_beta(df2[ok].to_numpy() / 2, df1[ok].to_numpy() / 2, (df2[ok] / (df2[ok] + df1[ok] * f[ok])).to_numpy())
    return out


def _group_stats(rows: DataFrame, metric: str, group: str) -> DataFrame:
    return rows.filter(F.col(metric).isNotNull() & F.col(group).isNotNull()).groupBy("peak_label", group).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.var_samp(metric).alias("var"))


def welch_t_test(rows: DataFrame, metric: str, group: str) -> DataFrame:
    """T, degrees of freedom and p for peaks with exactly two groups of two values or more."""
    stats = _group_stats(rows, metric, group)
    two = stats.groupBy("peak_label").agg(F.array_sort(F.collect_list(F.struct(group, "n", "mean", "var"))).alias("g"))
    two = two.filter((F.size("g") == 2) & F.forall("g", lambda x: x["n"] >= 2))
    a, b = F.col("g")[0], F.col("g")[1]
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    t = F.when(va + vb > 0, (a["mean"] - b["mean"]) / F.sqrt(va + vb))
    df = F.when(va + vb > 0, (va + vb) * (va + vb) / (va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1)))
    return two.select("peak_label", t.alias("t"), df.alias("df")).withColumn("p_value", t_p_value("t", "df"))


def anova(rows: DataFrame, metric: str, group: str) -> DataFrame:
    """One-way F and p per peak with more than two groups; sums of squares from group aggregates."""
    stats = _group_stats(rows, metric, group).withColumn("ss", F.coalesce(F.col("var") * (F.col("n") - 1), F.lit(0.0)))
    total = stats.groupBy("peak_label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("big_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("ss").alias("ssw"))
    between = stats.join(total.select("peak_label", "grand"), "peak_label").groupBy("peak_label").agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ssb"))
    out = total.join(between, "peak_label").filter("k > 2 AND big_n > k")
    out = out.select("peak_label", (F.col("k") - 1).cast("double").alias("df1"), (F.col("big_n") - F.col("k")).cast("double").alias("df2"), "ssb", "ssw")
    return out.withColumn("f", F.when(F.col("ssw") > 0, (F.col("ssb") / F.col("df1")) / (F.col("ssw") / F.col("df2")))).withColumn("p_value", f_p_value("f", "df1", "df2")).drop("ssb", "ssw")


def distribution_span(rows: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """1 % and 99 % quantiles with linear interpolation, of groups of any size."""
    return exact_quantiles(rows, keys, metric, {"q01": 0.01, "q99": 0.99})


def qc_series(results: DataFrame, samples: DataFrame, metric: str, mode: str = "zscore") -> DataFrame:
    """For every peak its files in order of acquisition (nulls last, then label), numbered, with the normalised metric."""
    rows = results.join(samples.select("ms_file_label", "acquisition_datetime", group_label(F.col("group_1"), "group_1").alias("group")), "ms_file_label")
    return normalize(rank_in_group(rows, ["peak_label"], [F.asc_nulls_last("acquisition_datetime"), F.col("ms_file_label")], "number"), metric, mode)


def color_map(samples: DataFrame, group: str, palette: list[str], grey_largest: bool = False) -> DataFrame:
    """A colour per group: the first explicit one of its files, else the palette by name order, grey for the largest if asked."""
    rows = samples.groupBy(group_label(F.col(group), group).alias("group")).agg(F.min(F.nullif("color", F.lit(""))).alias("own"), F.count(F.lit(1)).alias("n"))
    colors = F.array(*[F.lit(c) for c in palette])
    place = F.dense_rank().over(Window.orderBy("group")) - 1  # one row a group
    out = rows.withColumn("color", F.coalesce("own", F.get(colors, (place % len(palette)).cast("int"))))
    if grey_largest:
        out = out.withColumn("_first", F.row_number().over(Window.orderBy(F.desc("n"), "group"))).withColumn("color", F.when(F.col("_first") == 1, "#BBBBBB").otherwise(F.col("color"))).drop("_first")
    return out.select("group", "n", "color")


def sample_distances(rows: DataFrame, left: str, along: str, metric: str, digits: int | None = None) -> DataFrame:
    """I16: Euclidean distance of every two ``left`` keys over ``along``, to ``digits`` decimals if given; the result is as large as the question asks.

    Dot products come in tiles of two blocks of keys; missing cells are 0 through the squared norms, so keys that
    share nothing are as far apart as their norms say. ``left`` may be peaks (over files) or files (over peaks).
    """
    return pair_distances(rows, left, along, metric, digits)


def rank_by_loading(labels: list[str], loadings: np.ndarray, spark) -> DataFrame:
    """Targets by the size of their first loading (one row a target)."""
    order = sorted(zip(labels, loadings[:, 0].tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(k + 1, label, value) for k, (label, value) in enumerate(order)], "place int, peak_label string, pc1 double")
