"""The linear range of peaks with more standards than a row should hold.

The standards of all such peaks are written once, in ranges of peak, concentration and value. Their sums are
aggregates. A peak's search moves the two ends inwards; what is left is known by its sums, so a task needs only the points
at the ends, which it reads from the written ranges, a row group at a time from both sides. Its memory
does not grow with the peak, and its time with the points that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.sources.staging import staged_folder

#: Bytes of a row group of the written standards.
GROUP_BYTES = 4 << 20
SUMS = ("sx", "sy", "sxx", "sxy", "syy")
CURVE = "peak_label string, slope double, intercept double, lin_range_min double, lin_range_max double, n_points int, residual double"


def _points(files: list[str], peak: str, backwards: bool) -> Iterator[tuple[float, float]]:
    """(y, x) of a peak's standards, from the lowest or from the highest on."""
    for path in reversed(files) if backwards else files:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as file:
            content = pq.ParquetFile(file)
            groups = range(content.num_row_groups)
            for g in reversed(groups) if backwards else groups:
                rows = content.read_row_group(g, ["peak_label", "y", "x"]).to_pandas()
                rows = rows[rows["peak_label"] == peak]
                points = rows[["y", "x"]].to_numpy()
                yield from map(tuple, (points[::-1] if backwards else points).tolist())


def _line(k: int, s: dict[str, float], mode: str, interval: tuple[float, float]) -> tuple[float, float, float]:
    """Slope, intercept and squared error of k points with the sums s."""
    slope = 1.0
    if mode != "fixed":
        var, cov = s["sxx"] - s["sx"] ** 2 / k, s["sxy"] - s["sx"] * s["sy"] / k
        slope = cov / var if var > 1e-12 * max(1e-12, s["sxx"]) else 1.0
        slope = min(max(slope, min(interval)), max(interval)) if mode == "bounded" else slope
    b = (s["sy"] - slope * s["sx"]) / k
    return slope, b, s["syy"] + k * b * b + slope * slope * s["sxx"] - 2 * b * s["sy"] - 2 * slope * s["sxy"] + 2 * slope * b * s["sx"]


def _search(files: list[str], row: pd.Series, mode: str, interval: tuple[float, float], most_residual: float, most_end: float) -> tuple:
    k, mx, my, s = int(row["n"]), row["mx"], row["my"], {c: float(row[c]) for c in SUMS}
    low, high = _points(files, row["peak_label"], False), _points(files, row["peak_label"], True)
    first, last = next(low), next(high)
    while True:
        slope, b, sse = _line(k, s, mode, interval)
        errors = [(y - my - b - slope * (x - mx)) ** 2 for y, x in (first, last)]
        residual = sse / (k if mode == "free" else k * k)
        if k <= 3 or not (residual > most_residual or max(errors) > most_end):
            return row["peak_label"], slope, my + b - slope * mx, first[0], last[0], k, residual
        drop_first = errors[0] > errors[1]
        y, x = (v - m for v, m in zip(first if drop_first else last, (my, mx), strict=True))
        for c, v in zip(SUMS, (x, y, x * x, x * y, y * y), strict=True):
            s[c] -= v
        k -= 1
        if drop_first:
            first = next(low)
        else:
            last = next(high)


def large_curves(points: DataFrame, mode: str, interval: tuple[float, float], most_residual: float, most_end: float) -> DataFrame:
    """CURVE of every peak of ``points`` (peak_label, y, x), which has three points at least for each."""
    spark = points.sparkSession
    path, n = staged_folder(spark, "standards"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["peak_label", "y", "x"]
    points.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    written = spark.read.schema(points.select(*order).schema).parquet(path)
    means = written.groupBy("peak_label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = written.join(means, "peak_label").groupBy("peak_label").agg(*[F.first(c).alias(c) for c in ("n", "mx", "my")], *[F.sum(v).alias(c) for c, v in zip(SUMS, (x, y, x * x, x * y, y * y), strict=True)])
    # A row for each file that has points of the peak, in order.
    parts = written.withColumn("file", F.input_file_name()).groupBy("peak_label", "file").agg(F.min(F.struct("y", "x")).alias("from"))
    files = parts.groupBy("peak_label").agg(F.array_sort(F.collect_list(F.struct("from", "file")))["file"].alias("files"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_search(list(row["files"]), row, mode, interval, most_residual, most_end) for _, row in b.iterrows()]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in CURVE.split(", ")])

    given = sums.join(files, "peak_label").repartition(n, "peak_label")
    return given.mapInPandas(run, CURVE)
