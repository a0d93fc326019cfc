"""Range joins by a sweep: points in partitions of equal load, windows read where they are needed (C4).

The join on m/z bins in ``extract`` moves no point where the binned windows can be broadcast. With more windows
than that, a bin is a key of a shuffle: a common ion or a wide window would make a hot one. Here no row is made
per bin. Spark cuts the points' own sampled distribution into ranges of equal load; points of equal m/z are told
apart by file and scan, so an ion that holds a third of all points is many partitions'. Windows are written once,
sorted by their lower end. A task goes through its points in order of m/z and reads the windows that reach into its
stretch; the matches of a window are one slice of the sorted points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.sources.staging import staged_at

#: Relative width of the stretch of m/z whose windows a task reads at a time, and the rows of a batch it yields.
STRETCH, BATCH_ROWS = 0.01, 1 << 17


class Windows:
    """The windows of a written table that reach into the current stretch, by lower end."""

    def __init__(self, path: str):
        self.files, self.at = fs.FileSystem.from_uri(path)
        self.upto = -np.inf
        self.low = self.high = np.zeros(0)
        self.labels = pa.array([], pa.string())

    def reaching(self, first: float, last: float) -> None:
        """Makes low, high and labels those of all windows that meet [first, last]."""
        if last <= self.upto:
            return
        self.upto = last + STRETCH * abs(last)
        found = pq.read_table(self.at, filesystem=self.files, filters=[("_low", "<=", self.upto), ("_high", ">=", first)]).sort_by("_low").combine_chunks()
        self.low, self.high = found.column("_low").to_numpy(), found.column("_high").to_numpy()
        self.labels = found.column("peak_label")


def slices(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the sorted ``values``, number of the window) of every value in a window, ends included, in batches."""
    first, last = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
    n = np.maximum(last - first, 0)
    hit = np.flatnonzero(n)
    ends = np.cumsum(n[hit])
    a = 0
    while a < len(hit):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + BATCH_ROWS, "right")))
        some = hit[a:b]
        size = n[some]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[some], size)
        yield place, np.repeat(some, size)
        a = b


def sweep_join(points: DataFrame, windows: DataFrame, value: str, apart: list[str]) -> DataFrame:
    """Columns of ``points`` and the peak_label of each window (peak_label, _low, _high) that holds ``value``, ends included.

    ``apart`` are the columns by which points of equal ``value`` are dealt to several tasks. Values that
    are null or not a number match nothing.
    """
    spark = points.sparkSession
    path = staged_at(windows.filter("_low <= _high").orderBy("_low"), "windows")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns, key = points.columns, "_value"
    while key in columns:
        key += "_"
    known = points.withColumn(key, F.col(value).cast("double")).filter(F.col(key).isNotNull() & ~F.isnan(key))
    dealt = known.repartitionByRange(n, F.col(key), F.xxhash64(*apart)).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Windows(path)
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column(batch.schema.names.index(key)).to_numpy()
            near.reaching(values[0], values[-1])
            rows = pa.Table.from_batches([batch.select(columns)])
            for place, window in slices(values, near.low, near.high):
                yield from rows.take(pa.array(place)).append_column("peak_label", near.labels.take(pa.array(window))).combine_chunks().to_batches()

    return dealt.mapInArrow(run, T.StructType([*points.schema.fields, windows.schema["peak_label"]]))
