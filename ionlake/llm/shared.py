"""Helpers shared by the corpus operators: staged tables, Arrow batches, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.sources.staging import shared_folder

#: Bytes of text that one numpy pass looks at; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


# ---------------------------------------------------------------- staged tables
class Stage:
    """Tables of one query, written to the shared folder so that lineage ends there.

    A lost executor costs only a re-read. ``drop`` empties a table that no later step reads,
    which keeps iterative jobs at a bounded size on disk; ``clear`` does so for all that are left.
    """

    _open: list[list[Stage]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.live: dict[str, None] = {}
        for stages in Stage._open:
            stages.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        self.live[name] = None
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables; a plan that still reads one fails, as its files are gone."""
        for name in names:
            if name in self.live:
                del self.live[name]
                try:
                    files, path = fs.FileSystem.from_uri(self.path(name))
                    files.delete_dir(path)
                except (pa.ArrowException, OSError):  # a store that only Spark reaches
                    self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(self.path(name))

    def clear(self) -> None:
        self.drop(*self.live)


@contextmanager
def releasing() -> Iterator[None]:
    """Clears, at the end, every Stage made inside: for callers that have written down what they need."""
    stages: list[Stage] = []
    Stage._open.append(stages)
    try:
        yield
    finally:
        Stage._open.remove(stages)
    for stage in stages:
        stage.clear()


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that runs inside go when it ends, not when the driver happens to collect its garbage.

    For jobs whose every step is written by ``Stage.keep``, so that no later query reads a shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with derived ones."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones, that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


# ---------------------------------------------------------------- Arrow batches
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def passes(at: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about ``limit`` bytes each."""
    row, rows = 0, len(at) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, min(to, rows)
        row = to


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, for work that makes Python objects of all rows that it sees at a time."""
    for batch in batches:
        for k in range(0, max(1, len(batch)), rows):
            yield batch.slice(k, rows)


# ---------------------------------------------------------------- bitmaps
def in_bitmap(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits that the places (int64, not negative) fall on are set; a bitmap has a power of two of bits."""
    at = place & (64 * len(bitmap) - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bitmap_of(places: DataFrame, most: int, times: int = 16) -> np.ndarray:
    """A bitmap, as 64-bit words, of a written table of hashes ``place`` (long); ``times`` bits each, at most ``most`` bits, however many there are."""
    n, bits = places.count(), 1 << 16
    while bits < min(times * n, most):
        bits *= 2
    at = F.pmod(F.col("place"), F.lit(bits))
    rows = places.select(F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    found = np.zeros(bits >> 6, np.int64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return found.view(np.uint64)


# ---------------------------------------------------------------- word hashes
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a multiply and xor-shift finaliser)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+``, where each document's words begin, word byte starts.

    ``at`` has the byte where each document begins and, last, where all end.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    first = np.flatnonzero(~space & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    last = np.flatnonzero(~space & (after | cut[1:]))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        h = mix((total[last + 1] - total[first]) * powers(_BACK, n)[first])
    return h, np.searchsorted(first, at), first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k-1 have none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD1342543DE82EF95) + h[j : j + n]
        return mix(out)
