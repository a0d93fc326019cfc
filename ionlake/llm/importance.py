"""Importance resampling of documents towards the distribution of a target corpus.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with ``A-Z`` lower-cased; features
are all runs of 1 to 3 consecutive words, hashed by CRC-32 to buckets. A bucket's gain is the
logarithm of its smoothed share in the target over that in the documents; a document's weight is
the sum of gains of its features. Documents are drawn without replacement by the highest weight
plus Gumbel noise, which a keyed digest of the id gives, so that a draw can be repeated.

CRCs are taken in matrices: the distinct features of a pass, found by numbers and not by hashes,
are grouped by equal length into two-dimensional arrays of bytes, all CRCs of a group are updated
column by column, and the buckets go back to the features' occurrences. (The few features of a
length that is above ``LONG_BYTES`` take zlib's function, which gives the same value.)

Two passes read the texts. The first leaves a sum a bucket and task; gains are a number a bucket,
so what the driver holds is set by ``buckets`` alone. The second leaves four numbers a document.
Places among the drawn come from range partitions, so no task sees all documents.

Edge cases: a null or empty text, or one without words, has no features, the weight 0 and is never
drawn while ``least_words`` is positive. Rows that share an id are documents of their own; they get
the same noise, and which of them comes first when texts are equal too is left open. A null id counts
as an empty string for the noise and comes after the others in ties. Very long texts are one value of
a batch and are never cut. An empty target has the shares of the smoothing alone; an empty table gives
an empty table; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.periodic_runs import Names
from ionlake.llm.shared import Stage, fresh, only, passes, text_bytes
from ionlake.operators.ranks import global_rank

#: Longest features that are put into matrices, in bytes.
LONG_BYTES = 4096
#: Bytes of a matrix.
MATRIX_BYTES = 1 << 22

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


# ---------------------------------------------------------------- CRCs
def crc_table() -> np.ndarray:
    """Remainders of all bytes for the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_TABLE = crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, "<u4")
    low = crc.view(np.uint8)[::4]
    for column in np.ascontiguousarray(rows.T):
        turned = _TABLE.take(low ^ column)
        crc >>= np.uint32(8)
        crc ^= turned
    return ~crc


def crc_of_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start : start + length] for each span, in matrices of equal length."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first, np.append(first, len(order))[1:], strict=True):
        if size > LONG_BYTES:
            out[order[a:b]] = [zlib.crc32(data[s : s + size]) for s in start[order[a:b]]]
            continue
        view, rows = np.lib.stride_tricks.sliding_window_view(data, size), max(1, MATRIX_BYTES // size)
        for x in range(a, b, rows):
            some = order[x : min(b, x + rows)]
            out[some] = crc_matrix(view[start[some]])
    return out


# ---------------------------------------------------------------- features
def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, for each order the text and the bucket of every feature, text by text)."""
    names, parts, sizes = Names(), [], []
    for text in texts:
        found = _WORD.findall(text.lower())  # of bytes, lower() changes A-Z alone
        parts.append(np.fromiter(map(names.__getitem__, found), np.int64, len(found)))
        sizes.append(len(found))
    words = np.concatenate([np.zeros(0, np.int64), *parts])
    of, spelled = np.repeat(np.arange(len(texts)), sizes), list(names)
    # All words of the pass with one space between: a feature is a span.
    data = np.frombuffer(b" ".join(map(spelled.__getitem__, words.tolist())), np.uint8)
    size = np.array([len(x) for x in spelled], np.int64)[words] if len(words) else words
    start = np.cumsum(size + 1) - size - 1
    out, number = [], words
    for order in range(1, 4):
        n = len(words) - order + 1
        if n > 0 and order > 1:
            number = number[:n] * np.int64(len(spelled)) + words[order - 1 :]
        inside = of[: max(n, 0)] == of[order - 1 :] if n > 0 else np.zeros(0, bool)
        if not inside.any():
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            number = number[: max(n, 0)]
            continue
        number, distinct = pd.factorize(number)
        one = np.empty(len(distinct), np.int64)
        one[number[::-1]] = np.arange(n - 1, -1, -1)  # first occurrences
        ends = start[one + order - 1] + size[one + order - 1]
        bucket = crc_of_spans(data, start[one], ends - start[one]) % np.uint32(buckets)
        out.append((of[:n][inside], bucket.astype(np.int64)[number][inside]))
    return np.array(sizes, np.int64), out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    data, at = text_bytes(batch.column(column))
    for a, b in passes(at):
        yield a, b, [data[x:y].tobytes() for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]


def bucket_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over whole texts of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch, 0):
                for _, bucket in features(texts, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], ["bucket", "n"])

    counted = only(docs, text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket at most
    out = np.zeros(buckets, np.int64)
    for row in counted:
        out[row["bucket"]] = row["n"]
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets."""
    b, s_all, t_all = len(of_docs), float(of_docs.sum()), float(of_target.sum())
    found = [math.floor(1000 * math.log(((t + 1) * (s_all + b)) / ((s + 1) * (t_all + b)))) for s, t in zip(of_docs.astype(float).tolist(), of_target.astype(float).tolist(), strict=True)]
    return np.array(found, np.int64)


def noise(key: str) -> int:
    """A thousandfold Gumbel number of a key, rounded down."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch, 2):
                sizes, found = features(texts, len(gain))
                weight = np.zeros(b - a, np.int64)
                for of, bucket in found:
                    total = np.concatenate([[0], np.cumsum(gain[bucket])])
                    at = np.searchsorted(of, np.arange(b - a + 1))
                    weight += np.diff(total[at])
                n = sum(np.maximum(sizes - k, 0) for k in range(3))
                drawn = weight + np.array([noise(f"{seed}:{k or ''}") for k in batch.column(1)[a:b].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *map(pa.array, (sizes, n, weight, drawn))], ["id", "n_words", "n_features", "weight", "score"])

    text_id = fresh(docs, "id_text")[0]
    source = only(docs.withColumn(text_id, F.col(f"`{id_col}`").cast("string")), id_col, text_id, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """The id, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the N documents with ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    stage = Stage(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_text_col))
    scored = stage.keep(weigh(docs, gain, seed, id_col, text_col), "scored")
    enough = F.col("n_words") >= least_words
    draw = percent * scored.filter(enough).count() // 100
    placed = global_rank(scored, [enough.desc(), F.col("score").desc(), F.col("id").asc_nulls_last()], "place")
    rank = F.when(enough & (F.col("place") <= draw), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))
