"""Sparse multinomial logistic regression on hashed text features.

Features are character n-grams (and, if asked for, words), hashed to a fixed number of
buckets; a value is the bucket's share of the document's features times its inverse
document frequency. Training is follow-the-regularised-leader with elastic-net
penalties, one pass after another over a bounded sample in one task; a fifth of the
sample is held out and sets the temperature that calibrates probabilities. Scoring is a
gather and a sum per document over whole texts, in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.shared import text_bytes, words

#: Characters that one numpy pass looks at.
PASS_CHARS = 1 << 18
#: Bits of a hash that one count looks at.
DIGIT = 8


#: ASCII that is neither letter nor digit; it ends a word.
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Features:
    orders: tuple[int, ...] = (1, 2, 3)
    with_words: bool = False
    bits: int = 15
    #: A value is count * scale / (features of the text) ** power.
    power: float = 1.0

    @property
    def size(self) -> int:
        return 1 << self.bits

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of every feature, where each text's features begin); features of a text stand together."""
        parts, docs = [], []
        lowered = [t.lower() for t in texts]
        length = np.fromiter(map(len, lowered), np.int64, len(lowered))
        code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), length)
        with np.errstate(over="ignore"):
            h = np.full(len(code), 0x51ED270B, np.uint32)
            for k in range(1, max(self.orders, default=0) + 1):
                n = len(code) - k + 1
                if n <= 0:
                    break
                h = (h[:n] ^ code[k - 1 :]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                if k in self.orders:
                    inside = doc[:n] == doc[k - 1 :]
                    parts.append(((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - self.bits))[inside])
                    docs.append(doc[:n][inside])
        if self.with_words:
            data, at = text_bytes(pa.array(lowered, pa.string()))
            wh, word_at, _ = words(np.where(_SIGN[data], np.uint8(32), data), at)
            parts.append((wh >> np.uint64(64 - self.bits)).astype(np.uint32))
            docs.append(np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(word_at)))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        bucket, of = np.concatenate(parts), np.concatenate(docs)
        if len(parts) > 1:
            order = np.argsort(of, kind="stable")
            bucket, of = bucket[order], of[order]
        return bucket, np.searchsorted(of, np.arange(len(texts) + 1))


def text_runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about PASS_CHARS characters; a longer text is a run of its own."""
    start = total = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and total + n > PASS_CHARS:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def document_frequency(texts: DataFrame, features: Features) -> np.ndarray:
    """Number of documents with each bucket, over all rows of ``texts`` (one text column), and, last, of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(features.size + 1, np.int64)
        for batch in batches:
            all_ = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in text_runs(all_):
                bucket, at = features.buckets(all_[a:b])
                for x, y in zip(at[:-1], at[1:], strict=True):
                    if y - x < features.size >> 4:
                        df[np.unique(bucket[x:y])] += 1
                    else:
                        df[:-1] += np.bincount(bucket[x:y], minlength=features.size) > 0
            df[-1] += len(all_)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(df[have])], ["bucket", "df"])

    rows = texts.mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # one row a bucket at most
    out = np.zeros(features.size + 1, np.int64)
    for r in rows:
        out[r["bucket"]] = r["df"]
    return out


def idf_of(df: np.ndarray) -> np.ndarray:
    return (np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0).astype(np.float32)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    epochs: int = 4
    scale: float = 30.0


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, p: Ftrl) -> np.ndarray:
    """Weights (size, classes) from (buckets, values, class) rows."""
    z = np.zeros((size, classes))
    n = np.zeros((size, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * p.l1) / ((p.beta + np.sqrt(nn)) / p.alpha + p.l2)
        w[np.abs(zz) <= p.l1] = 0
        return w

    rng = np.random.default_rng(11)
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            at, value, label = rows[k]
            w = weights(at)
            score = value @ w
            prob = np.exp(score - score.max())
            prob /= prob.sum()
            prob[label] -= 1
            g = value[:, None] * prob[None, :]
            had = n[at]
            now = had + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(had)) / p.alpha * w
            n[at] = now
    return weights(slice(None))


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, on a fine grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return float(grid[int(np.argmin([loss(t) for t in grid]))])


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray  # (size, classes), inverse document frequency and scale included
    temperature: float
    features: Features
    #: What each class's probability is multiplied with, where the sample's shares aren't the table's.
    prior: tuple[float, ...] | None = None

    def probabilities(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), max(1, len(self.labels))), 1.0 / max(1, len(self.labels)))
        for a, b in text_runs(texts):
            bucket, at = self.features.buckets([t or "" for t in texts[a:b]])
            n = np.diff(at)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            total = np.add.reduceat(self.table[bucket], at[:-1][some], axis=0) if len(bucket) else np.zeros((0, len(self.labels)))
            s = total / (n[some] ** self.features.power)[:, None] / self.temperature
            e = np.exp(s - s.max(axis=1, keepdims=True))
            out[a + some] = e / e.sum(axis=1, keepdims=True)
        if self.prior is not None and self.labels:
            out *= np.array(self.prior)
            out /= out.sum(axis=1, keepdims=True)
        return out


def fit(sample: DataFrame, features: Features, idf: np.ndarray | None = None, ftrl: Ftrl | None = None) -> Model:
    """Fit on ``sample`` (label string, text string, order long), which the caller has bounded; it is trained on in one task."""
    ftrl = ftrl or Ftrl()
    labels = tuple(sorted(r["label"] for r in sample.select("label").distinct().collect()))
    if not labels:
        return Model((), np.zeros((features.size, 1), np.float32), 1.0, features)

    def train(table: pa.Table) -> pa.Table:
        index = {label: k for k, label in enumerate(labels)}
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        texts, own = table.column("text").to_pylist(), [index[x] for x in table.column("label").to_pylist()]
        rows = []
        for a, b in text_runs(texts):
            bucket, at = features.buckets([t or "" for t in texts[a:b]])
            for k, x, y in zip(range(a, b), at[:-1], at[1:], strict=True):
                if y > x:
                    have, count = np.unique(bucket[x:y], return_counts=True)
                    value = count * (ftrl.scale / (y - x) ** features.power)
                    rows.append((have, value * idf[have] if idf is not None else value, own[k]))
        held = rows[::5] if len(rows) >= 25 else []
        w = train_ftrl([r for k, r in enumerate(rows) if k % 5 or not held], len(labels), features.size, ftrl)
        t = best_temperature(np.array([v @ w[at] for at, v, _ in held]), np.array([c for _, _, c in held], np.int64))
        whole = (w * ftrl.scale * (idf[:, None] if idf is not None else 1)).astype(np.float32)
        return pa.table([pa.array([whole.tobytes()], pa.binary()), pa.array([t])], ["weights", "temperature"])

    rows = sample.groupBy(F.lit(0).alias("all")).applyInArrow(train, "weights binary, temperature double").collect()
    return Model(labels, np.frombuffer(rows[0]["weights"], np.float32).reshape(features.size, len(labels)), rows[0]["temperature"], features)


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int = 800, most_labels: int = 200) -> dict[str, tuple[int, int]]:
    """For each label, (its number of keys, the hash up to which its sample reaches): xxhash64 of key, in signed order.

    A sample is the first ``per_label`` keys of a label, or all if it has no more; of rows that
    share a key ``sampled`` takes one. The ``most_labels`` commonest labels count.
    The hash is found digit by digit from counts, so no label's rows are gathered anywhere.
    """
    h = rows.select(F.col(label).cast("string").alias("label"), F.xxhash64(key).alias("h")).filter("label IS NOT NULL").distinct()
    sizes = {r["label"]: r["count"] for r in h.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels).collect()}
    top = {x: (1 << 63) - 1 for x, n in sizes.items() if n <= per_label}
    open_: dict[str, tuple[int, int]] = {x: (0, per_label) for x in sizes if x not in top}  # digits so far, rows still wanted
    shift = 64
    while open_:
        shift -= DIGIT
        if shift == 64 - DIGIT:
            mine = F.col("label").isin(*open_)
        else:
            mine = reduce(lambda a, b: a | b, [(F.col("label") == x) & (F.shiftright("h", shift + DIGIT) == digits) for x, (digits, _) in open_.items()])
        counts: dict[str, list[tuple[int, int]]] = {}
        for r in h.filter(mine).groupBy("label", F.shiftright("h", shift).alias("digits")).count().collect():  # 2**DIGIT rows a label at most
            counts.setdefault(r["label"], []).append((r["digits"], r["count"]))
        for x, found in counts.items():
            wanted = open_.pop(x)[1]
            for digits, n in sorted(found):
                if n >= wanted:
                    if n == wanted or shift == 0:
                        top[x] = (digits + 1 << shift) - 1
                    else:
                        open_[x] = (digits, wanted)
                    break
                wanted -= n
    return {x: (sizes[x], top[x]) for x in sizes}


def sampled(rows: DataFrame, tops: dict[str, tuple[int, int]]) -> DataFrame:
    """label, text, order of the sample's rows; ``rows`` has id, label, text."""
    if not tops:
        mine = F.lit(False)
    else:
        mine = reduce(lambda a, b: a | b, [(F.col("label") == x) & (F.col("order") <= top) for x, (_, top) in tops.items()])
    named = rows.select(F.col("label").cast("string").alias("label"), "text", F.xxhash64("id").alias("order"))
    return named.filter(mine).groupBy("label", "order").agg(F.min("text").alias("text"))
