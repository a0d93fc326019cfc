"""Mixing to target weights with soft membership.

1. A classifier fitted on a bounded sample of a labelled table gives every document a
   posterior over domains (``linear_text``; word and character features).
2. Rates r_i >= 0 are fitted so that the expected tokens of each domain, sum of
   r_i * tokens_i * p_i(d), match targets in the least-squares sense. The metric is the
   token-weighted second moment M of the posteriors of documents with a rate above 0, in which one
   gradient step without constraints is exact; projection on r >= 0 makes it projected gradient
   descent. A step that doesn't bring the sums nearer is halved.
   A document's rate is a function of its posterior and of the residuals of the steps so
   far, one number per domain and step, so that a step is one aggregation over the staged
   posteriors and nothing per document is carried: a lost executor costs a re-read.
3. A rate becomes a number of copies by a hash of the id: floor(rate + u).

Without a total, the largest one is aimed at that no domain has to be repeated for. Domains
named in ``at_most`` have no say in it: their share is an upper bound, and where there is
less of them all of it is the target, so scarce unwanted text takes no other text away.

Edge cases: null text has no tokens and the uniform posterior; a domain with a target but
no documents keeps its shortfall; without labelled rows all rates are 1; repeated rows get
equal rates, and of rows that share an id the sample takes the text that sorts first and ``apply``
the largest number of copies; of a document's several labels the first in order of name counts;
an empty table gives an empty result; extra columns are left alone. Very long texts are one value of a
batch, all of whose features count. Rows of equal rates get a copy more or less by a hash of their id. The 200
commonest domains are learned; a target for another one is left out of the aims.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.llm.linear_text import Features, Ftrl, Model, bounded_sample, fit, sampled
from ionlake.llm.shared import Stage, fresh, only

FEATURES = Features(orders=(2,), with_words=True, bits=18, power=0.5)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", per_domain: int = 800) -> Model:
    """Fit on at most ``per_domain`` labelled rows of each domain, chosen by a hash of the id."""
    rows = only(labelled, id_col, domain_col).toDF("id", "label").filter("id IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
    tops = bounded_sample(rows, "label", "id", per_domain)
    chosen = sampled(rows.withColumn("text", F.lit(None).cast("string")), tops).select("label", "order")
    texts = only(docs, id_col, text_col).toDF("id", "text").withColumn("order", F.xxhash64(F.col("id").cast(rows.schema["id"].dataType)))
    # per_domain rows of each domain at most
    chosen = chosen.groupBy("order").agg(F.min("label").alias("label"))
    sample = texts.join(F.broadcast(chosen), "order").groupBy("label", "order").agg(F.min("text").alias("text"))
    model = fit(sample, FEATURES, None, Ftrl(l1=2.0, epochs=10, scale=3.0))
    return replace(model, prior=tuple(n / min(n, per_domain) for n, _ in (tops[x] for x in model.labels)))


def posteriors(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (words), p (one probability per domain, in the order of model.labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            p = model.probabilities(texts).astype(np.float64)
            tokens = [len(t.encode().split()) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), lists], ["id", "n_tokens", "p"])

    source = only(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, p array<double>")


def rate_after(steps: list[np.ndarray], p: Column) -> Column:
    """The rate that starts at 1 and takes the projected steps."""
    if not steps:
        return F.lit(1.0)
    all_ = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda v: F.aggregate(F.zip_with(p, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(all_, F.lit(1.0), lambda r, v: F.greatest(F.lit(0.0), r - dot(v)))


def _moments(row, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
    return m + np.eye(d) * max(1e-9 * np.trace(m), 1e-12)


def fit_rates(scored: DataFrame, domains: tuple[str, ...], weights: dict[str, float], total: float | None = None, steps: int = 30, tolerance: float = 1e-4, at_most: tuple[str, ...] = ()) -> tuple[Column, dict[str, float], dict[str, float]]:
    """(rate column, target tokens, expected tokens reached); ``scored`` should be a written table."""
    d = len(domains)
    if d == 0:
        return F.lit(1.0), {}, {}
    sums = [F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(d)]
    moments = [F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
    first = scored.agg(*sums, *moments).first()
    supply = np.array([first[f"s{i}"] or 0.0 for i in range(d)])
    m = _moments(first, d)
    share = np.array([max(0.0, weights.get(x, 0.0)) for x in domains])
    share = share / share.sum() if share.sum() > 0 else np.full(d, 1.0 / d)
    if total is None:
        have = [supply[i] / share[i] for i in range(d) if share[i] > 0 and supply[i] > 0 and domains[i] not in at_most]
        total = min(have, default=float(supply.sum()))
    target = np.array([min(share[i] * total, supply[i]) if x in at_most else share[i] * total for i, x in enumerate(domains)])
    got, taken, close = supply, [], 0.02 * tolerance * max(total, 1.0)
    step = np.linalg.solve(m, got - target)
    for _ in range(steps):
        error = np.abs(got - target).max(initial=0)
        if error <= tolerance * max(total, 1.0):
            break
        r = rate_after([*taken, step], F.col("p"))
        # Rows at rate 0 don't answer to a small step, so the next one's metric leaves them out.
        alive = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        sums = [F.sum(F.col("n_tokens") * F.col("r") * F.col("p")[i]).alias(f"s{i}") for i in range(d)]
        moments = [F.sum(alive * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
        row = scored.select("n_tokens", "p", r.alias("r")).agg(*sums, *moments).first()
        new = np.array([row[f"s{i}"] or 0.0 for i in range(d)])
        gain = error - np.abs(new - target).max(initial=0)
        if gain <= 0:  # too far
            step = step / 2
            if np.abs(step).max(initial=0) < 1e-12:
                break
            continue
        taken, got = [*taken, step], new
        if gain <= close:
            break
        step = np.linalg.solve(_moments(row, d), got - target)
    return rate_after(taken, F.col("p")), dict(zip(domains, target.tolist(), strict=True)), dict(zip(domains, got.tolist(), strict=True))


def copies(rate: Column, key: Column) -> Column:
    """floor(rate + u), u from a hash of the key."""
    u = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return F.floor(rate + u).cast("long")


def mix(docs: DataFrame, model: Model, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", at_most: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens, p_<domain> for each domain, rate, copies for every document, and for each domain target_ and reached_ tokens, the same in all rows."""
    scored = Stage(docs.sparkSession, "mixing").keep(posteriors(docs, model, id_col, text_col), "scored")
    rate, target, reached = fit_rates(scored, model.labels, weights, total, at_most=at_most)
    out = scored.select("id", "n_tokens", "p", rate.alias("rate"))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        *[F.col("p")[i].alias(f"p_{x}") for i, x in enumerate(model.labels)],
        "rate",
        copies(F.col("rate"), F.col("id")).alias("copies"),
        *[F.lit(float(v)).alias(f"target_{x}") for x, v in target.items()],
        *[F.lit(float(v)).alias(f"reached_{x}") for x, v in reached.items()],
    )


def apply(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents as often as their copies say, with all their columns; rows without an id stay once."""
    key, times, copy = fresh(docs, "_mix_id", "_copies", "_copy")
    found = mixed.groupBy(F.col(id_col).alias(key)).agg(F.max("copies").alias(times))
    joined = docs.join(found, F.col(f"`{id_col}`") == F.col(key), "left").withColumn(times, F.coalesce(times, F.lit(1)))
    many = F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(1).cast("long"), F.col(times))).otherwise(F.array().cast("array<bigint>")))
    return joined.withColumn(copy, many).select(*[F.col(f"`{c}`") for c in docs.columns])
