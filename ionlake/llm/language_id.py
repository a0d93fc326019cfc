"""Language identification on TF-IDF character n-grams (see ``linear_text``).

Document frequencies come from all training rows; weights and temperature from a sample
of at most ``per_language`` rows of each language, chosen by a hash of the id. Where the column
holds more values, the ``most_languages`` commonest are learned.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is any text
where no labelled row exists; of equally likely languages the first in order of name is given; texts
of any length are read whole; rows with a null label are not learned from; repeated rows get the same
answer, and of those that share an id the sample takes the text that sorts first; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.llm.linear_text import Features, Model, bounded_sample, document_frequency, fit, idf_of, sampled
from ionlake.llm.shared import only

FEATURES = Features(orders=(1, 2, 3), bits=15)
UNDETERMINED = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, most_languages: int = 200) -> Model:
    rows = only(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out("id"))
    tops = bounded_sample(rows, "lang", "id", per_language, most_languages)
    idf = idf_of(document_frequency(rows.select("text"), FEATURES))
    return fit(sampled(rows.select("id", F.col("lang").alias("label"), "text"), tops), FEATURES, idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*model.labels, UNDETERMINED], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            p = model.probabilities(texts)
            best = p.argmax(axis=1)
            known = np.array([bool(model.labels) and any(map(str.isalpha, t)) for t in texts], bool)
            best[~known] = len(model.labels)
            score = np.where(known, p.max(axis=1, initial=0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(labels[best]), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    source = only(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, above_chance: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose language is determined, with their columns.

    The score must lie ``above_chance`` of the way from that of a guess (1 / number of languages) to 1.
    """
    columns, guess = docs.columns, 1 / max(1, len(model.labels))
    least = guess + above_chance * (1 - guess)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(columns.index(text_col)).to_pylist()]
            ok = (model.probabilities(texts).max(axis=1, initial=0) >= least) & np.array([bool(model.labels) and any(map(str.isalpha, t)) for t in texts], bool)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
