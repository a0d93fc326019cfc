"""From raw documents to packed sequences: the corpus operators as stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and reads
again for the next stage. All but the last return the columns of ``documents``.

Edge cases are those of the operators: texts that are null or have no letter go in the
first stage; repeated rows go in the second; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionlake.llm import exact_dedup, language_id, minhash_dedup, mixing, packing
from ionlake.llm.queries import AT_MOST, MIX, domains, table, tokenizer_path
from ionlake.llm.shared import Stage, releasing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined go."""
    return language_id.keep_identified(docs, language_id.train(docs), above_chance=0.1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return minhash_dedup.keep_one(docs, similarity=0.8, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights asks for."""
    model = mixing.train(docs, domains(table(spark, sf_dir, "labels")))
    return mixing.apply(docs, mixing.mix(docs, model, MIX, at_most=AT_MOST))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, tokenizer_path(), length=1024, end_id=2)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Learned models and token ids can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        with releasing():
            docs = stage.keep(step(spark, docs, sf_dir), f"stage{k}")
        if k:
            stage.drop(f"stage{k - 1}")
    return docs
