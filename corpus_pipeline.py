"""A training-data pipeline of five operators, from ``documents`` to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before
kept; ``run`` writes each stage's result as Parquet in the shared folder, reads it
again, and deletes what the stage wrote on the way.  All stages but the last return the columns of ``docs``,
further columns of any name included.  Rows are decided one by one, also where they share a doc_id
or have none, or are equal; texts of any length are worked on as wholes; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import odd_minhash, quality, source_mix, template_leaks, token_store
from seqloom.llm._shared import discard, made, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Equal texts have equal scores and go or stay together.  Null and empty texts are scored as texts
    without words; labels that are null, or of documents that are gone, teach nothing; without usable
    labels every document stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8): a row of the least doc_id.

    Null and empty texts resemble nothing and stay, as does every row that nothing resembles.
    """
    return odd_minhash.one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items.

    Null and empty texts hold none and stay; items without a word, or without an id, are in no document.
    """
    return template_leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights.

    A null source is a source like others; rows without words add nothing to a mix and are left out.
    """
    return source_mix.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a token store and returns what it holds: a row for each document of the mix.

    A null or empty text is its end id alone; a null doc_id comes first; rows of one doc_id follow each other.
    """
    return token_store.token_output(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token output", token_stage),
]

#: The classifier, the sketches and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds ``run`` against a
#: brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, [path for path in made()[:-1] if path not in before])
    return docs
