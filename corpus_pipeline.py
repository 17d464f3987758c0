"""Training corpus: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes what the one before kept, with the columns of ``documents``; the last gives
the packed pieces. :func:`run` writes each stage's result to the shared folder and reads it
again, so that no stage repeats the work of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.llm import decontam, langid, minhash, packing, pii
from evidentry.llm.columns import table
from evidentry.session import materialize

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null texts and texts without a letter."""
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    return langid.known_language(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of documents that share 0.8 of their five-word shingles.

    Candidates are SimHash links in pigeonhole blocks, and MinHash buckets for the pairs that 64
    bits can't select; all are verified on the shingles. Texts without a word are one group;
    rows of one doc_id and text are one; null ids come after all others; columns of any name
    pass through; an empty table gives none.
    """
    return minhash.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window of ten words (all words of a shorter item).

    Null and empty texts hold none and stay, as do repeated rows that hold none; without items
    every document stays; columns of any name pass through; an empty table gives none.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens, one row a piece.

    Null and empty texts are the end id alone; repeated rows are packed each; only documents
    beyond 2048 tokens are cut; of the documents' columns doc_id stays; an empty table gives none.
    Workers that have other stages behind them keep fewer words.
    """
    return packing.pack(docs, cached_words=100_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
