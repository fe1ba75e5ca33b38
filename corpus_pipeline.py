"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes the documents that its predecessor kept, as Parquet, and returns the columns of documents (the last
one adds the place in the mixture). A stage's table is deleted once the next one is written.

Defined cases, after the operators': null texts and texts without letters are rejected by the first stage, as are all
documents where none has a language; rows that repeat a doc_id are one document of the third; columns beyond those of
documents pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.llm import decontam, langid, linededup, mixing, neardup
from abundex.llm.common import forget, keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject; a missing language is filled with the predicted one."""
    found = langid.identify(docs, langid.fit(docs)).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat elsewhere; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return neardup.dedup_documents(docs, size=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in a mixture that weights sources by the square root of their size."""
    return mixing.mix_sources(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = keep(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
