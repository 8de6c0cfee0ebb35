"""From raw documents to token files: language, near-duplicates, test-set passages, mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.storage import passing_tables
from linkloom.llm import decontaminate, langid, mixing, queries, simhash, token_frames
from linkloom.llm._shared import documents, shared_dir, stored


def _chars(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go.

    Null, empty and letterless texts go; null ids, sources and declared languages stay and are no evidence; equal rows are
    judged alike; an empty table gives no rows.
    """
    model, evidence = queries.language_evidence(spark, docs, sf_dir)
    return langid.drop_rejected(docs, model, **evidence)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Null, empty and blank texts are one group; ids come before null; of rows equal in every column one stays; an empty
    table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts; n_chars follows.

    A null text stays null, a text without words stays as it is, a text of which nothing is left goes; repeated rows are
    each cut; without test items nothing changes; an empty table gives no rows.
    """
    clean = decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if chars := _chars(docs):
        kind = dict(docs.dtypes)[chars]
        clean = clean.withColumn(chars, F.when(F.col("text").isNull(), F.col(chars)).otherwise(F.length("text")).cast(kind))
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amounts that the source targets ask for, repetitions as rows of their own.

    Texts without words (null ones too) are never taken; a null source is one of its own; null and repeated ids are allowed; an
    empty table gives no rows.
    """
    return mixing.mixed_documents(docs, chars_col=_chars(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in shared storage, and what they hold of each row.

    A null or empty text has the end id alone; rows without an id come first; repeated rows are all kept; an empty table
    gives no files and no rows.
    """
    out = shared_dir(spark)
    token_frames.write_token_frames(docs, out, queries.tokenizer_path(), end_id=2)
    return token_frames.read_token_frames(spark, out).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Fingerprints, the flow and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's table replaces the one before it, whose folder then goes."""
    docs = documents(spark, sf_dir)
    with passing_tables(spark, lambda: [docs]):
        for _, stage in STAGES[:-1]:
            kept = docs
            with passing_tables(spark, lambda: [docs, kept]):
                docs = stored(stage(spark, kept, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
