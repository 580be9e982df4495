"""A training corpus from documents: language ID, line dedup, near-duplicate removal, secret masking, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them in turn,
each stage's result being written as Parquet and read again as the next one's docs. Stages begin by
having executors give back the memory that the stage before needed.

Defined cases, in every stage: null and empty texts, repeated rows and rows without a doc_id are kept or dropped as the stage's line
says; an empty table gives an empty table; all but the last stage return the columns of docs, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm.jaccard_join import near_dedup
from stowage.llm.language_id import language_filter
from stowage.llm.line_dedup import line_dedup
from stowage.llm.packing import pack
from stowage.llm.secrets import mask_secrets
from stowage.llm.shared import documents, relieve, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: null, empty or without a letter) go."""
    return language_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents (rows) or more go, everywhere; a text may become empty, null becomes empty."""
    relieve(spark)
    return line_dedup(docs, 10, 1, "none")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays; texts without a word, and rows without an id, stay."""
    relieve(spark)
    return near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; null stays null."""
    relieve(spark)
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end id alone."""
    import public_tokenizers as P

    relieve(spark)
    return pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN)


STAGES = [("language_id", languages), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Naive Bayes, tokenisation and the structural checks are not SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
