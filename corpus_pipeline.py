"""A cleaning pipeline over ``documents``: five stages, each a table that the next one reads.

Language identification drops documents without a language; line de-duplication cuts repeated lines;
near-duplicate detection keeps the first document of each group; decontamination drops documents that
hold benchmark passages; byte-pair encoding turns what is left into token ids.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.llm import bpe, decontaminate, langid, lines, setsketch
from ticketloom.llm.shared import stored

# A document stays when its language has at least this share of the likelihood.
LEAST_SCORE = 0.5
TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those between languages."""
    # The row travels as one column, so that its own columns may have any name.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = langid.with_language(rows, langid.fit(docs))
    sure = (F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= LEAST_SCORE)
    return judged.where(sure).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; a document that lost some goes when nothing of its own is left."""
    cut = lines.own_documents(docs, threshold=1, least=20)
    return cut.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return setsketch.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    coded = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# The first and the last stage are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
