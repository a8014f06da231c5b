"""Corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

language       documents in none of the learnt languages go: those without a letter, and those whose share of known
               n-grams is too low by more than chance explains; the same rule holds for texts of every length
near_copies    one document of each group of linked documents stays
benchmark      documents contaminated by benchmark passages go
secrets        secrets in texts are masked
packing        texts become pieces of token sequences

All but the last return the columns of ``documents``.  The stages read whole
texts; null and empty texts leave with the first stage, as they have no letter.

Other defined results: rows without an id are no copies; of near copies the
smallest id stays; rows that repeat an id are documents of their own, and of
rows equal in id and text one stays, the least in its other columns; columns of any names besides ``doc_id``, ``text`` and ``lang`` pass
through all stages but the last; an empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import common, decontamination, langid, ngram_join, packing, queries, secrets

#: A document is rejected where its share of the best language's n-grams is surely below this.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the table itself (a bounded sample; n-grams of two documents at least, so that no text teaches itself) and keeps what it can tell."""
    model = langid.fit(docs.where(~langid.held_out()), least=2)
    plain = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    told = langid.identify(plain, model, text_col=f"c{docs.columns.index('text')}")
    return told.where(~langid.is_rejected(LEAST_SHARE)).select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs, num=80, den=100, n=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks all spans, base and linked; ``n_chars`` follows the text."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (little-endian unsigned 32-bit integers)."""
    return packing.pack_documents(docs, queries.tokenizer_path(), 2)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", mask), ("packing", pack)]

#: Tokens and learnt languages are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
