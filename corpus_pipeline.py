"""The corpus pipeline: documents in, token ids of the mixed, deduplicated corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents:

* language_id drops documents whose language is not known with confidence,
* exact_dedup keeps the last document of every group of equal texts,
* near_dedup keeps one document of every group of near copies (NEAR_PERCENT of five-word shingles),
* mix_sources repeats or leaves out documents so that sources meet their target weights,
* bpe_encode returns every document's token ids and the digest of their decoded text.

Decisions hold for rows with their texts: rows that share a doc_id are judged each by its own
text, and where a doc_id stands for several texts, near_dedup keeps them all.  Rows without
a doc_id pass the two dedup stages, since no decision can be tied to them, and are not in the mix.  Null texts count as empty: they are rejected by the first stage.
Extra columns are carried through the first four stages.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from wattledger.llm.registry import tokenizer
from wattledger.session import checkpoint_root


#: similarity at which the near_dedup stage links texts; op2 has its own
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a known language; null and empty texts go, repeated rows share a verdict."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased, null as empty) the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id; texts without words are nobody's copy."""
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; those without words or doc_id are taken zero times."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256."""
    rows = bpe.round_trip(docs, tokenizer(), release=True)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: the language model, the sample's random numbers and the encoder are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
