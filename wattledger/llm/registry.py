"""Registered queries of the subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattledger.llm import bpe, divergence_audit, exact_dedup, filter_audit, language_id, license_scan, lm_scoring, mixing, near_dedup, pii, substring_dedup, token_files, topk_search
from wattledger.llm.common import documents

#: name of the vocabulary file that the token operators use
TOKENIZER = "byte_bpe_50k.json"

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn

    return register


@query(
    "op7_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
    sha256(t) AS text_sha256
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
  WINDOW g AS (PARTITION BY t)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("repeats")


@query("op1_language_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_id.of_documents(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


@query("language_id_pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_id.of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("id", "page_id")


@query("op2_near_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op3_mix_sources")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op4_token_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(documents(spark, sf_dir), tokenizer())


@query("op5_substring_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


@query("op6_bpe_prefix_dp")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer())


@query("op8_pii_bootstrap")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


@query(
    "op9_exact_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
    SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id) AS rank
    FROM v AS q JOIN v AS x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op10_license_scan", license_scan.scan_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@query("op11_lm_scoring")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


@query("op12_filter_audit", filter_audit.AUDIT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op13_divergence_audit", divergence_audit.AUDIT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(documents(spark, sf_dir))
