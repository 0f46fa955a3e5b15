"""The pipeline stage by stage, and the registered queries against SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from helpers import clashing

from wattledger.llm import exact_dedup, language_id, near_dedup
from wattledger.llm.registry import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(docs)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    texts = [r.text.lower() for r in seen[1].collect()]
    assert len(texts) == len(set(texts))
    assert seen[1].count() == seen[0].selectExpr("lower(text) t").distinct().count()
    assert seen[2].count() == seen[2].select("doc_id").distinct().count() <= seen[1].count()
    assert seen[4].count() == seen[3].count()
    assert corpus_pipeline.run(spark, SF).count() == seen[4].count()


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_all_are_registered():
    names = set(entry_module.queries())
    assert set(LLM_QUERIES) | {"pipeline"} <= names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(LLM_ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(LLM_ORACLES[name])
    columns = [d[0] for d in want.description]
    got = LLM_QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_decisions_hold_for_a_doc_id_with_its_text(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "ab"]
    df = clashing(spark.createDataFrame([(5, long[0]), (5, long[1]), (9, long[1]), (9, long[1])], "doc_id long, text string"))
    kept = sorted((r.doc_id, r.text) for r in exact_dedup.drop_copies(df).collect())
    assert kept == [(5, long[0]), (9, long[1])]
    # a doc_id that stands for two texts names neither: its rows stay, and so does their near copy
    near = clashing(spark.createDataFrame([(5, long[0]), (5, long[1]), (9, long[1] + " x"), (11, long[1] + " x y"), (None, long[0])], "doc_id long, text string"))
    out = near_dedup.keep_one(near)
    assert out.columns == near.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["5", "5", "9", "None"]
    known = "the and of with that the and of for this are not have from they which been were their there"
    rows = [(1, known, "en", "s")] * 30 + [(1, "", "en", "s"), (1, None, "en", "s"), (None, None, "en", "s"), (None, known, "en", "s")]
    judged = language_id.accepted(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert [r.text for r in judged.collect()] == [known] * 31


def test_encoding_stage_takes_null_and_repeated_ids(spark):
    rows = [(3, "one two", "en", "s"), (3, "one two", "en", "s"), (3, None, None, None), (None, "three", "en", "s"), (4, "", "en", "s")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = dict(corpus_pipeline.STAGES)["bpe_encode"](spark, df, SF).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in out) == [("3", False), ("3", True), ("3", True), ("4", False), ("None", True)]
