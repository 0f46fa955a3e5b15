"""The registry as the checker sees it, and a sample of it against the second engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from wattledger.checks.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "nation customer orders lineitem part events".split()
SAMPLE = (
    "feeder_balance", "load_point_findings", "imbalance", "pq_causes", "ap_anomalies", "closure", "zones", "R06", "M5",
    "feat_theil_sen", "wls", "infer_transfers", "cust_inherit", "two_stage",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def clean(v):
    return round(v, 8) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_every_oracle_runs(duck):
    for name, sql in ORACLES.items():
        duck.execute(sql).fetchall()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    got = entry_module.queries()[name](spark, SF)
    want = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(map(clean, r)) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(map(clean, r)) for r in want.fetchall()), key=str)
