"""Ranks, running sums and quantiles: the sliced path against brute force under skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger import scale


@pytest.fixture()
def rows():
    rng = random.Random(7)
    # one group holds most rows, and a third of its values are equal
    return [("hot" if i % 4 else f"g{i % 12}", i, float(rng.choice([0, 0, rng.randint(1, 400)]))) for i in range(1500)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, id long, v double").repartition(5)


def test_running_matches_sorted_cumsum(spark, rows):
    got = scale.running(frame(spark, rows), ["g"], [F.col("v").desc(), F.col("id").asc()], {"acc": "v"})
    got = {(r.g, r.id): (r.pos, r.acc) for r in got.collect()}
    for g in {r[0] for r in rows}:
        acc = 0.0
        for pos, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            acc += v
            assert got[(g, i)] == (pos, acc)


def test_global_running(spark, rows):
    got = scale.running(frame(spark, rows), [], [F.col("id").asc()], {"acc": "v"})
    want = np.cumsum([r[2] for r in sorted(rows, key=lambda r: r[1])])
    assert [r.acc for r in got.orderBy("id").collect()] == list(want)


def test_quantiles_match_numpy(spark, rows):
    got = {r.g: r for r in scale.quantiles(frame(spark, rows), ["g"], "v", {"med": 0.5, "p05": 0.05, "p90": 0.9}).collect()}
    for g in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == g]
        assert got[g].n == len(v)
        for name, p in (("med", 50), ("p05", 5), ("p90", 90)):
            assert got[g][name] == pytest.approx(np.percentile(v, p))


def test_distribution_counts_ties_once(spark):
    rows = [("a", i, float(i // 3)) for i in range(9)]
    got = {r.v: (r.below, r.upto, r.n) for r in scale.distribution(frame(spark, rows), ["g"], "v").collect()}
    assert got == {0.0: (0, 3, 9), 1.0: (3, 6, 9), 2.0: (6, 9, 9)}


def test_top_rows_pushes_the_limit_below_the_shuffle(spark, rows):
    top = scale.top_rows(frame(spark, rows), ["g"], [F.col("v").desc(), F.col("id").asc()], 3, "rn")
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert top.groupBy("g").count().where("count > 3").count() == 0


def test_quantile_over_all_rows(spark, rows):
    got = scale.quantiles(frame(spark, rows), [], "v", {"med": 0.5}).first()
    assert got.n == len(rows) and got.med == pytest.approx(np.percentile([r[2] for r in rows], 50))
