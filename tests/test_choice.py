"""Budget choices with unequal costs and exact quantiles against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger import scale
from wattledger.operators import campaign as C

SITES = "site_id string, feeder_id string, cost_usd double, ve_neto_usd double, roi double"


def sites(spark, rng, n, costs, feeders=("F1",)):
    rows = []
    for i in range(n):
        cost, value = float(rng.choice(costs)), round(rng.uniform(-20, 300), 2)
        rows.append((f"s{i:03d}", rng.choice(feeders), cost, value, round((value + cost) / cost, 6)))
    return rows, spark.createDataFrame(rows, SITES)


def best(rows, budget, visits=None):
    top = 0.0
    for k in range(len(rows) + 1 if visits is None else min(visits, len(rows)) + 1):
        for chosen in itertools.combinations(rows, k):
            if sum(r[2] for r in chosen) <= budget:
                top = max(top, sum(r[3] for r in chosen))
    return top


def one_by_one(rows, budget, visits=None):
    out, left = [], budget
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if r[2] <= left and (visits is None or len(out) < visits):
            out.append(r[0])
            left -= r[2]
    return sorted(out)


@pytest.mark.parametrize("seed,visits", [(1, None), (2, None), (3, 4), (4, 2)])
def test_knapsack_of_mixed_costs_within_its_bound(spark, seed, visits):
    rng = random.Random(seed)
    rows, df = sites(spark, rng, 15, (40, 55, 90, 130, 210))
    for budget in (100.0, 420.0, 5000.0):
        got = C.knapsack(df, budget, visits).collect()
        value, top = sum(r.ve_neto_usd for r in got), best([r for r in rows if r[3] > 0], budget, visits)
        assert sum(r.cost_usd for r in got) <= budget and (visits is None or len(got) <= visits)
        assert len({r.site_id for r in got}) == len(got)
        if got:
            bound = got[0].bound_usd
            assert value <= top + 1e-6 <= bound + 2e-6
            assert bound - value <= max(r[3] for r in rows) + 1e-6
    everything = sorted(r[0] for r in rows if r[3] > 0)
    assert visits is not None or sorted(r.site_id for r in C.knapsack(df, 5000.0).collect()) == everything


def test_knapsack_of_one_cost_is_exact(spark):
    rows, df = sites(spark, random.Random(5), 14, (60,))
    got = C.knapsack(df, 400.0).collect()
    assert sum(r.ve_neto_usd for r in got) == pytest.approx(best(rows, 400.0)) == pytest.approx(got[0].bound_usd)


@pytest.mark.parametrize("visits", [None, 7])
def test_greedy_passes_over_what_does_not_fit(spark, visits):
    rows, df = sites(spark, random.Random(6), 60, (10, 35, 80, 200, 900))
    for budget in (300.0, 1500.0):
        assert sorted(r.site_id for r in C.greedy(df, budget, visits).collect()) == one_by_one(rows, budget, visits)


def test_two_stage_of_mixed_costs_keeps_each_feeders_budget(spark):
    rows, df = sites(spark, random.Random(7), 45, (40, 55, 90, 130), ("F1", "F2", "F3", "F4"))
    got = C.two_stage(df, 1500.0).collect()
    gain = {f: sum(max(r[3], 0) for r in rows if r[1] == f) for f in ("F1", "F2", "F3", "F4")}
    for f, part in gain.items():
        share = part / sum(gain.values()) * 1500.0
        mine = [r for r in got if r.feeder_id == f]
        assert sum(r.cost_usd for r in mine) <= share + 1e-9
        own = [r for r in rows if r[1] == f and r[3] > 0]
        assert sum(r.ve_neto_usd for r in mine) >= best(own, share) - max(r[3] for r in own)
    assert C.two_stage(df.where("ve_neto_usd < -1000"), 1500.0).count() == 0


@pytest.mark.parametrize("rows_in_a_task", [100_000, 40])
def test_quantiles_of_a_hot_group(spark, monkeypatch, rows_in_a_task):
    monkeypatch.setattr(scale, "GROUP_ROWS", rows_in_a_task)
    monkeypatch.setattr(scale, "BUCKETS", 16)
    rng = random.Random(9)
    groups = {
        "hot": [rng.choice((0.0, 0.0, rng.gauss(5, 2), rng.lognormvariate(0, 9))) for _ in range(900)],
        "same": [3.5] * 200,
        "wide": [-1e308, 1e308] + [rng.uniform(-1, 1) for _ in range(300)],
        "one": [7.0],
        "pair": [1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"p05": 0.05, "med": 0.5, "p99": 0.99, "top": 1.0}
    got = {r.g: r for r in scale.quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (g, name)
    whole = scale.quantiles(df.where("g <> 'wide'"), [], "v", {"q": 0.3}).collect()
    values = [v for g, v in rows if g != "wide" and v is not None and v == v]
    assert len(whole) == 1 and whole[0].n == len(values) and whole[0].q == pytest.approx(np.quantile(values, 0.3), rel=1e-12)
    assert scale.quantiles(df.where(F.lit(False)), ["g"], "v", probs).count() == 0
