"""A second full run with one changed feeder: fitted tables follow all feeders."""

import pytest
from pyspark.sql import functions as F

from wattledger.plans import batch
from wattledger.sources.bench_tables import BenchTables, bench_settings
from wattledger.sources.lake import Lake

FEEDERS = ["F00", "F01", "F02", "F03"]


class Changed(batch.Selected):
    """Some feeders, with the readings of one multiplied."""

    def __init__(self, tables, feeders, factor):
        super().__init__(tables, feeders)
        kwh = F.when(F.col("feeder_id") == FEEDERS[0], F.col("kwh") * factor).otherwise(F.col("kwh"))
        self._made["consumption"] = tables.consumption.join(self._feeders, "feeder_id", "left_semi").withColumn("kwh", kwh)


def test_second_full_run_fits_all_feeders(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(batch.LEVELS, "full", (lambda run: {}, batch.LEVELS["full"][1], None))
    tables, cfg = BenchTables(spark, "/root/testdata/sf0.001"), bench_settings()
    some = spark.createDataFrame([(f,) for f in FEEDERS], "feeder_id string")
    twice, once = Lake(spark, f"{tmp_path}/twice"), Lake(spark, f"{tmp_path}/once")
    batch.analyse(Changed(tables, some, 1.0), cfg, twice, "full")
    again = batch.analyse(Changed(tables, some, 3.0), cfg, twice, "full")
    assert [r.feeder_id for r in again.collect()] == FEEDERS[:1]
    batch.analyse(Changed(tables, some, 3.0), cfg, once, "full")

    def scores(lake):
        rows = lake.snapshots.read("gold", "customer_risk").collect()
        return {r.customer_unit_id: (r.feeder_id, r.risk_score, r.score_pu, r.score_unsup) for r in rows}

    got, want = scores(twice), scores(once)
    assert got.keys() == want.keys() and {v[0] for v in got.values()} == set(FEEDERS)
    assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-4) for k in want)
    # every clustered meter of every feeder is a member of the stored centroids
    members = twice.snapshots.read("gold", "load_clusters").where("cluster >= 0").groupBy("cluster").count().collect()
    centroids = twice.snapshots.read("system", "load_curve_centroids").select("cluster", "n_members").distinct().collect()
    assert sorted(map(tuple, members)) == sorted(map(tuple, centroids))
