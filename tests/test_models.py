"""Acceptance of the risk models on separable meters, and of the run's shared storage."""

import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wattledger.operators import risk
from wattledger.session import checkpoint_root, clear_cuts, materialize
from wattledger.sources.lake import Lake


@pytest.fixture(scope="module")
def meters(spark):
    """240 meters, a quarter of them thieves; half of the thieves are labelled."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        thief = i % 4 == 0
        x = [rng.gauss(2.0 if thief else 0.0, 0.6), rng.gauss(-1.5 if thief else 0.0, 0.6), rng.random()]
        rows.append((f"C{i:03d}", Vectors.dense(x), int(thief and i % 8 == 0), thief))
    return materialize(spark.createDataFrame(rows, ["customer_unit_id", "x", "s", "thief"]), "meters")


@pytest.mark.parametrize("method", risk.PU_METHODS)
def test_scores_are_shares_and_find_thieves(meters, method):
    truth = {r.customer_unit_id: r.thief for r in meters.collect()}
    scores = risk.fit_pu(meters.select("customer_unit_id", "x", "s"), method).collect()
    assert len(scores) == 240 and all(0.0 <= r.score_pu <= 1.0 for r in scores)
    top = sorted(scores, key=lambda r: -r.score_pu)
    assert sum(truth[r.customer_unit_id] for r in top[:20]) / 20 >= 0.5
    assert sum(truth[r.customer_unit_id] for r in top[:60]) / 60 >= 0.5


def test_inspection_weights_have_mean_one(meters):
    weights = [r.weight for r in risk.ipw_weights(meters.select("customer_unit_id", "x", "s")).collect()]
    assert len(weights) == 240 and min(weights) > 0
    assert sum(weights) / len(weights) == pytest.approx(1.0)
    seen = {r.customer_unit_id: r.s for r in meters.collect()}
    got = risk.ipw_weights(meters.select("customer_unit_id", "x", F.lit(1).alias("s"))).collect()
    assert len(seen) == 240 and {r.weight for r in got} == {1.0}


def test_sampling_hash_is_even_and_fine(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("customer_unit_id"))
    row = ids.select(risk.hash_unit(1).alias("u")).agg(F.min("u").alias("low"), F.max("u").alias("high"), F.avg("u").alias("mean")).first()
    assert 0 <= row.low < 0.001 and 0.999 < row.high < 1 and abs(row.mean - 0.5) < 0.01


def test_isotonic_pools_violators():
    assert risk.isotonic([0, 3, 1, 0, 4], [4, 4, 4, 0, 4]) == [0.0, 0.5, 0.5, 1.0, 1.0]
    assert risk.isotonic([2, 0], [2, 2]) == [0.5, 0.5]


class _Cluster:
    """A session that looks like one on a cluster and names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_cuts_need_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(_Cluster)


def test_cuts_are_below_the_application(spark):
    assert checkpoint_root(spark).endswith(spark.sparkContext.applicationId)
    assert callable(clear_cuts)


def test_lake_only_takes_a_missing_path_for_an_empty_entity(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}")
    assert lake.read_entity("bronze", "poles").count() == 0
    broken = tmp_path / "bronze" / "poles"
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        lake.read_entity("bronze", "poles").count()
