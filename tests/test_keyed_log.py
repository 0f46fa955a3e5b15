"""Arriving batches: corrections, retries, compaction, touched feeders and content sums."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wattledger.operators import incremental
from wattledger.sources.snapshots import Snapshots
from wattledger.streaming import feeds

ROW = "customer_unit_id string, feeder_id string, year_month string, kwh double, kvarh double, estimated boolean"


@pytest.fixture
def log(spark, tmp_path):
    return feeds.consumption_log(spark, str(tmp_path / "log"))


def batch(spark, rows):
    return spark.createDataFrame([(c, f, y, k, None, False) for c, f, y, k in rows], ROW)


def content(log):
    return sorted(((r.customer_unit_id, r.feeder_id, r.year_month, r.kwh) for r in log.read().collect()), key=str)


def feeders_of(df):
    return sorted(str(r.feeder_id) for r in df.collect())


def test_corrections_retries_and_compaction(spark, log, tmp_path):
    assert log.read().count() == 0 and log.compact() == -1
    log.land(batch(spark, [("c1", "F1", "2024-01", 10.0), ("c2", "F2", "2024-01", 20.0), ("c3", "F3", "2024-01", 5.0)]), 0)
    log.land(batch(spark, [("c1", "F1", "2024-02", 11.0)]), 1)
    # the same batch again after a failure, and a bill twice in one batch
    log.land(batch(spark, [("c1", "F1", "2024-02", 11.0), ("c1", "F1", "2024-02", 12.0)]), 1)
    assert content(log) == [("c1", "F1", "2024-01", 10.0), ("c1", "F1", "2024-02", 12.0), ("c2", "F2", "2024-01", 20.0), ("c3", "F3", "2024-01", 5.0)]
    assert feeders_of(log.touched()) == ["F1", "F2", "F3"] and feeders_of(log.touched(0)) == ["F1"]
    assert log.compact() == 1 and feeders_of(log.touched()) == []
    # a late correction counts once, before and after the next compaction
    log.land(batch(spark, [("c2", "F2", "2024-01", 7.0)]), 2)
    want = [("c1", "F1", "2024-01", 10.0), ("c1", "F1", "2024-02", 12.0), ("c2", "F2", "2024-01", 7.0), ("c3", "F3", "2024-01", 5.0)]
    assert content(log) == want and feeders_of(log.touched()) == ["F2"]
    assert log.compact() == 2 and content(log) == want and log.compact() == 2
    # only the touched feeder was written anew
    runs = {r.feeder_id: r.run for r in log.base.manifest().where("entity = 'consumption' AND feeder_id IS NOT NULL").collect()}
    assert runs["F1"] == runs["F3"] != runs["F2"]


def test_rows_that_name_no_bill_all_count(spark, log):
    loose = [(None, None, "2024-01", 1.0), (None, None, "2024-01", 1.0), ("c1", "F1", "sin fecha", 2.0), ("c1", "F1", "sin fecha", 2.0), ("c1", None, "2024-01", 3.0)]
    log.land(batch(spark, loose), 0)
    log.land(batch(spark, [(None, None, "2024-01", 4.0)]), 1)
    want = sorted([*loose, (None, None, "2024-01", 4.0)], key=str)
    got = content(log)
    assert got == want and feeders_of(log.touched()) == ["F1", "None"]
    log.compact()
    assert content(log) == want
    log.land(batch(spark, [("c1", "F1", "2024-01", 9.0)]), 2)
    log.compact()
    assert content(log) == sorted([*want, ("c1", "F1", "2024-01", 9.0)], key=str)


def test_a_batch_that_broke_off_and_a_compaction_that_broke_off(spark, log, tmp_path):
    log.land(batch(spark, [("c1", "F1", "2024-01", 10.0)]), 0)
    before = content(log)
    # rows without their sums did not land to the end
    half = batch(spark, [("c1", "F1", "2024-01", 99.0)]).withColumn("batch_id", F.lit(1).cast("long"))
    half.write.partitionBy("batch_id", "feeder_id").parquet(str(tmp_path / "half"))
    (tmp_path / "half" / "batch_id=1").rename(tmp_path / "log" / "batches" / "batch_id=1")
    assert content(log) == before
    writer = Snapshots(spark, str(tmp_path / "log" / "base")).begin()
    writer.write("log", "consumption", batch(spark, [("c1", "F1", "2024-01", 5.0)]), spark.createDataFrame([("F1",)], "feeder_id string"))
    assert content(log) == before
    log.land(batch(spark, [("c1", "F1", "2024-01", 11.0)]), 1)
    assert content(log) == [("c1", "F1", "2024-01", 11.0)]


def test_batches_add_up_to_the_content_of_the_whole(spark, log):
    rows = [(f"c{i}", f"F{i % 3}", "2024-01", i * 1.25) for i in range(40)]
    log.land(batch(spark, rows[:25]), 0)
    first = {r.feeder_id: r.input_hash for r in incremental.hash_of_sums(log.sums().drop("batch_id"), "x").collect()}
    log.land(batch(spark, [r for r in rows[25:] if r[1] != "F2"]), 1)
    later = {r.feeder_id: r.input_hash for r in incremental.hash_of_sums(log.sums().drop("batch_id"), "x").collect()}
    assert first["F2"] == later["F2"] and first["F0"] != later["F0"]
    log.land(batch(spark, [r for r in rows[25:] if r[1] == "F2"]), 2)
    whole = incremental.input_hash({"consumption": batch(spark, rows).repartition(3)}, "x")
    assert dict(whole.collect()) == dict(incremental.hash_of_sums(log.sums().drop("batch_id"), "x").collect())

    def number(c, f, y, k):
        text = "\x1f".join([c, "false", f, "\\N", f"{k:.6f}", y])
        return int(hashlib.md5(text.encode()).hexdigest()[:16], 16)

    sums = {r.feeder_id: (int(r.h), r.n) for r in incremental.add_sums(log.sums().drop("batch_id")).collect()}
    for f in ("F0", "F1", "F2"):
        mine = [number(*r) for r in rows if r[1] == f]
        assert sums[f] == (sum(mine) % 2**64, len(mine))
