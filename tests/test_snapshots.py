"""Runs as snapshots: what a run replaces, what it leaves, and what a broken run changes."""

import pytest
from pyspark.sql import functions as F

from wattledger.plans import batch
from wattledger.sources.bench_tables import BenchTables, bench_settings
from wattledger.sources.lake import Lake
from wattledger.sources.snapshots import Snapshots

ROWS = "feeder_id string, rule string, n long"


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def feeders(spark, names):
    return frame(spark, [(n,) for n in names], "feeder_id string")


def content(store, entity, run=None):
    return sorted(map(tuple, store.read("gold", entity, run).collect()))


def first_run(spark, store):
    writer = store.begin()
    writer.write("gold", "findings", frame(spark, [("F1", "R1", 1), ("F1", "R2", 2), ("F2", "R1", 3), ("03", "R1", 4)]), feeders(spark, ["F1", "F2", "03"]))
    writer.write("gold", "balance", frame(spark, [("F1", "b", 1), ("F2", "b", 2), ("03", "b", 3)]), feeders(spark, ["F1", "F2", "03"]))
    writer.write("system", "totals", frame(spark, [(6,)], "n long"))
    return writer.commit(feeders(spark, ["F1", "F2", "03"]))


def test_a_feeder_that_loses_all_rows_and_one_that_disappears(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    one = first_run(spark, store)
    # F1 is analysed again and has no findings any more; F2 is unchanged; 03 is gone
    writer = store.begin()
    writer.write("gold", "findings", frame(spark, []), feeders(spark, ["F1"]))
    writer.write("gold", "balance", frame(spark, [("F1", "b", 10)]), feeders(spark, ["F1"]))
    assert sorted(map(tuple, writer.read("gold", "balance").collect())) == [("03", "b", 3), ("F1", "b", 10), ("F2", "b", 2)]
    writer.commit(feeders(spark, ["F1", "F2"]))
    assert content(store, "findings") == [("F2", "R1", 3)]
    assert content(store, "balance") == [("F1", "b", 10), ("F2", "b", 2)]
    assert [r.n for r in store.read("system", "totals").collect()] == [6]
    # the earlier run stays readable, until it is cleared
    assert content(store, "findings", one) == [("03", "R1", 4), ("F1", "R1", 1), ("F1", "R2", 2), ("F2", "R1", 3)]
    assert store.clear(keep=1) == [one]
    assert content(store, "findings") == [("F2", "R1", 3)] and content(store, "balance") == [("F1", "b", 10), ("F2", "b", 2)]
    with pytest.raises(ValueError):
        store.read("gold", "findings", one)


def test_a_broken_run_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    first_run(spark, store)
    before = content(store, "findings")
    broken = store.begin()
    broken.write("gold", "findings", frame(spark, [("F1", "half", 0)]), feeders(spark, ["F1"]))
    assert content(store, "findings") == before
    # a manifest that was not written to its end does not count either
    broken.manifest(None).write.parquet(f"{tmp_path}/manifests/{broken.run}")
    (tmp_path / "manifests" / broken.run / "_SUCCESS").unlink()
    assert content(store, "findings") == before and len(store.runs()) == 1
    again = store.begin()
    again.write("gold", "findings", frame(spark, [("F1", "whole", 1)]), feeders(spark, ["F1"]))
    again.commit()
    assert ("F1", "whole", 1) in content(store, "findings") and not any(r[1] == "half" for r in content(store, "findings"))
    # what the broken run left behind goes with the next clearing
    store.clear(keep=2)
    assert not (tmp_path / "gold" / "findings" / f"run={broken.run}").exists()


def test_tables_replaced_as_a_whole_and_tables_never_filled(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.read("gold", "findings").columns == [] and store.manifest().count() == 0
    for n in (1, 2):
        writer = store.begin()
        writer.write("gold", "risk", frame(spark, [(f"F{n}", "r", n)]))
        writer.write("gold", "none", frame(spark, []), feeders(spark, ["F1"]))
        writer.commit()
    assert content(store, "risk") == [("F2", "r", 2)]
    empty = store.read("gold", "none")
    assert empty.columns == ["feeder_id", "rule", "n"] and empty.count() == 0


class Changing(batch.Selected):
    """Some feeders of the test tables; the readings of the first one may be multiplied."""

    def __init__(self, tables, names, factor=1.0):
        super().__init__(tables, feeders(tables.spark, names))
        kwh = F.when(F.col("feeder_id") == "F00", F.col("kwh") * factor).otherwise(F.col("kwh"))
        self._made["consumption"] = tables.consumption.join(self._feeders, "feeder_id", "left_semi").withColumn("kwh", kwh)


def light(findings_of):
    """A level with the balance and findings of given feeders only."""

    def tables(run):
        balance = run.balance
        found = balance.where(F.col("feeder_id").isin(findings_of)).select("feeder_id", F.lit("R00").alias("rule_id"))
        return {"feeder_balance": balance, "data_quality_findings": found, "feeder_topology": balance.select("feeder_id", "n_customers")}

    return tables, None, None


def test_runs_of_changing_feeders(spark, tmp_path, monkeypatch):
    tables, cfg, lake = BenchTables(spark, "/root/testdata/sf0.001"), bench_settings(), Lake(spark, str(tmp_path))
    gold = lambda name: sorted(r.feeder_id for r in lake.snapshots.read("gold", name).select("feeder_id").collect())
    monkeypatch.setitem(batch.LEVELS, "screening", light(["F00", "F01"]))
    assert batch.analyse(Changing(tables, ["F00", "F01", "F02"]), cfg, lake).count() == 3
    assert gold("data_quality_findings") == ["F00", "F01"]
    status = {r.feeder_id: r for r in lake.snapshots.read("gold", "feeder_status").collect()}
    assert set(status) == {"F00", "F01", "F02"} and status["F00"].stages_done_list == "balance,electrical,ingest,topology"
    # F00 changes and loses its findings, F02 disappears, F01 is not asked for
    monkeypatch.setitem(batch.LEVELS, "screening", light([]))
    found = batch.analyse(Changing(tables, ["F00", "F01"], 2.0), cfg, lake, force=True, feeders=["F00"])
    assert [r.feeder_id for r in found.collect()] == ["F00"] and gold("data_quality_findings") == ["F01"]
    assert gold("feeder_balance") == gold("feeder_status") == gold("credited_balance") == ["F00", "F01"]
    # a run that breaks off leaves everything as it was
    runs = lake.snapshots.runs()

    def breaks(run):
        raise RuntimeError("lost")

    monkeypatch.setitem(batch.LEVELS, "screening", (lambda run: {"feeder_balance": run.balance.limit(0)}, breaks, None))
    with pytest.raises(RuntimeError):
        batch.analyse(Changing(tables, ["F00", "F01"], 3.0), cfg, lake)
    assert lake.snapshots.runs() == runs and gold("feeder_balance") == ["F00", "F01"]
