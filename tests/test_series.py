"""Series of meters and the array arithmetic on them."""

import pytest
from pyspark.sql import functions as F

from wattledger.operators import features as X
from wattledger.operators import labels as L
from wattledger.operators import series as S
from wattledger.plans.run import Run
from wattledger.sources.bench_tables import BenchTables, bench_settings

# cuts at 5 and at 10 or 15 cost the same; the sums of the SQL decide, to the last bit
EQUAL_COSTS = [
    [27, 15, 52, 0, 30, 71, 38, 52, 0, 102, 138, 34, 17, 125, 88, 22, 21, 32, 0, 102, 16, 31, 11, 0, 53, 0, 0, 29],
    [65, 35, 34, 57, 119, 56, 31, 82, 0, 24, 56, 0, 0, 73, 36, 0, 0, 0, 48, 0, 42, 74, 117, 0, 49, 69, 96, 47],
]


def test_breaks_of_equal_cost_as_in_sql(spark):
    rows = [(f"C{i}", [60.0 * v for v in values]) for i, values in enumerate([*EQUAL_COSTS, [1.0] * 10 + [9.0] * 18])]
    found = L.level_break(spark.createDataFrame(rows, "customer_unit_id string, kwh array<double>")).collect()
    assert [(r.customer_unit_id, r.evidence.split()[-1]) for r in found] == [("C2", "10")]


def test_running_deviation(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0],), ([3.0],), ([],)], "a array<double>")
    got = [r.sd for r in rows.select(S.std_running(F.col("a")).alias("sd")).collect()]
    assert got[0] == pytest.approx(9.5**0.5) and got[1:] == [0.0, None]


def test_median_sorts_once(spark):
    """One evaluation of the slopes per meter: seven made the trend the longest step of the features."""
    rows = spark.createDataFrame([([3.0, None, 1.0, 2.0],), ([1.0, 2.0],), ([None],), ([],)], "a array<double>")
    assert [r.m for r in rows.select(S.median(F.col("a")).alias("m")).collect()] == [2.0, 1.5, None, None]
    trend = rows.select(X.theil_sen(F.col("a")).alias("t"))
    plan = trend._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1 and "array_sort(" not in plan
    full = spark.createDataFrame([([1.0, 3.0, 2.0, 7.0],), ([5.0],)], "a array<double>")
    assert [r.t for r in full.select(X.theil_sen(F.col("a")).alias("t")).collect()] == [2.0, 0.0]


def test_series_with_and_without_gaps(spark):
    rows = [("F00", "A", "2020-01", 1.0, 0.5, True), ("F00", "A", "2020-04", 2.0, None, False), ("F00", "A", "2020-04", 3.0, 0.25, True)]
    rows += [("F00", "B", "2020-04", 4.0, 1.0, False)]
    schema = "feeder_id string, customer_unit_id string, year_month string, kwh double, kvarh double, estimated boolean"
    frame = S.series(spark.createDataFrame(rows, schema))
    got = {r.customer_unit_id: (r.months, r.kwh, r.kvarh, r.est) for r in frame.collect()}
    months = ["2020-01", "2020-04"]
    assert got == {"A": (months, [1.0, 5.0], [0.5, 0.25], [1.0, 0.5]), "B": (months, [0.0, 4.0], [0.0, 1.0], [0.0, 0.0])}
    # months are looked up only where a meter lacks some
    assert "sort_array(collect_list" in frame._jdf.queryExecution().analyzed().toString()


def test_tables_with_own_series(spark, tmp_path):
    """One row per meter gives the series and the heads that the readings give, and line items are joined once for all."""
    tables = BenchTables(spark, "/root/testdata/sf0.001")
    run = Run(tables, bench_settings())
    order = ["feeder_id", "customer_unit_id"]
    own, made = tables.series, S.series(run.consumption)
    assert own.dtypes == made.dtypes and own.count() == tables.customers.count()
    assert own.orderBy(*order).collect() == made.orderBy(*order).collect()
    for table in (run.series, tables.consumption, tables.header_meters, tables.readings):
        assert "lineitem" not in "".join(table.select(table.columns[0], "kwh").inputFiles())
    # a meter that is no customer keeps its readings and has no place in a feeder
    spark.createDataFrame([(1, 3, 0.0, "BUILDING")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 9), (2, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 2.0, 0.1, 0.0, "R", "1994-02-01"), (2, 1.0, 0.1, 0.0, "N", "1994-05-01")]
    line = "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate string"
    spark.createDataFrame(lines, line).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    few = BenchTables(spark, str(tmp_path))
    assert sorted((r.c_custkey, r.kwh) for r in few.readings.collect()) == [(1, 60.0), (9, 120.0)]
    assert [(r.customer_unit_id, r.kwh) for r in few.series.collect()] == [("C1", [0.0, 60.0])]
    assert [(r.feeder_id, round(r.kwh, 6)) for r in few.header_meters.collect()] == [("F03", 67.2)]
