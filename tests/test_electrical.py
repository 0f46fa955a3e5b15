"""Hand-computed values of the scalar relations and of the transformer banks."""

import math

import pytest
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions import domains as D
from wattledger.functions import electrical as E
from wattledger.operators import bank


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_formulas(spark):
    row = one(
        spark,
        fp=E.loss_factor(F.lit(0.5), 0.15),
        bad_fc=E.loss_factor(F.lit(1.5)),
        s=E.s_from_pq(F.lit(140.0), F.lit(140.0)),
        pf0=E.pf_from_energy(F.lit(0.0), F.lit(0.0)),
        balanced=E.neutral_current(F.lit(10.0), F.lit(10.0), F.lit(10.0)),
        single=E.neutral_current(F.lit(10.0), F.lit(0.0), F.lit(0.0)),
        coin=E.coincidence(F.lit(4)),
        tx=E.tx_energy_loss_kwh(F.lit(0.1), F.lit(0.5), F.lit(25.0), F.lit(50.0), F.lit(0.2), F.lit(100.0)),
        i3=E.current_3ph(F.lit(100.0), F.lit(13800.0)),
        no_hours=E.mean_power_kw(F.lit(1.0), F.lit(0.0)),
    )
    assert row.fp == pytest.approx(0.2875)
    assert row.bad_fc is None and row.no_hours is None
    assert row.s == pytest.approx(math.hypot(140, 140))
    assert row.pf0 == 1.0
    assert row.balanced == pytest.approx(0.0, abs=1e-9) and row.single == pytest.approx(10.0)
    assert row.coin == pytest.approx(0.6)
    assert row.tx == pytest.approx(0.1 * 100 + 0.5 * 0.25 * 0.2 * 100)
    assert row.i3 == pytest.approx(100_000 / (math.sqrt(3) * 13800))


def test_loss_factor_stays_between_square_and_value(spark):
    grid = spark.range(0, 101).select((F.col("id") / 100).alias("fc")).withColumn("fp", E.loss_factor("fc"))
    assert grid.where("fp < fc * fc - 1e-9 or fp > fc + 1e-9").count() == 0


def test_night_is_longer_in_december_in_the_north(spark):
    row = one(spark, dec=E.night_hours(F.lit(45.0), F.lit(350)), jun=E.night_hours(F.lit(45.0), F.lit(170)), eq=E.night_hours(F.lit(0.0), F.lit(80)))
    assert row.dec > 14 and row.jun < 9 and row.eq == pytest.approx(11.9, abs=0.1)


BANKS = [
    ("single", [50.0], 50.0, 0.0),
    ("wye_closed", [25.0, 50.0, 50.0], 75.0, 50.0),
    ("open_delta", [50.0, 50.0], math.sqrt(3) * 50, 0.0),
    ("delta_4wire", [50.0, 50.0, 100.0], 150.0, 50.0),
    ("independent", [10.0, 15.0], 25.0, 0.0),
]


def test_bank_capacity_and_flags(spark):
    sites = [(f"S{i}", "F1", c) for i, (c, *_rest) in enumerate(BANKS)] + [("BAD", "F1", "delta_closed"), ("VOLT", "F1", "open_delta")]
    units = [(f"S{i}", kva, 0.1, 0.5, 220.0) for i, (_c, kvas, *_r) in enumerate(BANKS) for kva in kvas]
    units += [("BAD", 50.0, 0.1, 0.5, 220.0)] * 2 + [("VOLT", 50.0, 0.1, 0.5, 220.0), ("VOLT", 50.0, 0.1, 0.5, 127.0)]
    s = spark.createDataFrame(sites, "site_id string, feeder_id string, bank_config string")
    u = spark.createDataFrame(units, "site_id string, sn_kva double, p0_kw double, pk_kw double, voltage_ln double")
    rows = {r.site_id: r for r in bank.banks(s, u, P.settings()).collect()}
    for i, (_c, _k, cap, head) in enumerate(BANKS):
        assert rows[f"S{i}"].capacity_kva == pytest.approx(cap) and rows[f"S{i}"].headroom_kva == pytest.approx(head)
        assert rows[f"S{i}"].bank_quality_flags == ""
    assert rows["BAD"].capacity_kva is None and rows["BAD"].bank_quality_flags == "P03"
    assert rows["VOLT"].bank_quality_flags == "P04"


def test_bank_load_losses(spark):
    u = spark.createDataFrame([("U1", "S", 50.0, 0.6), ("U2", "S", 50.0, 0.6)], "unit_id string, site_id string, sn_kva double, pk_kw double")
    loads = spark.createDataFrame([("U1", 50.0), ("U2", 25.0)], "unit_id string, load_kva double")
    assert bank.load_losses(u, loads).first().load_loss_kw == pytest.approx(0.75)


def test_domain_decoding(spark):
    phases = {"4": "A", "2": "B", "1": "C", "7": "ABC", "6": "AB", "5": "CA", " ab ": "AB", "9": None, "x": None}
    df = spark.createDataFrame([(k,) for k in phases], "v string").select("v", D.decode_phase("v").alias("p"))
    assert {r.v: r.p for r in df.collect()} == phases
    banks = [("Delta Abierta", 2, "open_delta"), ("Monofasico", 1, "single"), ("???", 2, "open_delta"), (None, 5, "independent")]
    df = spark.createDataFrame(banks, "v string, n int, want string").withColumn("got", D.decode_bank_config("v", "n"))
    assert df.where("not (want <=> got)").count() == 0
    texts = [("RESIDENCIAL-A", "residential"), ("INDUSTRIAL ARTESANAL", "industrial"), ("zzz", "residential"), (None, "residential"), ("Otros", "commercial")]
    df = spark.createDataFrame(texts, "v string, want string").withColumn("got", D.decode_tariff("v"))
    assert df.where("want <> got").count() == 0
    kva = [("37,5", 37.5), ("50 kVA", 50.0), ("n/a", None)]
    df = spark.createDataFrame(kva, "v string, want double").withColumn("got", D.parse_kva("v"))
    assert df.where("not (want <=> got)").count() == 0
    p0, pk = D.catalog_losses(F.col("sn"))
    got = {r.sn: r.p0 for r in spark.createDataFrame([(50.0,), (37.5,), (999.0,)], "sn double").select("sn", p0.alias("p0")).collect()}
    assert got == {50.0: 0.145, 37.5: 0.115, 999.0: 2.997}
