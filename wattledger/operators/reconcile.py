"""Reconciliation of P and Q, phase imbalance, and loss uncertainty."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions import electrical as E
from wattledger.functions.numeric import rnd


def imbalance(demand: DataFrame, periods: DataFrame, cfg: dict) -> DataFrame:
    """Phase currents, neutral current and rebalancing benefit per transformer site."""
    e = cfg["electrical"]
    hours = F.col("n_periods") * P.hours_per_period(cfg)
    kwh = {p: F.sum(F.when(F.col("phase") == p, F.col("kwh_total")).otherwise(0.0)) for p in "ABC"}
    site = (
        demand.where(F.coalesce("transformer_site_id", F.lit("")) != "")
        .groupBy(F.col("transformer_site_id").alias("site_id"))
        .agg(F.min("feeder_id").alias("feeder_id"), *[c.alias(p) for p, c in kwh.items()])
        .join(periods, "feeder_id")
    )
    amps = {p: E.mean_power_kw(p, hours) * 1000.0 / e["voltage"]["ln_lv"] for p in "ABC"}
    rows = site.select("feeder_id", "site_id", hours.alias("h"), *[c.alias(f"i_{p.lower()}") for p, c in amps.items()])
    mean = (F.col("i_a") + F.col("i_b") + F.col("i_c")) / 3.0
    rows = rows.withColumn("mean", mean).where(F.col("mean") > 0)
    spread = F.greatest(*[F.abs(F.col(f"i_{p}") - F.col("mean")) for p in "abc"])
    rows = rows.withColumn("pct", spread / F.col("mean") * 100.0).withColumn(
        "i_n", E.neutral_current("i_a", "i_b", "i_c")
    )
    loss = F.col("i_n") * F.col("i_n") * e["neutral_r_ohm"] * P.loss_factor_value(cfg) * F.col("h") / 1000.0
    return rows.select(
        "feeder_id",
        "site_id",
        rnd("i_a", 2).alias("i_a"),
        rnd("i_b", 2).alias("i_b"),
        rnd("i_c", 2).alias("i_c"),
        rnd("i_n", 2).alias("i_neutral"),
        rnd("pct", 1).alias("imbalance_pct"),
        (F.col("pct") > cfg["thresholds"]["imbalance_warn_pct"]).alias("flagged"),
        rnd(loss, 1).alias("neutral_loss_kwh"),
        rnd(loss, 1).alias("rebalance_benefit_kwh"),
    )


def _pq(energy: DataFrame, customers: DataFrame, cfg: dict) -> DataFrame:
    """Corrected and naive P, Q, S, I per feeder, unrounded."""
    e = cfg["electrical"]
    monthly = F.col("kwh_total") / F.col("n_readings") / cfg["months_per_period"]
    meters = energy.join(customers.select("customer_unit_id", "tariff_class"), "customer_unit_id", "left").select(
        "feeder_id", monthly.alias("e"), F.coalesce("tariff_class", F.lit("residential")).alias("cls")
    )
    used = F.greatest(F.col("e"), F.lit(0.0))
    weight = used + 1e-9
    sums = meters.groupBy("feeder_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(E.velander_kw(used, "cls")).alias("peaks"),
        (F.sum(E.class_pf("cls") * weight) / F.sum(weight)).alias("pf"),
        F.sum("e").alias("energy"),
    )
    v = e["voltage"]["ll_mv"]
    return (
        sums.withColumn("p", E.coincidence("n", e["coincidence"]) * F.col("peaks"))
        .withColumn("q", F.col("p") * E.tan_of_pf("pf"))
        .withColumn("s", F.hypot("p", "q"))
        .withColumn("i", E.current_3ph("s", F.lit(v)))
        .withColumn("p_mean", F.col("energy") / e["hours_per_month"])
        .withColumn("q_flat", F.col("p") * math.tan(math.acos(e["naive_pf_default"])))
        .withColumn("i_no_sqrt3", F.col("s") * 1000.0 / v)
    )


def _deviation(current: str, corrected: str) -> Column:
    c = F.col(corrected)
    return rnd(F.when(c != 0, (F.col(current) - c) / c * 100.0).otherwise(F.lit(0.0)), 2)


def pq_reconcile(energy: DataFrame, customers: DataFrame, cfg: dict) -> DataFrame:
    return _pq(energy, customers, cfg).select(
        "feeder_id",
        F.col("n").alias("n_customers"),
        rnd("pf", 4).alias("pf_agg"),
        rnd("p", 2).alias("p_corr_kw"),
        rnd("q", 2).alias("q_corr_kvar"),
        rnd("s", 2).alias("s_corr_kva"),
        rnd("i", 2).alias("i_corr_a"),
        rnd("peaks", 2).alias("p_naive_sumpeaks_kw"),
        rnd("p_mean", 2).alias("p_naive_meandemand_kw"),
        rnd("q_flat", 2).alias("q_naive_cosphi_kvar"),
        rnd("i_no_sqrt3", 2).alias("i_naive_no_sqrt3_a"),
        _deviation("peaks", "p").alias("dp_coincidence_pct"),
        _deviation("i_no_sqrt3", "i").alias("di_sqrt3_pct"),
    )


# cause -> (unit, corrected, current), in report order (fixed values)
CAUSES = {
    "coincidencia (sumar picos)": ("kW", "p", "peaks"),
    "energia_vs_demanda (usar media)": ("kW", "p", "p_mean"),
    "cosphi_sobre_energia": ("kVAr", "q", "q_flat"),
    "factor_sqrt3 (omitido)": ("A", "i", "i_no_sqrt3"),
}


def pq_causes(energy: DataFrame, customers: DataFrame, cfg: dict) -> DataFrame:
    """One row per feeder and cause of deviation."""
    entries = [
        F.struct(
            F.lit(name).alias("cause"),
            F.lit(unit).alias("unit"),
            rnd(good, 2).alias("corrected"),
            rnd(bad, 2).alias("current"),
            rnd(F.col(bad) - F.col(good), 2).alias("delta"),
            _deviation(bad, good).alias("pct"),
        )
        for name, (unit, good, bad) in CAUSES.items()
    ]
    rows = _pq(energy, customers, cfg).select("feeder_id", F.explode(F.array(*entries)).alias("c"))
    return rows.select("feeder_id", "c.*")


def pq_system(reconciliation: DataFrame) -> DataFrame:
    return reconciliation.agg(
        F.count(F.lit(1)).alias("feeders"), rnd(F.avg("dp_coincidence_pct"), 2).alias("system_dp_coincidence_pct")
    )


def lognormal_factors(cfg: dict) -> list[float]:
    """The run's seeded mean-one draws; every feeder is scaled by the same ones."""
    mc = cfg["montecarlo"]
    var = math.log(1.0 + mc["sigma_technical"] ** 2)
    rng = np.random.default_rng(mc["seed"])
    return [float(x) for x in rng.lognormal(-0.5 * var, math.sqrt(var), mc["n_samples"])]


def loss_uncertainty(balance: DataFrame, cfg: dict) -> DataFrame:
    """P10/P50/P90 of technical and non-technical loss per feeder."""
    mc = cfg["montecarlo"]
    # every feeder is scaled by the same draws, so its percentiles are those of the draws times its loss
    p10, p50, p90 = (float(x) for x in np.percentile(lognormal_factors(cfg), (10, 50, 90)))
    tech, losses = F.col("energy_technical_kwh"), F.col("losses_total_kwh")
    out = [rnd(tech * f, 1).alias(f"technical_{label}") for label, f in (("p10", p10), ("p50", p50), ("p90", p90))]
    out += [rnd(losses - tech * f, 1).alias(f"pnt_{label}") for label, f in (("p10", p90), ("p50", p50), ("p90", p10))]
    return balance.select(
        "feeder_id", *out, F.lit(mc["n_samples"]).alias("n_samples"), F.lit(mc["sigma_technical"]).alias("sigma_technical")
    )
