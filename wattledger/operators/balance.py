"""Loadability per transformer site and the energy balance per feeder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions import electrical as E
from wattledger.functions.numeric import listed, rnd
from wattledger.operators import bank, lighting, loadpoint


def stack(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of partial rows; a column a part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())


def header_totals(header: DataFrame) -> DataFrame:
    return header.groupBy("feeder_id").agg(
        F.sum("kwh").alias("energy_header"), F.count(F.lit(1)).alias("n_periods")
    )


def classify(loadability: Column, bounds: dict) -> Column:
    names = list(bounds)
    expr = F.when(loadability > bounds[names[0]], F.lit(names[0]))
    for name in names[1:]:
        expr = expr.when(loadability >= bounds[name], F.lit(name))
    return F.when(loadability.isNotNull(), expr.otherwise(F.lit("very_underutilized")))


def outage_energy(events: DataFrame) -> DataFrame:
    """Energy not supplied by faults per feeder; it is no loss."""
    return (
        events.where(F.col("motivo") == "falla")
        .groupBy("feeder_id")
        .agg(F.sum(F.col("duration_h") * F.col("affected_kw")).alias("ens_kwh"))
    )


def site_loading(t, demand: DataFrame, head: DataFrame, cfg: dict) -> DataFrame:
    """Unrounded capacity, demand, ratio and loss per site.

    ``t`` holds the entity tables, ``demand`` is ``loadpoint.metered(t, cfg)`` and ``head``
    is ``header_totals``.  Units, meters, lamps and load points are stacked and reduced
    by site in one shuffle.
    """
    e = cfg["electrical"]
    site = F.col("transformer_site_id").alias("site_id")
    parts = {
        "unit": t.transformer_units.select("site_id", *bank.UNIT_FIELDS),
        "meter": demand.select(site, F.col("kwh_total").alias("billed")),
        "lamp": t.streetlights.select(site, lighting.lamp_kw(cfg).alias("lamp_kw")),
        "point": loadpoint.point_kva(demand, cfg).select(site, F.col("s_max_kva").alias("point_kva")),
    }
    stacked = stack(parts).where(F.col("site_id").isNotNull())
    totals = stacked.groupBy("site_id").agg(
        *bank.unit_aggregates(),
        F.coalesce(F.sum("billed"), F.lit(0.0)).alias("billed"),
        F.coalesce(F.sum("lamp_kw"), F.lit(0.0)).alias("lamp_kw"),
        F.sum("point_kva").alias("point_kva"),
        F.count("point_kva").alias("n_points"),
    )
    config = F.col("bank_config")
    sites = (
        t.sites.join(totals.where("n_units > 0"), "site_id")
        .join(head.select("feeder_id", "n_periods"), "feeder_id")
        .withColumn("capacity_kva", bank.capacity(config, cfg["thresholds"]["open_delta_factor"]))
        .withColumn("headroom_kva", bank.headroom(config))
        .withColumn("bank_quality_flags", bank.quality_flags(config))
    )
    hours = F.col("n_periods") * P.hours_per_period(cfg)
    ap_kwh = F.col("lamp_kw") * lighting.hours_lit(cfg, F.col("n_periods"))
    fc_pf = e["default_load_factor"] * e["default_site_pf"]
    from_points = E.coincidence("n_points", e["coincidence"]) * F.col("point_kva") + ap_kwh / hours / fc_pf
    fallback = F.greatest((F.col("billed") + ap_kwh) / hours / fc_pf, F.lit(0.0))
    s_max = F.when(F.col("n_points") > 0, from_points).otherwise(fallback)
    loading = F.when(F.col("capacity_kva") > 0, F.col("s_max") / F.col("capacity_kva")).when(
        F.col("capacity_kva").isNotNull(), F.lit(0.0)
    )
    return (
        sites.withColumn("s_max", s_max)
        .withColumn("loss_kwh", bank.site_energy_loss(F.col("s_max"), P.loss_factor_value(cfg), hours))
        .withColumn("ratio", loading)
    )


def loadability_table(loading: DataFrame, cfg: dict) -> DataFrame:
    return loading.select(
        "feeder_id",
        "site_id",
        "pole_id",
        "bank_config",
        "n_units",
        rnd("capacity_kva", 2).alias("capacity_kva"),
        rnd("s_max", 2).alias("s_max_kva"),
        rnd("ratio", 4).alias("loadability"),
        classify(F.col("ratio"), cfg["loadability"]).alias("loadability_class"),
        rnd("headroom_kva", 2).alias("single_phase_headroom_kva"),
        rnd("loss_kwh", 1).alias("energy_technical_kwh"),
        "bank_quality_flags",
    )


def secondary_loss(energy_delivered: Column, cfg: dict) -> Column:
    return energy_delivered * cfg["electrical"]["secondary_loss_frac"] * P.loss_factor_value(cfg)


def checks(cfg: dict) -> list[tuple[str, Column]]:
    """(name, failed) in report order; they test physics, not the accounting identity."""
    th = cfg["thresholds"]
    accounted = F.col("billed") + F.col("ap") + F.col("ens")
    total, technical = F.col("total_pct"), F.col("tech_pct")
    return [
        ("pnt_non_negative", F.col("pnt") < 0),
        ("accounted_within_header", accounted > F.col("header") * 1.0001),
        ("total_losses_plausible", ~total.between(0.0, th["total_losses_max_pct"])),
        ("technical_plausible", ~technical.between(th["technical_min_pct"], th["technical_max_pct"])),
        ("header_positive", F.col("header") <= 0),
    ]


def close_balance(inputs: DataFrame, cfg: dict) -> DataFrame:
    """From (header, billed, ap, ens, transferred, technical, counts) to the balance row."""

    def pct(c: Column) -> Column:
        return F.when(F.col("header") != 0, c / F.col("header") * 100.0).otherwise(F.lit(0.0))

    losses = F.col("header") + F.col("transferred") - F.col("billed") - F.col("ap") - F.col("ens")
    rows = (
        inputs.withColumn("losses", losses)
        .withColumn("pnt", F.col("losses") - F.col("technical"))
        .withColumn("total_pct", pct(F.col("losses")))
        .withColumn("tech_pct", pct(F.col("technical")))
        .withColumn("failed_checks", listed(*checks(cfg)))
    )
    return rows.select(
        "feeder_id",
        rnd("header", 1).alias("energy_header_kwh"),
        rnd("billed", 1).alias("energy_billed_kwh"),
        rnd("ap", 1).alias("energy_streetlight_kwh"),
        rnd("ens", 1).alias("energy_ens_kwh"),
        rnd("transferred", 1).alias("energy_transferred_kwh"),
        rnd("technical", 1).alias("energy_technical_kwh"),
        rnd("losses", 1).alias("losses_total_kwh"),
        rnd("pnt", 1).alias("pnt_kwh"),
        rnd(pct(F.col("pnt")), 3).alias("pnt_pct"),
        rnd("tech_pct", 3).alias("technical_pct"),
        rnd("total_pct", 3).alias("total_losses_pct"),
        (F.col("failed_checks") == "").alias("balance_coherent"),
        "failed_checks",
        (F.col("pnt") < 0).alias("pnt_negative_alert"),
        "n_customers",
        "n_tx_sites",
        "n_streetlights",
        F.col("n_periods").alias("n_months"),
    )


def balance_inputs(t, demand: DataFrame, head: DataFrame, cfg: dict) -> DataFrame:
    """One row per feeder with a head meter.

    All sources are stacked under one feeder key, so the whole balance is a single
    map-side combined aggregate instead of a chain of joins.
    """
    faults = t.switching_events.where(F.col("motivo") == "falla")
    one = F.lit(1).cast("long")
    parts = {
        "head": head.select("feeder_id", F.col("energy_header").alias("header"), "n_periods"),
        "meter": demand.select("feeder_id", F.col("kwh_total").alias("billed"), one.alias("n_customers")),
        "lamp": t.streetlights.select("feeder_id", lighting.lamp_kw(cfg).alias("lamp_kw"), one.alias("n_streetlights")),
        "fault": faults.select("feeder_id", (F.col("duration_h") * F.col("affected_kw")).alias("ens")),
        "site": t.sites.select("feeder_id", one.alias("n_tx_sites")),
        "loss": site_loading(t, demand, head, cfg).select("feeder_id", F.col("loss_kwh").alias("site_loss")),
    }
    names = ("header", "n_periods", "billed", "n_customers", "lamp_kw", "n_streetlights", "ens", "n_tx_sites", "site_loss")
    rows = stack(parts).groupBy("feeder_id").agg(*[F.sum(n).alias(n) for n in names])
    rows = rows.where(F.col("n_periods") > 0).na.fill(0)
    ap = F.col("lamp_kw") * lighting.hours_lit(cfg, F.col("n_periods"))
    return rows.withColumn("ap", ap).select(
        "feeder_id",
        "header",
        "billed",
        "ap",
        "ens",
        F.lit(0.0).alias("transferred"),
        (F.col("site_loss") + secondary_loss(F.col("billed") + F.col("ap"), cfg)).alias("technical"),
        "n_customers",
        "n_tx_sites",
        "n_streetlights",
        "n_periods",
    )


def apply_credits(inputs: DataFrame, credits: DataFrame, cfg: dict) -> DataFrame:
    """Balance with the transferred energy credited; every derived column is refreshed."""
    credited = inputs.drop("transferred").join(
        credits.select("feeder_id", F.col("transferred_kwh").alias("transferred")), "feeder_id", "left"
    )
    return close_balance(credited.na.fill(0.0, ["transferred"]), cfg)


def reliability(findings: DataFrame, edges: DataFrame, balance: DataFrame) -> DataFrame:
    """Model reliability 0-100 per feeder from finding density and balance coherence."""
    weight = F.sum(
        F.when(F.col("severity") == "critica", P.SEVERITY_WEIGHT["critica"])
        .when(F.col("severity") == "alta", P.SEVERITY_WEIGHT["alta"])
        .when(F.col("severity") == "media", P.SEVERITY_WEIGHT["media"])
        .otherwise(0.0)
    )
    per_feeder = findings.groupBy("feeder_id").agg(
        weight.alias("points"), F.count(F.lit(1)).alias("n_findings")
    )
    size = edges.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n_edges"))
    rows = (
        balance.select("feeder_id", "balance_coherent")
        .join(size, "feeder_id", "left")
        .join(per_feeder, "feeder_id", "left")
        .na.fill(0)
    )
    density = F.col("points") / F.greatest(F.col("n_edges"), F.lit(1))
    quality = F.least(density, F.lit(1.0)) * 80.0
    coherence = F.when(F.col("balance_coherent"), F.lit(0.0)).otherwise(F.lit(20.0))
    return rows.select(
        "feeder_id",
        rnd(F.greatest(F.lit(0.0), F.lit(100.0) - quality - coherence), 1).alias("reliability_index"),
        rnd(quality, 1).alias("quality_penalty"),
        coherence.alias("balance_penalty"),
        "n_findings",
    )


def risk_proxy(series: DataFrame, cfg: dict) -> DataFrame:
    """Largest drop below the first third's median, per meter (series arrays are bounded)."""
    drop = cfg["thresholds"]["drop_recovery_pct"]
    n = F.size("kwh")
    third = F.array_sort(F.slice("kwh", F.lit(1), F.expr("size(kwh) div 3")))
    size = F.size(third)
    median = (F.get(third, F.expr("(size(kwh) div 3 - 1) div 2")) + F.get(third, F.expr("(size(kwh) div 3) div 2"))) / 2
    score = F.when(
        (n >= 4) & (size > 0) & (F.col("base") > 0),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("base") - F.array_min("kwh")) / F.col("base"))),
    ).otherwise(F.lit(0.0))
    return series.withColumn("base", median).withColumn("score", score).select(
        "feeder_id",
        "customer_unit_id",
        rnd("score", 4).alias("risk_score"),
        (F.col("score") >= drop).alias("flagged_drop"),
    )
