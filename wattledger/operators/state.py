"""State estimation per feeder: site loads reconciled with the feeder head.

The least-squares system is diagonal plus one rank-one anchor, so its solution is
closed form: each site's correction is proportional to its variance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions.numeric import rnd

ANCHOR_FRACTION = 0.005
SIGMA_FLOOR = 1e-3
SIGMA_RELATIVE = 0.05


def site_stats(consumption: DataFrame, customers: DataFrame, hours: float) -> DataFrame:
    """Mean and sample deviation of each site's periodic energy, in kW.

    Readings are summed per meter and period before they meet the site.
    """
    monthly = (
        consumption.groupBy("customer_unit_id", "year_month").agg(F.sum("kwh").alias("kwh"))
        .join(customers.select("customer_unit_id", "feeder_id", "transformer_site_id"), "customer_unit_id")
        .where(F.col("transformer_site_id").isNotNull())
        .groupBy("feeder_id", F.col("transformer_site_id").alias("site_id"), "year_month")
        .agg(F.sum("kwh").alias("kwh"))
    )
    return monthly.groupBy("feeder_id", "site_id").agg(
        (F.avg("kwh") / hours).alias("mean_kw"),
        (F.coalesce(F.stddev_samp("kwh"), F.lit(0.0)) / hours).alias("std_kw"),
    )


def pseudo_measurements(stats: DataFrame) -> DataFrame:
    floor = F.greatest(F.col("mean_kw"), F.lit(1e-6)) * SIGMA_RELATIVE + SIGMA_FLOOR
    return stats.select(
        "feeder_id", "site_id", F.col("mean_kw").alias("z"), F.greatest(F.col("std_kw"), floor).alias("sigma")
    )


def measured_total(balance: DataFrame, cfg: dict) -> DataFrame:
    """Head power net of technical losses, from the published balance."""
    hours = F.col("n_months") * P.hours_per_period(cfg)
    net = (F.col("energy_header_kwh") - F.col("energy_technical_kwh")) / hours
    return balance.select("feeder_id", F.greatest(F.lit(0.0), net).alias("total"))


def wls(pseudo: DataFrame, totals: DataFrame) -> DataFrame:
    """Per site: estimate, correction, normalised residual, and the feeder's tests."""
    sums = pseudo.groupBy("feeder_id").agg(
        F.sum("z").alias("sz"), F.sum(F.col("sigma") * F.col("sigma")).alias("ss")
    )
    anchor = F.greatest(F.abs("total") * ANCHOR_FRACTION, F.lit(1e-3))
    w = F.lit(1.0) / (anchor * anchor)
    gain = sums.join(totals, "feeder_id").select(
        "feeder_id", (w * (F.col("total") - F.col("sz")) / (F.lit(1.0) + w * F.col("ss"))).alias("g"), "ss"
    )
    rows = pseudo.join(gain, "feeder_id").withColumn("correction", F.col("g") * F.col("sigma") * F.col("sigma"))
    # sum(c^2/sigma^2) = g^2 * sum(sigma^2)
    chi2 = F.col("g") * F.col("g") * F.col("ss")
    return rows.select(
        "feeder_id",
        "site_id",
        "z",
        "sigma",
        (F.col("z") + F.col("correction")).alias("estimate"),
        "correction",
        (-F.col("correction") / F.col("sigma")).alias("norm_residual"),
        chi2.alias("chi2"),
        (chi2 > 1.0 + 3.0 * 2.0**0.5).alias("gross_error"),
    )


def largest_residual(estimate: DataFrame) -> DataFrame:
    """Site with the largest normalised residual per feeder."""
    return estimate.groupBy("feeder_id").agg(
        F.max_by("site_id", F.struct(F.round(F.abs("norm_residual"), 9), "site_id")).alias("lnr_site_id")
    )


def zone_reconcile(estimate: DataFrame, sites: DataFrame, node_zone: DataFrame) -> DataFrame:
    """Unaccounted load per protection zone and its share of the feeder."""
    where = sites.select("feeder_id", "site_id", F.col("node_id").alias("node")).join(
        node_zone, ["feeder_id", "node"], "left"
    )
    rows = estimate.join(where.select("feeder_id", "site_id", "zone_id"), ["feeder_id", "site_id"], "left")
    rows = rows.withColumn("zone_id", F.coalesce("zone_id", F.lit("HEAD")))
    up = F.greatest(F.col("correction"), F.lit(0.0))
    zone = rows.groupBy("feeder_id", "zone_id").agg(
        F.sum(up).alias("unaccounted"),
        F.max(F.abs("norm_residual")).alias("residual"),
        F.count(F.lit(1)).alias("n_sites"),
        F.max("gross_error").alias("gross_error"),
        F.max("chi2").alias("chi2"),
    )
    total = zone.groupBy("feeder_id").agg(F.sum("unaccounted").alias("total"))
    share = F.when(F.col("total") > 0, F.col("unaccounted") / F.col("total")).otherwise(F.lit(0.0))
    return zone.join(total, "feeder_id").select(
        "feeder_id",
        "zone_id",
        rnd("unaccounted", 4).alias("unaccounted_load_kw"),
        rnd("residual", 4).alias("max_norm_residual"),
        "n_sites",
        rnd(share, 4).alias("share_of_unaccounted"),
        "gross_error",
        rnd("chi2", 2).alias("chi2"),
    )


def independent_pnt(estimate: DataFrame, balance: DataFrame, cfg: dict) -> DataFrame:
    """Non-technical loss from the estimate, against the accounting one."""
    up = estimate.groupBy("feeder_id").agg(
        F.sum(F.greatest(F.col("correction"), F.lit(0.0))).alias("unaccounted")
    )
    hours = F.col("n_months") * P.hours_per_period(cfg)
    pnt = F.col("unaccounted") * hours - F.col("energy_streetlight_kwh") - F.col("energy_ens_kwh")
    gap = F.when(
        F.col("energy_header_kwh") != 0, F.abs(pnt - F.col("pnt_kwh")) / F.col("energy_header_kwh") * 100.0
    )
    return balance.join(up, "feeder_id").select(
        "feeder_id", "pnt_kwh", rnd(pnt, 1).alias("pnt_independent_kwh"), rnd(gap, 4).alias("unexplained_pct")
    )
