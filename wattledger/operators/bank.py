"""Transformer banks: unit plates aggregated to their site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions.numeric import listed, lookup, rnd


UNIT_FIELDS = ("sn_kva", "p0_kw", "pk_kw", "voltage_ln")


def unit_aggregates() -> list[Column]:
    return [
        F.count("sn_kva").alias("n_units"),
        F.min("sn_kva").alias("sn_min"),
        F.sum("sn_kva").alias("sn_sum"),
        F.sum("p0_kw").alias("p0_sum"),
        F.sum("pk_kw").alias("pk_sum"),
        F.count("voltage_ln").alias("v_known"),
        F.max("voltage_ln").alias("v_max"),
        F.min("voltage_ln").alias("v_min"),
    ]


def unit_totals(units: DataFrame) -> DataFrame:
    """One row per site; the only shuffle of the unit table."""
    return units.groupBy("site_id").agg(*unit_aggregates())


def _expected(config: Column) -> Column:
    return lookup(P.BANK_UNITS, config)


def capacity(config: Column, open_delta_factor: float) -> Column:
    """Three-phase capacity; NULL when the unit count does not fit the configuration."""
    three = config.isin("wye_closed", "delta_closed", "delta_4wire")
    two = config.isin("open_delta", "open_wye_open_delta")
    value = (
        F.when(config.isin("single", "independent"), F.col("sn_sum"))
        .when(three, F.col("sn_min") * 3.0)
        .when(two, F.col("sn_min") * open_delta_factor)
    )
    fits = _expected(config).isNull() | (_expected(config) == F.col("n_units"))
    return F.when(fits, value)


def headroom(config: Column) -> Column:
    """Surplus that can serve single-phase load."""
    banked = _expected(config)
    value = F.when(banked > 1, F.col("sn_sum") - F.col("sn_min") * banked).otherwise(F.lit(0.0))
    return F.when(banked.isNull() | (banked == F.col("n_units")), value)


def quality_flags(config: Column) -> Column:
    spread = (F.col("v_max") - F.col("v_min")) / F.col("v_max")
    return listed(
        ("P03", _expected(config) != F.col("n_units")),
        ("P04", (F.col("v_known") >= 2) & (spread > 0.01)),
    )


def banks(sites: DataFrame, units: DataFrame, cfg: dict) -> DataFrame:
    """Sites that have units, with unit totals, capacity, headroom and flags."""
    config = F.col("bank_config")
    return sites.join(unit_totals(units), "site_id").select(
        "*",
        capacity(config, cfg["thresholds"]["open_delta_factor"]).alias("capacity_kva"),
        headroom(config).alias("headroom_kva"),
        quality_flags(config).alias("bank_quality_flags"),
    )


def evaluate(sites: DataFrame, units: DataFrame, cfg: dict) -> DataFrame:
    return banks(sites, units, cfg).select(
        "feeder_id",
        "site_id",
        "bank_config",
        rnd("capacity_kva", 4).alias("capacity_kva"),
        rnd("headroom_kva", 4).alias("single_phase_headroom_kva"),
        rnd("p0_sum", 4).alias("p0_total_kw"),
        "n_units",
    )


def load_losses(units: DataFrame, unit_loads: DataFrame) -> DataFrame:
    """Sum of Pk*(S/Sn)^2 over a site's units; ``unit_loads`` is (unit_id, load_kva)."""
    share = F.pow(F.col("load_kva") / F.col("sn_kva"), 2)
    return (
        units.where(F.col("sn_kva") > 0)
        .join(unit_loads, "unit_id")
        .groupBy("site_id")
        .agg(F.sum(F.col("pk_kw") * share).alias("load_loss_kw"))
    )


def site_energy_loss(s_max: Column, fp: float, hours: Column) -> Column:
    """Site loss over the period from unit totals.

    Load is split by rating, so (Smax*Sn/sumSn/Sn)^2 is the same for every unit and
    the unit sum reduces to sumPk.
    """
    load = F.col("pk_sum") * F.pow(s_max / F.col("sn_sum"), 2) * fp * hours
    return F.col("p0_sum") * hours + F.when(F.col("sn_sum") > 0, load).otherwise(F.lit(0.0))
