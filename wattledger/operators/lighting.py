"""Street lighting: unmetered energy and anomalies."""

# The Spanish finding and evidence texts are output values that readers of the reports expect.
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions import electrical as E
from wattledger.functions.numeric import lookup, rnd


def annual_hours_on(latitudes: DataFrame, year: int = 2024) -> DataFrame:
    """Mean dark hours per latitude and month (days of the month averaged)."""
    first = F.make_date(F.lit(year), F.col("month"), F.lit(1))
    days = latitudes.select("latitude", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumn(
        "day", F.explode(F.sequence(first, F.last_day(first)))
    )
    return days.groupBy("latitude", "month").agg(
        rnd(F.avg(E.night_hours("latitude", F.dayofyear("day"))), 3).alias("hours_on")
    )


def lamp_kw(cfg: dict):
    ballast = cfg["streetlight"]["ballast_loss_frac"]
    return F.col("lamp_w") / 1000.0 * (F.lit(1.0) + lookup(ballast, F.col("technology"), ballast["led"]))


def hours_lit(cfg: dict, n_periods):
    s = cfg["streetlight"]
    return n_periods * (s["hours_on_default"] * s["days_per_month"] * cfg["months_per_period"])


def lighting_energy(streetlights: DataFrame, header_periods: DataFrame, cfg: dict) -> DataFrame:
    """Energy per feeder and transformer site (site NULL = no traced site).

    Lamps are summed per (feeder, site) first; one row per site meets the periods.
    """
    per_site = streetlights.groupBy("feeder_id", "transformer_site_id").agg(
        F.count(F.lit(1)).alias("n_lights"), F.sum(lamp_kw(cfg)).alias("kw")
    )
    return per_site.join(header_periods, "feeder_id").select(
        "feeder_id",
        F.col("transformer_site_id").alias("site_id"),
        "n_lights",
        (F.col("kw") * hours_lit(cfg, F.col("n_periods"))).alias("ap_kwh"),
    )


def lighting_anomalies(streetlights: DataFrame) -> DataFrame:
    def anomaly(name, severity, evidence):
        return F.struct(F.lit(name).alias("anomaly"), F.lit(severity).alias("severity"), evidence.alias("evidence"))

    site = F.col("transformer_site_id")
    checks = F.array(
        F.when(
            F.col("installed_technology") != F.col("technology"),
            anomaly(
                "tech_mismatch",
                "alta",
                F.concat(F.lit("declarada "), "technology", F.lit(" != instalada "), "installed_technology"),
            ),
        ),
        F.when(
            F.col("photocell_fault"),
            anomaly("day_burning", "media", F.lit("fotocelda averiada: consumo 24 h")),
        ),
        F.when(
            site.isNull() | (site == ""),
            anomaly(
                "no_transformer_site", "media", F.lit("sin puesto de transformación por traza (R25)")
            ),
        ),
    )
    return streetlights.select(
        "feeder_id", "streetlight_id", F.explode(F.array_compact(checks)).alias("a")
    ).select("feeder_id", "streetlight_id", "a.anomaly", "a.severity", "a.evidence")
