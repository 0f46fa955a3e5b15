"""Load points (one service entrance, many meters) and site demand."""

# The Spanish finding and evidence texts are output values that readers of the reports expect.
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions import electrical as E
from wattledger.functions.numeric import ratio, rnd
from wattledger.scale import quantiles


def meter_energy(consumption: DataFrame) -> DataFrame:
    """Energy per meter in one pass; the period set is bounded by the calendar."""
    return consumption.groupBy("customer_unit_id", "feeder_id").agg(
        F.sum("kwh").alias("kwh_total"),
        F.count("kwh").alias("n_readings"),
        F.collect_set("year_month").alias("months"),
    )


def feeder_periods(energy: DataFrame) -> DataFrame:
    months = energy.select("feeder_id", F.explode("months").alias("year_month")).distinct()
    return months.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n_periods"))


def meter_demand(energy: DataFrame, customers: DataFrame, cfg: dict) -> DataFrame:
    """Every meter with its monthly energy, Velander peak and class power factor."""
    months = F.col("n_periods") * cfg["months_per_period"]
    joined = (
        customers.join(energy.select("customer_unit_id", "kwh_total"), "customer_unit_id", "left")
        .join(feeder_periods(energy), "feeder_id", "left")
        .withColumn("kwh_total", F.coalesce("kwh_total", F.lit(0.0)))
        .withColumn("e_month", F.coalesce(F.col("kwh_total") / months, F.lit(0.0)))
    )
    e = F.greatest(F.col("e_month"), F.lit(0.0))
    return joined.withColumn("dmax_kw", E.velander_kw(e, "tariff_class")).withColumn(
        "pf", E.class_pf("tariff_class")
    )


def _points(demand: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(meters of load points, their sums per point)."""
    meters = demand.where(F.col("site_id").isNotNull())
    weight = F.greatest(F.col("e_month"), F.lit(0.0)) + 1e-9
    totals = meters.groupBy("site_id").agg(
        F.min("feeder_id").alias("feeder_id"),
        F.min("transformer_site_id").alias("transformer_site_id"),
        F.count(F.lit(1)).alias("n"),
        F.sum("kwh_total").alias("energy"),
        E.diversified_kw("dmax_kw", cfg["electrical"]["coincidence"]).alias("p_max"),
        (F.sum(F.col("pf") * weight) / F.sum(weight)).alias("pf"),
        F.max("service_drop_kva").alias("drop_kva"),
        F.stddev_pop("e_month").alias("std"),
        F.min("e_month").alias("low"),
        F.sum("dmax_kw").alias("peaks"),
    )
    s_max = F.when(F.col("p_max") > 0, F.col("p_max") / F.col("pf")).otherwise(F.lit(0.0))
    return meters, totals.withColumn("s_max", s_max)


def point_kva(demand: DataFrame, cfg: dict) -> DataFrame:
    """Maximum apparent power of every load point: what the balance needs, without any median."""
    return _points(demand, cfg)[1].select("transformer_site_id", rnd("s_max", 3).alias("s_max_kva"))


def load_points(demand: DataFrame, cfg: dict) -> DataFrame:
    """One row per load point, with coincidence applied inside the point."""
    meters, totals = _points(demand, cfg)
    median = quantiles(meters, ["site_id"], "e_month", {"med": 0.5}).select("site_id", "med")
    s_max = F.col("s_max")
    return totals.join(median, "site_id").select(
        "feeder_id",
        F.col("site_id").alias("load_point_id"),
        "transformer_site_id",
        F.col("n").alias("n_connections"),
        rnd("energy", 1).alias("energy_kwh"),
        rnd("p_max", 3).alias("p_max_diversified_kw"),
        rnd(s_max, 3).alias("s_max_kva"),
        rnd("pf", 4).alias("pf"),
        rnd("drop_kva", 2).alias("service_drop_kva"),
        rnd(F.when(F.col("drop_kva") > 0, s_max / F.col("drop_kva")), 3).alias("drop_utilization"),
        rnd(ratio("std", "med"), 4).alias("intra_dispersion"),
        rnd(ratio("low", "med", 1.0), 4).alias("min_to_median_ratio"),
        rnd("peaks", 3).alias("sum_of_peaks_kw"),
    )


def load_point_findings(points: DataFrame, cfg: dict) -> DataFrame:
    th = cfg["thresholds"]
    over, under, floor = th["drop_overload_ratio"], th["drop_underuse_ratio"], th["intra_dispersion_min_ratio"]
    util, low = F.col("drop_utilization"), F.col("min_to_median_ratio")

    def finding(name, severity, evidence):
        return F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), evidence.alias("evidence"))

    checks = F.array(
        F.when(
            util > over,
            finding("acometida_sobrecargada", "alta", F.format_string(f"utilización %.2f > {over}", rnd(util, 2))),
        ),
        F.when(
            util < under,
            finding("acometida_subutilizada", "media", F.format_string(f"utilización %.2f < {under}", rnd(util, 2))),
        ),
        F.when(
            (F.col("n_connections") >= 2) & (low < floor),
            finding(
                "dispersion_intra_punto",
                "alta",
                F.format_string(
                    "una conexión consume %.0f%% de la mediana del punto (%d medidores)",
                    rnd(low * 100, 0),
                    F.col("n_connections"),
                ),
            ),
        ),
    )
    return (
        points.select("feeder_id", "load_point_id", F.explode(F.array_compact(checks)).alias("f"))
        .select("feeder_id", "load_point_id", "f.finding", "f.severity", "f.evidence")
    )


def site_smax(points: DataFrame, cfg: dict) -> DataFrame:
    """Second coincidence level: across the load points of a transformer site."""
    return (
        points.where(F.col("transformer_site_id").isNotNull())
        .groupBy(F.col("transformer_site_id").alias("site_id"))
        .agg(E.diversified_kw("s_max_kva", cfg["electrical"]["coincidence"]).alias("s_max_lp"))
    )
