"""Risk features per meter, all derived from the bounded series array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import ratio
from wattledger.operators import series as S
from wattledger.operators.labels import power_ratio

WINDOWS = (3, 6, 12, 24)
FEATURES = (
    *[f"{stat}_{w}" for w in WINDOWS for stat in ("mean", "std", "cv")],
    "trend",
    "zeros_frac",
    "max_zero_run",
    "yoy_ratio",
    "entropy",
    "estimated_frac",
    "kvarh_ratio_mean",
    "kvarh_ratio_std",
    "z_peer",
    "consumo_vs_instalada",
)


def cutoff(consumption: DataFrame, year_month: str) -> DataFrame:
    """Only readings up to the cut-off: no feature may look past it."""
    return consumption.where(F.col("year_month") <= year_month)


def window_stats(series: DataFrame) -> DataFrame:
    out = series
    for w in WINDOWS:
        recent = S.last(F.col("kwh"), w)
        out = out.withColumn(f"mean_{w}", S.mean(recent))
        out = out.withColumn(f"std_{w}", S.std_pop(recent))
        out = out.withColumn(f"cv_{w}", ratio(f"std_{w}", f"mean_{w}"))
    return out


def theil_sen(y: Column) -> Column:
    """Median of all pairwise slopes of one bounded series."""
    n = F.size(y)
    slopes = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.transform(
                F.slice(y, i + 2, n - i - 1), lambda v, j: (v - F.get(y, i)) / (j + 1)
            ),
        )
    )
    return F.when(n >= 2, S.median(slopes)).otherwise(F.lit(0.0))


def entropy(y: Column) -> Column:
    def shares(sum_: Column) -> Column:
        return -F.aggregate(
            y, F.lit(0.0), lambda acc, v: acc + F.when(v > 0, v / sum_ * F.ln(v / sum_)).otherwise(F.lit(0.0))
        )

    return S.bind(S.total(y) + 1e-9, shares)


def year_over_year(y: Column) -> Column:
    recent = S.mean(S.last(y, 12))
    previous = S.mean(F.slice(S.last(y, 24), 1, 12))
    return F.when((F.size(y) >= 24) & (previous > 0), recent / previous).otherwise(F.lit(1.0))


def zero_stats(series: DataFrame) -> DataFrame:
    zeros = F.size(F.filter("kwh", lambda v: v <= S.ZERO_KWH)) / F.size("kwh")
    return series.withColumn("zeros_frac", zeros).withColumn(
        "max_zero_run", S.longest_zero_run(F.col("kwh")).cast("double")
    )


def reactive_stats(series: DataFrame) -> DataFrame:
    r = F.array_compact(power_ratio(F.col("kwh"), F.col("kvarh")))
    return series.withColumn("kvarh_ratio_mean", S.mean(r)).withColumn(
        "kvarh_ratio_std", S.std_pop(r)
    )


def own_features(series: DataFrame) -> DataFrame:
    """Everything that needs only the meter's own series: one projection, no shuffle."""
    rows = reactive_stats(zero_stats(window_stats(series)))
    kwh = F.col("kwh")
    return (
        rows.withColumn("trend", theil_sen(kwh))
        .withColumn("yoy_ratio", year_over_year(kwh))
        .withColumn("entropy", entropy(kwh))
        .withColumn("estimated_frac", S.mean(F.col("est")))
        .drop("months", "kwh", "kvarh", "est")
    )


def peer_z(rows: DataFrame) -> DataFrame:
    """z-score of mean_6 among meters of the same site and tariff class.

    Group statistics are partial aggregates joined back, never a window over the group.
    """
    keys = ["transformer_site_id", "tariff_class"]
    stats = rows.groupBy(*keys).agg(
        F.avg("mean_6").alias("peer_mean"), F.stddev_samp("mean_6").alias("peer_std")
    )
    z = (F.col("mean_6") - F.col("peer_mean")) / (F.col("peer_std") + 1e-9)
    return rows.join(stats, keys, "left").withColumn("z_peer", z).drop("peer_mean", "peer_std")


def load_ratio(rows: DataFrame) -> DataFrame:
    installed = F.coalesce("installed_load_kw", F.lit(0.0)) * 720.0 + 1e-9
    return rows.withColumn("consumo_vs_instalada", F.col("mean_6") / installed)


def build_features(series: DataFrame, customers: DataFrame) -> DataFrame:
    meta = customers.select("customer_unit_id", "transformer_site_id", "tariff_class", "installed_load_kw")
    rows = own_features(series).join(meta, "customer_unit_id", "left")
    full = load_ratio(peer_z(rows)).na.fill(0.0)
    return full.select("customer_unit_id", "feeder_id", *FEATURES)
