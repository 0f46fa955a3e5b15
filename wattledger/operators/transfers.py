"""Switching history and load transfers between feeders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import rnd
from wattledger.operators import series as S
from wattledger.scale import running
from wattledger.session import materialize

# feeders of one block of the pairing
BLOCK_FEEDERS = 500


def topology_versions(events: DataFrame, period_start: str, period_end: str) -> DataFrame:
    """Intervals between consecutive switching events of each feeder.

    Positions come from one range-partitioned sort, the next event from an equi-join
    on position + 1, so a feeder with most of the log is no single task.
    """
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    order = [F.col("timestamp").asc(), F.col("event_id").asc()]
    placed = running(events.select("feeder_id", "timestamp", "event_id"), ["feeder_id"], order).select(
        "feeder_id", "pos", stamp.alias("at")
    )
    start = events.select("feeder_id").distinct().select(
        "feeder_id", F.lit(0).cast("long").alias("pos"), F.lit(period_start).alias("at")
    )
    points = placed.unionByName(start)
    following = placed.select("feeder_id", (F.col("pos") - 1).alias("pos"), F.col("at").alias("next"))
    return points.join(following, ["feeder_id", "pos"], "left").select(
        "feeder_id",
        F.format_string("TV%03d", F.col("pos")).alias("topology_version_id"),
        F.col("at").alias("valid_from"),
        F.coalesce("next", F.lit(period_end)).alias("valid_to"),
        F.when(F.col("pos") > 0, 1).otherwise(0).alias("n_events"),
    )


def head_profiles(header: DataFrame) -> DataFrame:
    """One row per feeder: months, kWh, first differences and relative level shift (bounded arrays)."""
    calendar = header.agg(F.array_sort(F.collect_set("year_month")).alias("m")).scalar()
    monthly = header.groupBy("feeder_id", "year_month").agg(F.sum("kwh").alias("kwh"))
    packed = monthly.groupBy("feeder_id").agg(
        F.map_from_entries(F.collect_list(F.struct("year_month", "kwh"))).alias("v")
    )
    kwh = F.transform(F.col("months"), lambda m: F.coalesce(F.try_element_at(F.col("v"), m), F.lit(0.0)))
    diff = F.transform(F.slice("kwh", F.lit(2), F.size("kwh") - 1), lambda x, i: x - F.get("kwh", i))
    h = S.half(F.col("kwh"))
    first, second = S.mean(S.head(F.col("kwh"), h)), S.mean(S.tail(F.col("kwh"), h))
    rows = packed.withColumn("months", calendar).withColumn("kwh", kwh).withColumn("diff", diff)
    rows = rows.withColumn("shift", (second - first) / (F.abs(first) + 1e-9))
    centred = S.bind(S.mean(F.col("diff")), lambda mu: F.transform("diff", lambda d: d - mu))
    return rows.withColumn("c", centred).select(
        "feeder_id",
        "months",
        "diff",
        "shift",
        S.mean(F.col("kwh")).alias("mean_month"),
        F.size("kwh").alias("n_months"),
        "c",
        F.sqrt(S.total(F.transform("c", lambda d: d * d))).alias("norm"),
    )


def infer_transfers(header: DataFrame, cfg: dict) -> DataFrame:
    """Feeder pairs whose head energy shifted in opposite directions and moves inversely.

    One bounded row per feeder enters the pairing.  Only a riser can pair with a faller,
    and one of the two must have shifted strongly; the pairs are dealt over a grid of
    blocks that grows with the number of feeders, so no task holds them all.
    """
    th = cfg["thresholds"]
    rows = materialize(head_profiles(header).where(F.col("n_months") >= 6), "head-profiles")
    blocks = -(-max(rows.count(), 1) // BLOCK_FEEDERS)
    block = F.pmod(F.xxhash64("feeder_id"), F.lit(blocks))
    grid = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    # weak risers meet strong fallers alone: the kind is part of the join key
    strong = F.abs("shift") >= th["transfer_min_shift"]
    kinds = F.explode(F.when(strong, F.array(F.lit("any"), F.lit("weak"))).otherwise(F.array(F.lit("any"))))
    up, down = rows.where("shift > 0"), rows.where("shift < 0")
    rising = up.withColumn("kind", F.when(strong, F.lit("any")).otherwise(F.lit("weak"))).withColumn("bu", block).withColumn("bd", grid)
    falling = down.withColumn("kind", kinds).withColumn("bd", block).withColumn("bu", grid)
    pairs = rising.alias("u").join(falling.alias("d"), ["kind", "bu", "bd"])
    dot = S.total(F.zip_with("u.c", "d.c", lambda a, b: a * b))
    pairs = pairs.withColumn("corr", dot / (F.col("u.norm") * F.col("d.norm"))).where(
        F.col("corr") <= th["transfer_corr"]
    )
    gap = F.zip_with("u.diff", "d.diff", lambda a, b: F.abs(b - a))
    month = F.get(F.col("u.months"), F.array_position(gap, F.array_max(gap)).cast("int"))
    up_first = F.col("u.feeder_id") < F.col("d.feeder_id")

    def either(name: str, flipped: bool = False):
        u, d = F.col(f"u.{name}"), F.col(f"d.{name}")
        return F.when(up_first, d if flipped else u).otherwise(u if flipped else d)

    conf = F.least(F.lit(1.0), F.abs("corr") * (F.abs("u.shift") + F.abs("d.shift")))
    return pairs.select(
        either("feeder_id").alias("feeder_a"),
        either("feeder_id", True).alias("feeder_b"),
        rnd(conf, 3).alias("confidence"),
        month.alias("month"),
        rnd(either("shift") * 100.0, 2).alias("shift_a_pct"),
        rnd(either("shift", True) * 100.0, 2).alias("shift_b_pct"),
    )


def quantify(header: DataFrame, transfers: DataFrame) -> DataFrame:
    """Transferred energy credited per feeder: whoever gained load is debited."""
    profile = materialize(head_profiles(header).select("feeder_id", "mean_month", "n_months"), "head-means")
    a = profile.select(F.col("feeder_id").alias("feeder_a"), F.col("mean_month").alias("ma"), "n_months")
    b = profile.select(F.col("feeder_id").alias("feeder_b"), F.col("mean_month").alias("mb"))
    half = F.greatest(F.floor(F.col("n_months") / 2), F.lit(1))
    frac = F.least(F.abs("shift_a_pct"), F.abs("shift_b_pct")) / 100.0
    energy = frac * (F.col("ma") + F.col("mb")) * 0.5 * half

    def side(name: str):
        sign = F.when(F.col(f"shift_{name}_pct") > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.struct(F.col(f"feeder_{name}").alias("feeder_id"), (sign * F.col("energy")).alias("kwh"))

    both = transfers.join(a, "feeder_a").join(b, "feeder_b").withColumn("energy", energy)
    return (
        both.select(F.explode(F.array(side("a"), side("b"))).alias("s"))
        .groupBy("s.feeder_id")
        .agg(rnd(F.sum("s.kwh"), 1).alias("transferred_kwh"))
    )
