"""Consumption anomaly labels mined from each meter's own history and its peers."""

# The Spanish finding and evidence texts are output values that readers of the reports expect.
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import rnd
from wattledger.operators import series as S
from wattledger.scale import quantiles

# label source -> weight (fixed values)
WEIGHTS = {
    "M1_drop_recovery": 0.9,
    "M2_jump_after_intervention": 0.85,
    "M4_zero_active": 0.5,
    "M5_level_break": 0.5,
    "M6_pf_collapse": 0.5,
    "M7_peer_divergence": 0.35,
    "M8_intra_site_dispersion": 0.6,
}
HIGH_CONFIDENCE = ("M1_drop_recovery", "M2_jump_after_intervention")
BREAK_GRID = 5
BREAK_MIN_SIZE = 3


def _label(flagged: DataFrame, source: str, evidence: Column) -> DataFrame:
    return flagged.select(
        "customer_unit_id",
        F.lit(source).alias("label_source"),
        F.lit(WEIGHTS[source]).alias("confidence_weight"),
        evidence.alias("evidence"),
    )


def _recovered_run(drop_pct: Column, min_run: int) -> Column:
    """Length of the first low run that ends in a recovery, else 0."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("hit"))

    def scan(base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            low = x < base * (F.lit(1.0) - drop_pct)
            ends = ~low & (acc["hit"] == 0) & (acc["run"] >= min_run) & (x >= base * 0.9)
            return F.struct(
                F.when(low, acc["run"] + 1).otherwise(F.lit(0)).alias("run"),
                F.when(ends, acc["run"]).otherwise(acc["hit"]).alias("hit"),
            )

        return F.aggregate("kwh", start, step, lambda acc: acc["hit"])

    return S.bind(F.col("base"), scan)


def _with_base(series: DataFrame) -> DataFrame:
    quarter = F.greatest(F.floor(F.size("kwh") / 4), F.lit(1)).cast("int")
    return series.withColumn("base", S.median(S.head(F.col("kwh"), quarter))).where(F.col("base") > 0)


def drop_recovery(series: DataFrame, cfg: dict) -> DataFrame:
    th = cfg["thresholds"]
    drop = th["drop_recovery_pct"]
    hit = _with_base(series).withColumn("run", _recovered_run(F.lit(drop), th["drop_recovery_months"]))
    text = f"caída>{int(drop * 100)}%% por %d meses y recuperación"
    return _label(hit.where("run > 0"), "M1_drop_recovery", F.format_string(text, F.col("run")))


def permanent_jump(series: DataFrame, cfg: dict) -> DataFrame:
    jump = cfg["thresholds"]["jump_after_intervention_pct"]
    kwh = F.col("kwh")
    h = S.half(kwh)
    hit = series.select(
        "customer_unit_id", S.median(S.head(kwh, h)).alias("first"), S.median(S.tail(kwh, h)).alias("second")
    ).where((F.col("first") > 0) & (F.col("second") >= F.col("first") * (1.0 + jump)))
    growth = rnd((F.col("second") / F.col("first") - 1.0) * 100.0, 0)
    return _label(hit, "M2_jump_after_intervention", F.format_string("salto permanente +%.0f%%", growth))


def zero_active(series: DataFrame, cfg: dict) -> DataFrame:
    run = S.longest_zero_run(F.col("kwh"))
    hit = series.select("customer_unit_id", run.alias("run"), S.total(F.col("kwh")).alias("sum")).where(
        (F.col("run") >= cfg["thresholds"]["zero_active_months"]) & (F.col("sum") > 0)
    )
    return _label(hit, "M4_zero_active", F.format_string("%d meses en cero con servicio activo", F.col("run")))


def _first_break(kwh: Column, deviation: Column) -> Column:
    """First break of the penalised least-squares segmentation (series length = none).

    Optimal partition over the break grid as one fold: per grid point the state holds
    the cheapest cost up to it and where its first segment ends.
    """
    n = F.size(kwh)
    inner = F.when(n > BREAK_GRID, F.sequence(F.lit(BREAK_GRID), n - 1, F.lit(BREAK_GRID))).otherwise(
        F.array().cast("array<int>")
    )

    def sums(end: Column) -> Column:
        part = F.slice(kwh, F.lit(1), end)
        squares = F.transform(part, lambda v: v * v)
        return F.struct(end.alias("at"), S.total(part).alias("s"), S.total(squares).alias("q"))

    grid = F.transform(F.concat(inner, F.array(n)), sums)
    origin = F.array(
        F.struct(
            F.lit(0).alias("at"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("cost"), F.lit(0).alias("first")
        )
    )

    def solve(known: Column) -> Column:
        penalty = known["sd"] * known["sd"] * 3.0

        def extend(done: Column, g: Column) -> Column:
            def option(p: Column) -> Column:
                d = g["s"] - p["s"]
                sse = (g["q"] - p["q"]) - d * d / (g["at"] - p["at"])
                first = F.when(p["at"] == 0, g["at"]).otherwise(p["first"])
                # added up as in the SQL, so that options of equal cost are told apart alike
                return F.struct((sse + penalty + p["cost"]).alias("cost"), p["at"].alias("start"), first.alias("first"))

            usable = F.filter(done, lambda p: p["at"] <= g["at"] - BREAK_MIN_SIZE)
            return S.bind(
                F.array_min(F.transform(usable, option)),
                lambda best: F.concat(
                    done,
                    F.array(
                        F.struct(
                            g["at"].alias("at"), g["s"].alias("s"), g["q"].alias("q"),
                            best["cost"].alias("cost"), best["first"].alias("first"),
                        )
                    ),
                ),
            )

        return F.element_at(F.aggregate(known["grid"], origin, extend), -1)["first"]

    return S.bind(F.struct(grid.alias("grid"), deviation.alias("sd")), solve)


def level_break(series: DataFrame) -> DataFrame:
    kwh = F.col("kwh")
    rows = series.where(F.size("kwh") > BREAK_GRID).select(
        "customer_unit_id", "kwh", S.mean(kwh).alias("mu"), S.std_running(kwh).alias("sd")
    )
    # the one-element explode keeps the segmentation from being evaluated once per use
    rows = rows.where(F.col("sd") >= 1e-6).select(
        "customer_unit_id", "kwh", "mu", F.explode(F.array(_first_break(kwh, F.col("sd")))).alias("b")
    )
    shift = F.abs(S.mean(S.head(kwh, F.col("b"))) - S.mean(S.tail(kwh, F.col("b"))))
    hit = rows.where((F.col("b") < F.size("kwh")) & (shift > (F.col("mu") + 1e-9) * 0.3))
    return _label(hit, "M5_level_break", F.format_string("ruptura de nivel en el mes %d", F.col("b")))


def power_ratio(kwh: Column, kvarh: Column) -> Column:
    """kvarh/kwh per period, NULL where nothing was consumed."""
    return F.zip_with(kwh, kvarh, lambda p, q: F.when(p > 0, q / p))


def pf_collapse(series: DataFrame) -> DataFrame:
    ratio = power_ratio(F.col("kwh"), F.col("kvarh"))
    h = S.half(F.col("r"))
    hit = (
        series.withColumn("r", ratio)
        .select(
            "customer_unit_id",
            rnd(S.median(S.head(F.col("r"), h)), 9).alias("a"),
            rnd(S.median(S.tail(F.col("r"), h)), 9).alias("b"),
        )
        .where((F.col("a") > 0) & (F.abs(F.col("b") - F.col("a")) / F.col("a") > 0.5))
    )
    text = F.format_string("cambio de kVArh/kWh %.2f->%.2f", rnd("a", 2), rnd("b", 2))
    return _label(hit, "M6_pf_collapse", text)


def meter_means(series: DataFrame, customers: DataFrame) -> DataFrame:
    means = series.select("customer_unit_id", S.mean(F.col("kwh")).alias("mean_kwh"))
    return means.join(
        customers.select("customer_unit_id", "transformer_site_id", "tariff_class", "site_id"), "customer_unit_id"
    )


def peer_quantile(means: DataFrame, keys: list[str], p: float, name: str) -> DataFrame:
    """Exact grouped quantile with linear interpolation; safe for hot groups."""
    return quantiles(means, keys, "mean_kwh", {name: p})


def peer_divergence(means: DataFrame) -> DataFrame:
    keys = ["transformer_site_id", "tariff_class"]
    joined = means.join(peer_quantile(means, keys, 0.05, "p05"), keys)
    hit = joined.where((F.col("mean_kwh") < F.col("p05")) & (F.col("mean_kwh") > 0))
    return _label(hit, "M7_peer_divergence", F.lit("bajo el percentil 5 del grupo par"))


def intra_site_dispersion(means: DataFrame, cfg: dict) -> DataFrame:
    floor = cfg["thresholds"]["intra_dispersion_min_ratio"]
    joined = means.join(peer_quantile(means, ["site_id"], 0.5, "med"), "site_id")
    hit = joined.where(
        (F.col("n") >= 2) & (F.col("mean_kwh") < F.col("med") * floor) & (F.col("mean_kwh") > 0)
    )
    text = F.format_string(
        "%.0f%% de la mediana de su punto de carga (%d conexiones)",
        rnd(F.col("mean_kwh") / F.col("med") * 100.0, 0),
        F.col("n"),
    )
    return _label(hit, "M8_intra_site_dispersion", text)


def mine_labels(series: DataFrame, customers: DataFrame, cfg: dict) -> DataFrame:
    """All mechanisms in one table; ``series`` should be a written table."""
    means = meter_means(series, customers)
    parts = [
        drop_recovery(series, cfg),
        permanent_jump(series, cfg),
        zero_active(series, cfg),
        level_break(series),
        pf_collapse(series),
        peer_divergence(means),
        intra_site_dispersion(means, cfg),
    ]
    return reduce(DataFrame.unionByName, parts)


def _share(num: Column, den: Column) -> Column:
    return F.when(den > 0, rnd(num / den, 4))


def validate(mined: DataFrame, theft_labels: DataFrame) -> DataFrame:
    """Recall of the mined labels on confirmed thefts, and their precision.

    One row per meter on each side, so the comparison is a single full join.
    """
    confirmed = theft_labels.where("is_theft").select("customer_unit_id", F.lit(1).alias("c")).distinct()
    flags = mined.groupBy("customer_unit_id").agg(
        F.max(F.col("label_source").isin(*HIGH_CONFIDENCE).cast("int")).alias("high"), F.lit(1).alias("m")
    )
    sums = confirmed.join(flags, "customer_unit_id", "full").agg(
        F.count("c").alias("confirmed"),
        F.count("m").alias("mined_total"),
        F.count(F.when(F.col("c").isNotNull() & (F.col("high") == 1), 1)).alias("hit_high"),
        F.count(F.when(F.col("c").isNotNull() & F.col("m").isNotNull(), 1)).alias("hit_all"),
    )
    return sums.select(
        "confirmed",
        _share(F.col("hit_high"), F.col("confirmed")).alias("recall_high_conf"),
        _share(F.col("hit_all"), F.col("confirmed")).alias("recall_all"),
        "mined_total",
        _share(F.col("hit_all"), F.greatest(F.col("mined_total"), F.lit(1))).alias("precision_all_vs_confirmed"),
    )


def threshold_sweep(
    series: DataFrame, customers: DataFrame, theft_labels: DataFrame, cfg: dict, grid=(0.25, 0.35, 0.45, 0.55)
) -> DataFrame:
    """Recall and precision over drop thresholds.

    Only the drop mechanism depends on the threshold: its array of thresholds is
    evaluated per meter in one pass, the other mechanisms run once.
    """
    means = meter_means(series, customers)
    fixed = reduce(
        DataFrame.unionByName,
        [
            permanent_jump(series, cfg),
            zero_active(series, cfg),
            level_break(series),
            pf_collapse(series),
            peer_divergence(means),
            intra_site_dispersion(means, cfg),
        ],
    ).select("customer_unit_id")
    min_run = cfg["thresholds"]["drop_recovery_months"]
    based = _with_base(series)
    tried = F.array_compact(
        F.array(*[F.when(_recovered_run(F.lit(t), min_run) > 0, F.lit(t)) for t in grid])
    )
    swept = based.select("customer_unit_id", F.explode(tried).alias("drop_recovery_pct"))
    always = fixed.select("customer_unit_id", F.explode(F.array(*[F.lit(t) for t in grid])).alias("drop_recovery_pct"))
    mined = swept.unionByName(always).distinct()
    truth = theft_labels.where("is_theft").select("customer_unit_id", F.lit(1).alias("c"))
    confirmed = truth.agg(F.count("c")).scalar()
    return (
        mined.join(truth, "customer_unit_id", "left")
        .groupBy("drop_recovery_pct")
        .agg(F.count(F.lit(1)).alias("mined_total"), F.count("c").alias("hits"))
        .select(
            "drop_recovery_pct",
            "mined_total",
            _share(F.col("hits"), confirmed).alias("recall_all"),
            _share(F.col("hits"), F.col("mined_total")).alias("precision_vs_conf"),
        )
    )
