"""Field campaign: candidates, budget allocation, work orders, rankings, summary.

With one cost for all sites, "take in value order until the budget is used" is the
exact 0/1 knapsack.  With different costs a multiplier prices the budget; it is found by
mergeable aggregates, and comes with a bound.  Running sums are range-partitioned scans.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattledger.functions.numeric import rnd
from wattledger.params import BUDGET
from wattledger.scale import running, top_rows
from wattledger.session import materialize, materialize_with


def candidates(
    risk: DataFrame, customers: DataFrame, poles: DataFrame, cfg: dict, reliability: DataFrame | None = None
) -> DataFrame:
    """Meter risk summed to transformer sites (one visit covers all meters of a site).

    ``risk``: customer_unit_id, risk_score, recoverable_kwh_month.
    """
    b = cfg["budget"]
    meters = risk.select("customer_unit_id", "risk_score", "recoverable_kwh_month").join(
        customers.select("customer_unit_id", "transformer_site_id", "feeder_id", "pole_id"), "customer_unit_id"
    )
    kwh = F.coalesce("recoverable_kwh_month", F.lit(0.0))
    worth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk_score"))) * kwh * (
        b["recovery_months"] * b["tariff_usd_per_kwh"]
    )
    site = (
        meters.where(F.col("transformer_site_id").isNotNull())
        .groupBy(F.col("transformer_site_id").alias("site_id"))
        .agg(
            F.min("feeder_id").alias("feeder_id"),
            F.count(F.lit(1)).alias("n_units"),
            F.sum(worth).alias("benefit_usd"),
            F.avg("risk_score").alias("mean_risk"),
            F.max("risk_score").alias("max_risk"),
            F.sum(kwh).alias("recoverable_kwh_month"),
            F.min("pole_id").alias("pole_id"),
        )
    )
    if reliability is not None:
        rel = reliability.select("feeder_id", "reliability_index")
        factor = F.coalesce("reliability_index", F.lit(100.0)) / 100.0 * 0.5 + 0.5
        site = site.join(rel, "feeder_id", "left").withColumn("benefit_usd", F.col("benefit_usd") * factor)
    else:
        site = site.withColumn("reliability_index", F.lit(100.0))
    place = poles.groupBy("pole_id").agg(F.min(F.struct("x", "y")).alias("xy"))
    cost = b["visit_usd"] + b["normalization_usd"]
    return site.join(place, "pole_id", "left").select(
        "site_id",
        "feeder_id",
        "n_units",
        rnd("benefit_usd", 4).alias("benefit_usd"),
        rnd("mean_risk", 6).alias("mean_risk"),
        "max_risk",
        rnd("recoverable_kwh_month", 4).alias("recoverable_kwh_month"),
        F.coalesce("reliability_index", F.lit(100.0)).alias("reliability_index"),
        F.lit(cost).alias("cost_usd"),
        rnd(F.col("benefit_usd") - cost, 4).alias("ve_neto_usd"),
        rnd(F.col("benefit_usd") / cost, 6).alias("roi"),
        "pole_id",
        F.coalesce("xy.x", F.lit(0.0)).alias("x"),
        F.coalesce("xy.y", F.lit(0.0)).alias("y"),
    )


def _by(value: str) -> list[Column]:
    return [F.col(value).desc(), F.col("site_id").asc()]


def _within(ranked: DataFrame, budget: Column, max_visits: int | None) -> DataFrame:
    fits = F.col("spent") <= budget
    return ranked.where(fits if max_visits is None else fits & (F.col("pos") <= max_visits))


def fill(cand: DataFrame, group: list[str], order: list[Column], room: DataFrame) -> DataFrame:
    """Rows of ``cand`` taken in order while they fit; what does not fit is passed over.

    ``room`` (group, budget, visits) is what each group may spend.  A round takes the longest
    run that fits; then only rows that cost no more than what is left can follow, and
    what is left falls with every round, so rounds are few and get smaller quickly (one, if all costs are equal).
    """
    taken, columns, pairing = [], cand.columns, group or ["_all"]
    left = cand if group else cand.withColumn("_all", F.lit(0))
    room = materialize(room if group else room.withColumn("_all", F.lit(0)), "room")
    while True:
        ranked = running(left.join(room, pairing).where(F.col("cost_usd") <= F.col("budget")).drop("budget", "visits"), pairing, order, {"spent": "cost_usd"})
        ranked = ranked.join(room, pairing)
        ranked = materialize(ranked.withColumn("fits", (F.col("spent") <= F.col("budget")) & (F.col("pos") <= F.col("visits"))), "ranked")
        chosen = ranked.where("fits")
        taken.append(chosen.select(*columns))
        used = chosen.groupBy(*pairing).agg(F.sum("cost_usd").alias("used"), F.count(F.lit(1)).alias("n"))
        room = room.join(used, pairing, "left").select(*pairing, (F.col("budget") - F.coalesce("used", F.lit(0.0))).alias("budget"), (F.col("visits") - F.coalesce("n", F.lit(0))).alias("visits"))
        room = materialize(room.where("visits > 0"), "room")
        rest = ranked.where("NOT fits").select(*columns, *[c for c in pairing if c not in columns])
        left = rest.join(room.select(*pairing, F.col("budget").alias("_left")), pairing).where(F.col("cost_usd") <= F.col("_left")).drop("_left")
        if left.isEmpty():
            break
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


#: stands for no limit on the number of visits
MANY = 1 << 60


def _room(cand: DataFrame, budget: float, max_visits: int | None) -> DataFrame:
    return cand.sparkSession.range(1).select(F.lit(float(budget)).alias("budget"), F.lit(MANY if max_visits is None else max_visits).cast("long").alias("visits"))


def greedy(cand: DataFrame, budget: float, max_visits: int | None = None) -> DataFrame:
    """Sites by return on cost; a site that does not fit what is left is passed over."""
    return fill(cand, [], _by("roi"), _room(cand, budget, max_visits)).withColumn("selected_by", F.lit("greedy_roi"))


#: ratios that one step of the search for the multiplier tells apart
RATIO_STEPS = 256


def multiplier(cand: DataFrame, group: list[str], room: DataFrame) -> DataFrame:
    """(group, ratio, core_cost, core_value): the value per cost at which each group's budget runs out.

    All sites above the ratio fit together.  Each step is one mergeable aggregate over ratio
    bands, and the band in which the budget runs out is split again, until it is a single
    ratio.  Where everything fits, the ratio is 0.
    """
    rows = cand.select(*group, F.col("ratio"), "cost_usd", "ve_neto_usd")
    span = rows.groupBy(*group).agg(F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
    state = span.join(room.select(*group, "budget"), group).withColumn("core_cost", F.lit(0.0)).withColumn("core_value", F.lit(0.0))
    closed: list[DataFrame] = []
    while True:
        state, seen = materialize_with(state, "multiplier", open=F.count(F.when(F.col("lo") < F.col("hi"), 1)))
        band = F.least(F.floor((F.col("ratio") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * RATIO_STEPS), F.lit(RATIO_STEPS - 1))
        met = rows.join(state, group).where(F.col("ratio").between(F.col("lo"), F.col("hi")))
        known = [*group, "budget", "core_cost", "core_value"]
        bands = met.groupBy(*known, band.alias("band")).agg(F.sum("cost_usd").alias("c"), F.sum("ve_neto_usd").alias("v"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
        # RATIO_STEPS rows per group at most
        down = Window.partitionBy(*group).orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = bands.withColumn("cost", F.col("core_cost") + F.sum("c").over(down)).withColumn("value", F.col("core_value") + F.sum("v").over(down))
        over = summed.where(F.col("cost") > F.col("budget"))
        first = over.groupBy(*group).agg(F.max_by(F.struct("lo", "hi", (F.col("cost") - F.col("c")).alias("core_cost"), (F.col("value") - F.col("v")).alias("core_value")), "band").alias("s"))
        nowhere = summed.join(first.select(*group), group, "left_anti")
        closed.append(nowhere.groupBy(*group).agg(F.max("cost").alias("core_cost"), F.max("value").alias("core_value")).select(*group, F.lit(0.0).alias("ratio"), "core_cost", "core_value"))
        nxt = first.join(state.select(*group, "budget"), group).select(*group, "s.lo", "s.hi", "budget", "s.core_cost", "s.core_value")
        if not seen["open"]:
            closed.append(nxt.select(*group, F.col("hi").alias("ratio"), "core_cost", "core_value"))
            break
        state = nxt
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def pack(cand: DataFrame, group: list[str], room: DataFrame) -> DataFrame:
    """A choice of sites within each group's budget, with ``bound_usd``: what no choice in the group can exceed.

    Sites of no value are left out.  With equal costs the most valuable sites are the exact
    answer.  Otherwise all sites above the multiplier are taken and the rest of the budget is
    filled in order of value per cost.  The multiplier prices the budget: its bound is that of the relaxed
    problem, so the choice is worth at least bound minus one site.
    """
    worth = cand.where("ve_neto_usd > 0")
    keyed, columns, by = (worth, cand.columns, group) if group else (worth.withColumn("_all", F.lit(0)), cand.columns, ["_all"])
    limits = room if group else room.withColumn("_all", F.lit(0))
    ratio = F.when(F.col("cost_usd") > 0, F.col("ve_neto_usd") / F.col("cost_usd")).otherwise(F.lit(1e300))
    keyed, seen = materialize_with(keyed.withColumn("ratio", ratio), "packing", low=F.min("cost_usd"), high=F.max("cost_usd"))
    if seen["low"] is None or seen["low"] == seen["high"]:
        chosen = fill(keyed, by, _by("ve_neto_usd"), limits)
        best = chosen.groupBy(*by).agg(F.sum("ve_neto_usd").alias("bound_usd"))
        return chosen.join(best, by).select(*columns, "bound_usd")
    price = materialize(multiplier(keyed, by, limits), "prices")
    core = keyed.join(price.select(*by, F.col("ratio").alias("price")), by).where(F.col("ratio") > F.col("price"))
    left = limits.join(price, by, "left").select(*by, (F.col("budget") - F.coalesce("core_cost", F.lit(0.0))).alias("budget"), "visits")
    beyond = keyed.join(price.select(*by, F.col("ratio").alias("price")), by).where(F.col("ratio") <= F.col("price")).drop("price")
    chosen = core.drop("price").unionByName(fill(beyond, by, [F.col("ratio").desc(), *_by("ve_neto_usd")], left))
    bound = price.join(limits, by).select(*by, (F.col("core_value") + F.col("ratio") * (F.col("budget") - F.col("core_cost"))).alias("bound_usd"))
    return chosen.join(bound, by).select(*columns, "bound_usd")


#: halvings of the multiplier where the number of visits is limited too
VISIT_STEPS = 40


def pack_visits(cand: DataFrame, budget: float, max_visits: int) -> DataFrame:
    """``pack`` for one budget and at most ``max_visits`` sites.

    For a multiplier m the best choice is the ``max_visits`` largest of value - m x cost; m is
    halved towards the smallest one whose choice fits the budget.  Every m gives a bound.
    """
    worth = materialize(cand.where("ve_neto_usd > 0"), "packing")

    def at(m: float) -> tuple[DataFrame, float, float]:
        priced = worth.withColumn("priced", F.col("ve_neto_usd") - F.lit(m) * F.col("cost_usd")).where("priced > 0")
        top = priced.orderBy(F.col("priced").desc(), "site_id").limit(max_visits)
        sums = top.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("c"), F.coalesce(F.sum("priced"), F.lit(0.0)).alias("v")).first()
        return top.drop("priced"), sums.c, m * budget + sums.v

    top, cost, bound = at(0.0)
    if cost > budget:
        low, high = 0.0, worth.agg(F.max(F.col("ve_neto_usd") / F.greatest("cost_usd", F.lit(1e-9)))).first()[0]
        for _ in range(VISIT_STEPS):
            middle = (low + high) / 2
            choice, spent, limit = at(middle)
            bound = min(bound, limit)
            if spent > budget:
                low = middle
            else:
                high, top, cost = middle, choice, spent
        if cost > budget:
            top, cost = worth.limit(0), 0.0
    top = materialize(top, "visits")
    rest = worth.join(top.select("site_id"), "site_id", "left_anti").select(*worth.columns)
    more = fill(rest, [], _by("roi"), _room(cand, budget - cost, max_visits - top.count()))
    return top.unionByName(more).withColumn("bound_usd", F.lit(bound))


def knapsack(cand: DataFrame, budget: float, max_visits: int | None = None) -> DataFrame:
    """Sites that are worth most together within the budget; ``bound_usd`` is what no choice can exceed.

    Exact for equal costs.  Sites that add no value are left out.
    """
    costs = cand.agg(F.min("cost_usd").alias("low"), F.max("cost_usd").alias("high")).first() if max_visits is not None else None
    if costs is not None and costs.low != costs.high:
        chosen = pack_visits(cand, budget, max_visits)
    else:
        chosen = pack(cand, [], _room(cand, budget, max_visits))
    return chosen.withColumn("selected_by", F.lit("knapsack"))


def two_stage(cand: DataFrame, budget: float) -> DataFrame:
    """Budget split over feeders by recoverable value, then the knapsack per feeder, all at once."""
    gain = F.greatest(F.col("ve_neto_usd"), F.lit(0.0))
    potential = cand.groupBy("feeder_id").agg(F.sum(gain).alias("pot"))
    total = potential.agg(F.sum("pot")).scalar()
    room = potential.where("pot > 0").select("feeder_id", (F.col("pot") / total * budget).alias("budget"), F.lit(MANY).alias("visits"))
    return pack(cand, ["feeder_id"], room).select(*cand.columns, F.lit("two_stage").alias("selected_by"))


def exploration(cand: DataFrame, budget: float, reserve_fraction: float, seed: int = 0) -> DataFrame:
    """Random picks up to the reserve, stratified: feeders take turns in hash order."""
    draw = F.md5(F.concat(F.col("site_id"), F.lit(f":{seed}")))
    turns = running(cand.withColumn("draw", draw), ["feeder_id"], [F.col("draw").asc(), F.col("site_id").asc()])
    order = [F.col("turn").asc(), F.col("feeder_id").asc(), F.col("site_id").asc()]
    ranked = running(turns.withColumnRenamed("pos", "turn"), [], order, {"spent": "cost_usd"})
    return _within(ranked, F.lit(budget * reserve_fraction), None).select(
        *cand.columns, F.lit("exploration").alias("selected_by")
    )


def budget_grid(max_budget: float, steps: int = 20, low: float = 0.05, high: float = 1.5) -> list[float]:
    return [max_budget * (low + (high - low) * i / (steps - 1)) for i in range(steps)]


def allocation_curve(cand: DataFrame, max_budget: float, steps: int = 20) -> DataFrame:
    """What the greedy selection yields under each budget of the grid.

    A candidate belongs to every budget at or above its running cost: candidates are
    first summed per smallest such budget, then accumulated over the grid rows.
    """
    grid = budget_grid(max_budget, steps)
    ranked = running(cand, [], _by("roi"), {"spent": "cost_usd"})
    step = F.coalesce(*[F.when(F.col("spent") <= b, F.lit(i)) for i, b in enumerate(grid)])
    sums = ranked.withColumn("step", step).where(F.col("step").isNotNull()).groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("benefit_usd").alias("benefit"), F.sum("recoverable_kwh_month").alias("kwh")
    )
    upto = sums.select(F.explode(F.sequence(F.col("step"), F.lit(steps - 1))).alias("step"), "n", "benefit", "kwh")
    empty = cand.sparkSession.range(steps).select(
        F.col("id").cast("int").alias("step"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("benefit"), F.lit(0.0).alias("kwh")
    )
    per = upto.unionByName(empty).groupBy("step").agg(
        F.sum("n").alias("n"), F.sum("benefit").alias("benefit"), F.sum("kwh").alias("kwh")
    )
    budget = F.get(F.array(*[F.lit(b) for b in grid]), F.col("step"))
    return per.select(
        rnd(budget, 0).alias("budget_usd"),
        F.col("n").alias("n_sites"),
        rnd("benefit", 0).alias("expected_benefit_usd"),
        rnd("kwh", 0).alias("recoverable_kwh_month"),
    )


# --- work orders --------------------------------------------------------------

# metres on either side of the origin that the visit order tells apart: 2^30
MORTON_BITS = 31


def grid_cluster(x: Column, y: Column, grid_m: float) -> Column:
    """Cell of a square grid: the column in the upper half of the number, the row in the lower."""
    return (F.floor(x / grid_m) * (1 << 32) + F.floor(y / grid_m)).cast("long")


def morton(x: str, y: str) -> Column:
    """Bit-interleaved position: neighbours in the plane stay close in the order."""
    bits = [
        f"shiftleft(shiftright(cast(floor({c}) as bigint) + {1 << MORTON_BITS - 1}L, {bit}) & 1L, {2 * bit + odd})"
        for c, odd in ((x, 0), (y, 1))
        for bit in range(MORTON_BITS)
    ]
    return F.expr(" | ".join(bits))


def clusters(selected: DataFrame, cfg: dict) -> DataFrame:
    return selected.withColumn("cluster", grid_cluster(F.col("x"), F.col("y"), cfg["budget"]["grid_m"]))


def route(clustered: DataFrame) -> DataFrame:
    """Visit order inside each cluster."""
    keyed = clustered.withColumn("route_key", morton("x", "y"))
    return running(keyed, ["cluster"], [F.col("route_key").asc(), F.col("site_id").asc()], position="route_seq")


def work_orders(selected: DataFrame, cfg: dict) -> DataFrame:
    """Clusters by benefit, sites in route order inside, dealt to crews and days."""
    b = cfg["budget"]
    keyed = clusters(selected, cfg).withColumn("route_key", morton("x", "y"))
    worth = keyed.groupBy("cluster").agg(rnd(F.sum("benefit_usd"), 2).alias("cluster_benefit"))
    order = [F.col("cluster_benefit").desc(), F.col("cluster").asc(), F.col("route_key").asc(), F.col("site_id").asc()]
    ranked = running(keyed.join(worth, "cluster"), [], order)
    cap, crews = max(1, b["visits_per_crew_day"]), max(1, b["num_crews"])
    seq = F.col("pos") - 1
    return ranked.select(
        *selected.columns,
        "cluster",
        "cluster_benefit",
        seq.alias("visit_seq"),
        (F.floor(seq / cap) % crews).cast("long").alias("crew"),
        F.floor(seq / (cap * crews)).cast("long").alias("day"),
    )


def reasons_by_site(risk: DataFrame, customers: DataFrame) -> DataFrame:
    """Reasons of the riskiest meter of each site."""
    reasons = F.struct("reason_1", "reason_2", "reason_3")
    meters = risk.join(customers.select("customer_unit_id", "transformer_site_id"), "customer_unit_id")
    top = meters.groupBy(F.col("transformer_site_id").alias("site_id")).agg(
        F.max_by(reasons, F.struct("risk_score", "customer_unit_id")).alias("r")
    )
    used = [F.when(F.col(f"r.reason_{i}") != "", F.col(f"r.reason_{i}")) for i in (1, 2, 3)]
    return top.select("site_id", "r.*", F.concat_ws(" | ", *used).alias("checklist"))


# --- rankings, metrics, summary -----------------------------------------------


def ranking_feeders(balance: DataFrame) -> DataFrame:
    cols = ["feeder_id", "pnt_pct", "technical_pct", "pnt_kwh", "total_losses_pct"]
    return balance.select(*cols).orderBy(F.col("pnt_kwh").desc(), "feeder_id")


def ranking_sites(cand: DataFrame, k: int = BUDGET["ranked_sites"]) -> DataFrame:
    return cand.orderBy(*_by("roi")).limit(k)


def ranking_units(risk: DataFrame, k: int = BUDGET["ranked_units"]) -> DataFrame:
    return risk.orderBy(F.col("risk_score").desc(), "customer_unit_id").limit(k)


def ranking_zones(zones: DataFrame) -> DataFrame:
    return zones.orderBy(F.col("unaccounted_load_kw").desc(), "feeder_id", "zone_id")


def top_hits(risk: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Hits and recoverable energy among the top k meters, for several k in one pass.

    ``ks`` may run into the hundreds of thousands, so positions come from the
    distributed scan and each row is counted in the cut-offs it falls under.
    """
    ranked = running(
        risk.select("customer_unit_id", "risk_score", "recoverable_kwh_month"),
        [],
        [F.col("risk_score").desc(), F.col("customer_unit_id").asc()],
    )
    hit = truth.where("is_theft").select("customer_unit_id", F.lit(1).alias("hit")).distinct()
    limits = F.array_compact(F.array(*[F.when(F.col("pos") <= k, F.lit(k)) for k in sorted(set(ks))]))
    return (
        ranked.join(hit, "customer_unit_id", "left")
        .withColumn("k", F.explode(limits))
        .groupBy("k")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("hit").alias("hits"),
            F.sum(F.when(F.col("hit") == 1, F.col("recoverable_kwh_month")).otherwise(0.0)).alias("kwh"),
        )
    )


def precision_at_k(risk: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    return top_hits(risk, truth, ks).select("k", rnd(F.col("hits") / F.col("n"), 4).alias("precision_at_k"))


def energy_at_k(risk: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    return top_hits(risk, truth, ks).select("k", rnd("kwh", 1).alias("energy_at_k"))


def campaign_summary(
    cand: DataFrame, selected: DataFrame, greedy_pick: DataFrame, explore: DataFrame, risk: DataFrame,
    truth: DataFrame, cfg: dict,
) -> DataFrame:
    b = cfg["budget"]
    budget, reserve = b["field_usd"], b["exploration_reserve_frac"]
    gain = F.greatest(F.col("ve_neto_usd"), F.lit(0.0))
    improvement = F.col("gain") - F.coalesce(greedy_pick.agg(F.sum(gain)).scalar(), F.lit(0.0))
    ks = {cpv: int(budget / cpv) for cpv in b["cost_per_visit_grid"]}
    hits = materialize(precision_at_k(risk, truth, list(ks.values())), "precision")
    sums = selected.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("benefit_usd"), F.lit(0.0)).alias("benefit"),
        F.coalesce(F.sum("recoverable_kwh_month"), F.lit(0.0)).alias("kwh"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("gain"),
    )
    return sums.select(
        F.lit(budget).alias("budget_field_usd"),
        rnd(F.lit(budget * (1.0 - reserve)), 0).alias("directed_budget_usd"),
        rnd(F.lit(budget * reserve), 0).alias("exploration_budget_usd"),
        F.col("n").alias("sites_selected"),
        explore.agg(F.count(F.lit(1))).scalar().alias("exploration_sites"),
        F.col("n").alias("visits_total"),
        rnd("benefit", 0).alias("expected_benefit_usd"),
        rnd("kwh", 0).alias("expected_recoverable_kwh_month"),
        rnd("cost", 0).alias("cost_spent_usd"),
        rnd(F.col("benefit") / F.greatest(F.lit(1.0), F.col("cost")), 2).alias("roi_campaign"),
        rnd(improvement, 0).alias("milp_vs_greedy_improvement_usd"),
        F.lit(b["num_crews"]).alias("crews"),
        F.lit(b["visits_per_crew_day"]).alias("visits_per_crew_day"),
        *[
            hits.where(F.col("k") == k).agg(F.max("precision_at_k")).scalar().alias(f"precision_at_cost_{cpv}")
            for cpv, k in ks.items()
        ],
    )


def field_feedback(inspections: DataFrame) -> DataFrame:
    """Hit rate, recovered energy and cost of returned inspections by source."""
    hit = F.col("finding").cast("double")
    return inspections.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_inspections"),
        F.count(F.when(F.col("finding"), 1)).alias("n_findings"),
        rnd(F.avg(hit), 4).alias("hit_rate"),
        rnd(F.sum("recovered_kwh"), 1).alias("recovered_kwh"),
        rnd(F.sum("actual_cost_usd"), 2).alias("cost_usd"),
    )
