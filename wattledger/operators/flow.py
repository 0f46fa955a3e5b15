"""Radial power flow of all feeders in one job.

A backward sweep is a subtree sum of node currents, a forward sweep a path sum of
branch voltage drops; both are running sums over depth-first numbers, so a sweep takes
the same four shuffles at any depth.  Each sweep is written to the shared folder, so the
plan stays one sweep deep.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import rnd
from wattledger.operators import intervals as I
from wattledger.operators import network as N
from wattledger.scale import along, running
from wattledger.session import materialize, materialize_with

TOLERANCE = 1e-6
MAX_SWEEPS = 100
KEY = N.KEY
#: a node by its depth-first number, and the numbers of one slice of the running sums
AT = ["feeder_id", "entry"]
SLICE_ROWS = 1 << 13


@dataclass
class FlowNetwork:
    node: DataFrame  # feeder_id, node, p, q per phase group
    branch: DataFrame  # feeder_id, node (= lower end), parent, segment_id, r, x
    place: DataFrame  # feeder_id, node, entry, last: depth-first numbers
    v0: float


@dataclass
class FlowResult:
    node: DataFrame  # voltages per node
    branch: DataFrame  # current and loss per branch
    progress: DataFrame  # feeder_id, iterations, converged


def network(segments: DataFrame, load: DataFrame, cfg: dict, section: str = "primary") -> FlowNetwork:
    """Nodes and branches of one section; P from the load table, Q by power factor."""
    km = F.col("length_m") / 1000.0
    seg = segments.where(F.col("section") == section).select(
        "feeder_id",
        F.col("node_to").alias("node"),
        F.col("node_from").alias("parent"),
        "segment_id",
        "length_m",
        (F.col("r_ohm_per_km") * km).alias("r"),
        (F.col("x_ohm_per_km") * km).alias("x"),
    )
    branch = materialize(N.parents(seg), "branches")
    tan_phi = math.tan(math.acos(cfg["powerflow"]["pf"]))
    node = (
        N.nodes(branch)
        .join(load, KEY, "left")
        .select(*KEY, F.coalesce("kw", F.lit(0.0)).alias("p"))
        .withColumn("q", F.col("p") * tan_phi)
    )
    node = materialize(node, "flow-nodes")
    v0 = cfg["electrical"]["voltage"]["ll_mv"] / math.sqrt(3.0)
    return FlowNetwork(node, branch, _places(branch, N.build_tree(branch, node.select(*KEY), "flow-tree")), v0)


def _places(branch: DataFrame, tree: N.Tree) -> DataFrame:
    """Numbers of all nodes; those on or behind a cycle follow as single nodes, with nothing above or below them."""
    numbers = I.number(tree.roots, tree.levels, branch).select(*KEY, "entry", "last")
    if not tree.cyclic:
        return numbers
    held = numbers.groupBy("feeder_id").agg(F.max("last").alias("held"))
    loose = running(tree.roots.where(F.col("root").isNull()).select(*KEY), ["feeder_id"], [F.col("node")])
    own = (F.coalesce("held", F.lit(0)) + F.col("pos")).alias("entry")
    loose = loose.join(held, "feeder_id", "left").select(*KEY, own).withColumn("last", F.col("entry"))
    return materialize(numbers.unionByName(loose), "flow-places")


def _below(state: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``state`` (feeder_id, entry, last, ...) with the sums of ``values`` over each node and everything below it.

    Every node is met twice along the numbers: where it opens, with its value, and at the last number below it.
    """
    kept = [c for c in state.columns if c not in (*AT, *values)]
    opens = F.struct(F.col("entry").alias("at"), F.lit(0).alias("o"), *[c.alias(n) for n, c in values.items()], *kept)
    none = [F.lit(0.0).alias(n) for n in values] + [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in kept]
    ends = F.struct(F.col("last").alias("at"), F.lit(1).alias("o"), *none)
    met = state.select(*AT, F.explode(F.array(opens, ends)).alias("m")).select(*AT, "m.*")
    upto = along(met, ["feeder_id"], "at", {f"_upto_{n}": n for n in values}, SLICE_ROWS, ["o"])
    end = F.col("o") == 1
    sums = [F.sum(F.when(end, F.col(f"_upto_{n}")).otherwise(F.col(n) - F.col(f"_upto_{n}"))).alias(n) for n in values]
    return upto.groupBy(*AT).agg(*[F.max(c).alias(c) for c in kept], *sums)


def _above(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` (feeder_id, entry, last, ...) with the sums of ``values`` over each node and all its ancestors.

    A value is added where its node opens and taken off behind the last number below it.
    """
    kept = [c for c in rows.columns if c not in (*AT, *values)]
    opens = F.struct(F.col("entry").alias("at"), F.lit(1).alias("o"), *[c.alias(f"_d_{n}") for n, c in values.items()], "entry", *kept)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("entry", *kept)]
    closes = F.struct((F.col("last") + 1).alias("at"), F.lit(0).alias("o"), *[(-c).alias(f"_d_{n}") for n, c in values.items()], *none)
    met = rows.select("feeder_id", F.explode(F.array(opens, closes)).alias("m")).select("feeder_id", "m.*")
    upto = along(met, ["feeder_id"], "at", {n: f"_d_{n}" for n in values}, SLICE_ROWS, ["o"])
    return upto.where("o = 1").select(*AT, *kept, *values)


def _load_current(p: Column, q: Column, vr: Column, vi: Column, phases: float) -> tuple[Column, Column]:
    """conj(S / V) per phase, S in kVA."""
    m = vr * vr + vi * vi
    scale = F.lit(1000.0 / phases)
    return (p * vr + q * vi) * scale / m, (p * vi - q * vr) * scale / m


def _loaded(state: DataFrame, z: DataFrame, powers: list[str]) -> DataFrame:
    """Nodes of ``state`` with load at or below them, and the tops.

    All others carry no current and stand at the voltage of what is above them, sweep after
    sweep, so they are filled in from the last one.
    """
    load = F.when(reduce(Column.__or__, [F.col(c) != 0 for c in powers]), 1.0).otherwise(0.0)
    tops = state.join(z, AT, "left_anti").select(*AT, F.lit(True).alias("top"))
    return _below(state, {"held": load}).join(tops, AT, "left").where("held > 0 or top").select(*state.columns)


def sweep(net: FlowNetwork, max_sweeps: int = MAX_SWEEPS) -> FlowResult:
    """Single-phase equivalent of a balanced feeder (three-phase powers)."""
    z = materialize(net.place.join(net.branch.select(*KEY, "r", "x"), KEY).select(*AT, "r", "x"), "flow-z")
    state = net.node.join(net.place, KEY).select(*AT, "last", "p", "q", F.lit(net.v0).alias("vr"), F.lit(0.0).alias("vi"))
    everywhere = materialize(state, "flow-start")
    state = materialize(_loaded(everywhere, z, ["p", "q"]), "flow-state")

    def drop() -> dict[str, Column]:
        return {
            "dr": F.col("r") * F.col("ir") - F.col("x") * F.col("ii"),
            "di": F.col("r") * F.col("ii") + F.col("x") * F.col("ir"),
        }

    open_feeders = None
    for turn in range(1, max_sweeps + 1):
        ir, ii = _load_current(F.col("p"), F.col("q"), F.col("vr"), F.col("vi"), 3.0)
        current = _below(state.select(*AT, "last", "p", "q", "vr", "vi"), {"ir": ir, "ii": ii})
        branch = materialize(current.join(z, AT, "left").na.fill(0.0, ["r", "x"]), "flow-branch")
        path = _above(branch, drop())
        moved = F.hypot(F.lit(net.v0) - F.col("dr") - F.col("vr"), -F.col("di") - F.col("vi"))
        state, seen = materialize_with(
            path.select(
                *AT, "last", "p", "q", (F.lit(net.v0) - F.col("dr")).alias("vr"), (-F.col("di")).alias("vi"), moved.alias("dv"), "ir", "ii"
            ),
            "flow-state",
            moved=F.max("dv"),
        )
        # a feeder's count stops at its first sweep below tolerance; later sweeps only refine it
        done = state.groupBy("feeder_id").agg((F.max("dv") < TOLERANCE * net.v0).alias("ok"))
        step = done.select("feeder_id", "ok", F.lit(turn).alias("turn"))
        open_feeders = step if open_feeders is None else open_feeders.unionByName(step)
        if seen["moved"] is None or seen["moved"] < TOLERANCE * net.v0:
            break
    progress = open_feeders.groupBy("feeder_id").agg(
        F.coalesce(F.min(F.when(F.col("ok"), F.col("turn"))), F.lit(max_sweeps)).alias("iterations")
    )
    loss = (F.col("ir") * F.col("ir") + F.col("ii") * F.col("ii")) * F.col("r") * 3.0 / 1000.0
    whole = everywhere.select(*AT, "last", "p", "q").join(state.select(*AT, "ir", "ii"), AT, "left").join(z, AT, "left").na.fill(0.0)
    path = _above(materialize(whole, "flow-whole"), drop()).select("*", (F.lit(net.v0) - F.col("dr")).alias("vr"), (-F.col("di")).alias("vi"))
    state = materialize(net.place.select(*KEY, "entry").join(path, AT).drop("entry", "last", "dr", "di"), "flow-result")
    flows = state.select(*KEY, "ir", "ii", "r", "x").join(net.branch.select(*KEY, "segment_id", "parent"), KEY).withColumn("loss_kw", loss)
    return FlowResult(state.select(*KEY, "p", "q", "vr", "vi"), flows, progress.withColumn("converged", F.col("iterations") < max_sweeps))


def results(net: FlowNetwork, res: FlowResult) -> DataFrame:
    pu = F.hypot("vr", "vi") / net.v0
    volts = res.node.groupBy("feeder_id").agg(F.min(pu).alias("v_min"), F.max(pu).alias("v_max"))
    losses = res.branch.groupBy("feeder_id").agg(F.sum("loss_kw").alias("loss"), F.count(F.lit(1)).alias("n_branches"))
    return volts.join(losses, "feeder_id").join(res.progress, "feeder_id").select(
        "feeder_id",
        rnd("loss", 3).alias("primary_loss_kw"),
        rnd("v_min", 4).alias("v_min_pu"),
        rnd("v_max", 4).alias("v_max_pu"),
        "converged",
        "iterations",
        "n_branches",
    )


def conservation(net: FlowNetwork, res: FlowResult) -> DataFrame:
    """Relative mismatch between source power and loads plus losses."""
    head = F.col("parent") == N.source_of(F.col("feeder_id"))
    flows = res.branch.groupBy("feeder_id").agg(
        F.sum(F.when(head, F.col("ir")).otherwise(0.0)).alias("i_src"), F.sum("loss_kw").alias("loss")
    )
    loads = net.node.groupBy("feeder_id").agg(F.sum("p").alias("load"))
    source = F.col("i_src") * (3.0 * net.v0 / 1000.0)
    error = F.abs(source - (F.col("load") + F.col("loss"))) / F.greatest(F.col("load"), F.lit(1e-9))
    return flows.join(loads, "feeder_id").select(
        "feeder_id",
        rnd(source, 3).alias("source_kw"),
        rnd("load", 3).alias("load_kw"),
        rnd("loss", 3).alias("loss_kw"),
        (error < 1e-4).alias("conserved"),
    )


def tolerance_check(own: DataFrame, other: DataFrame, cfg: dict) -> DataFrame:
    """Two result tables side by side against the loss and voltage tolerances."""
    tol = cfg["powerflow"]
    b = other.select(
        "feeder_id", F.col("primary_loss_kw").alias("other_loss_kw"), F.col("v_min_pu").alias("other_v_min_pu")
    )
    loss = F.abs(F.col("primary_loss_kw") - F.col("other_loss_kw")) * 100.0 / F.greatest(
        F.abs("other_loss_kw"), F.lit(1e-6)
    )
    volt = F.abs(F.col("v_min_pu") - F.col("other_v_min_pu")) * 100.0
    return own.join(b, "feeder_id").select(
        "feeder_id",
        "primary_loss_kw",
        "other_loss_kw",
        rnd(loss, 3).alias("loss_diff_pct"),
        (loss <= tol["tol_losses_pct"]).alias("within_loss_tol"),
        rnd(volt, 3).alias("voltage_diff_pct"),
        (volt <= tol["tol_voltage_pct"]).alias("within_voltage_tol"),
    )


# --- three-phase --------------------------------------------------------------

PH = ("a", "b", "c")


def z_matrix(branch: DataFrame, z0_ratio: float) -> DataFrame:
    """Phase matrix per branch from sequence impedances, one row per cell.

    ``branch`` carries the total positive-sequence r and x; the zero sequence is a
    multiple of it where the source system has none.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(3)]))
    same = F.col("c.i") == F.col("c.j")

    def cell(z1: Column) -> Column:
        z0 = z1 * z0_ratio
        return F.when(same, (z0 + z1 * 2.0) / 3.0).otherwise((z0 - z1) / 3.0)

    return branch.withColumn("c", cells).select(
        *KEY, "segment_id", F.col("c.i").alias("i"), F.col("c.j").alias("j"),
        cell(F.col("r")).alias("r"), cell(F.col("x")).alias("x"),
    )


def _wide(cells: DataFrame) -> DataFrame:
    """The nine cells of a branch side by side."""
    at = {f"{n}{i}{j}": (n, i, j) for n in ("r", "x") for i in range(3) for j in range(3)}
    return cells.groupBy(*KEY).agg(
        *[F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col(n))).alias(name) for name, (n, i, j) in at.items()]
    )


def sweep_3ph(
    net: FlowNetwork, phase_load: DataFrame, cells: DataFrame, max_sweeps: int = MAX_SWEEPS
) -> FlowResult:
    """Unbalanced flow: ``phase_load`` is (feeder_id, node, pa, qa, pb, qb, pc, qc) in kW/kvar."""
    v0 = net.v0
    angle = {"a": 0.0, "b": -2.0 * math.pi / 3.0, "c": 2.0 * math.pi / 3.0}
    source = {p: (v0 * math.cos(angle[p]), v0 * math.sin(angle[p])) for p in PH}
    powers = [f"{n}{p}" for p in PH for n in "pq"]
    volts = [f"v{n}{p}" for p in PH for n in "ri"]
    amps = [f"i{n}{p}" for p in PH for n in "ri"]
    state = net.place.join(phase_load, KEY, "left").na.fill(0.0).select(*AT, "last", *powers)
    state = state.select("*", *[F.lit(source[p][k]).alias(f"v{n}{p}") for p in PH for k, n in enumerate("ri")])
    z = materialize(net.place.select(*KEY, "entry").join(_wide(cells), KEY).drop("node"), "flow3-z")
    everywhere = materialize(state, "flow3-start")
    state = materialize(_loaded(everywhere, z, powers), "flow3-state")
    drops = {}
    for i, p in enumerate(PH):
        re = sum((F.col(f"r{i}{j}") * F.col(f"ir{o}") - F.col(f"x{i}{j}") * F.col(f"ii{o}") for j, o in enumerate(PH)), F.lit(0.0))
        im = sum((F.col(f"r{i}{j}") * F.col(f"ii{o}") + F.col(f"x{i}{j}") * F.col(f"ir{o}") for j, o in enumerate(PH)), F.lit(0.0))
        drops[f"dr{p}"], drops[f"di{p}"] = re, im
    fresh = {f"n{n}{p}": F.lit(source[p][k]) - F.col(f"d{n}{p}") for p in PH for k, n in enumerate("ri")}

    def dropped(rows: DataFrame, *kept: str) -> DataFrame:
        """New voltages of rows with currents and impedances."""
        own = materialize(rows.na.fill(0.0).select(*AT, "last", *kept, *amps, *[c.alias(n) for n, c in drops.items()]), "flow3-branch")
        return _above(own, {n: F.col(n) for n in drops}).withColumns(fresh)

    trail = None
    for turn in range(1, max_sweeps + 1):
        parts = {}
        for p in PH:
            parts[f"ir{p}"], parts[f"ii{p}"] = _load_current(F.col(f"p{p}"), F.col(f"q{p}"), F.col(f"vr{p}"), F.col(f"vi{p}"), 1.0)
        current = _below(state.select(*AT, "last", *powers, *volts), parts)
        moved = F.greatest(
            *[F.hypot(F.col(f"nr{p}") - F.col(f"vr{p}"), F.col(f"ni{p}") - F.col(f"vi{p}")) for p in PH]
        )
        state, seen = materialize_with(
            dropped(current.join(z, AT, "left"), *powers, *volts).select(
                *AT, "last", *powers, *amps, moved.alias("dv"), *[F.col(f"n{n}{p}").alias(f"v{n}{p}") for p in PH for n in "ri"]
            ),
            "flow3-state",
            moved=F.max("dv"),
        )
        step = state.groupBy("feeder_id").agg((F.max("dv") < TOLERANCE * v0).alias("ok")).withColumn("turn", F.lit(turn))
        trail = step if trail is None else trail.unionByName(step)
        if seen["moved"] is None or seen["moved"] < TOLERANCE * v0:
            break
    # loss = Re(conj(I) . Z I) per branch
    loss = F.lit(0.0)
    for i, p in enumerate(PH):
        for j, o in enumerate(PH):
            re = F.col(f"r{i}{j}") * F.col(f"ir{o}") - F.col(f"x{i}{j}") * F.col(f"ii{o}")
            im = F.col(f"r{i}{j}") * F.col(f"ii{o}") + F.col(f"x{i}{j}") * F.col(f"ir{o}")
            loss = loss + F.col(f"ir{p}") * re + F.col(f"ii{p}") * im
    neutral = F.hypot(sum((F.col(f"ir{p}") for p in PH), F.lit(0.0)), sum((F.col(f"ii{p}") for p in PH), F.lit(0.0)))
    whole = dropped(everywhere.select(*AT, "last").join(state.select(*AT, *amps), AT, "left").join(z, AT, "left"))
    state = materialize(whole.select(*AT, *amps, *[F.col(f"n{n}{p}").alias(f"v{n}{p}") for p in PH for n in "ri"]), "flow3-result")
    flows = state.select(*AT, *amps).join(z, AT).join(net.place.select(*KEY, "entry"), AT).join(net.branch.select(*KEY, "segment_id", "parent"), KEY).select(
        *KEY, "segment_id", "parent", *amps, (loss / 1000.0).alias("loss_kw"), neutral.alias("neutral_a")
    )
    progress = trail.groupBy("feeder_id").agg(
        F.coalesce(F.min(F.when(F.col("ok"), F.col("turn"))), F.lit(max_sweeps)).alias("iterations")
    )
    state = net.place.select(*KEY, "entry").join(state.drop(*amps), AT).drop("entry")
    return FlowResult(state, flows, progress.withColumn("converged", F.col("iterations") < max_sweeps))


def results_3ph(net: FlowNetwork, res: FlowResult) -> DataFrame:
    """Loss, lowest phase voltage, and unbalance and neutral current of the head branch."""
    low = F.least(*[F.hypot(f"vr{p}", f"vi{p}") for p in PH]) / net.v0
    volts = res.node.groupBy("feeder_id").agg(F.min(low).alias("v_min"))
    losses = res.branch.groupBy("feeder_id").agg(F.sum("loss_kw").alias("loss"))
    mags = [F.hypot(f"ir{p}", f"ii{p}") for p in PH]
    avg = (mags[0] + mags[1] + mags[2]) / 3.0
    spread = F.greatest(*[F.abs(m - avg) for m in mags])
    head = (
        res.branch.where(F.col("parent") == N.source_of(F.col("feeder_id")))
        .withColumn("unbalance", F.when(avg > 0, spread / avg * 100.0).otherwise(0.0))
        .groupBy("feeder_id")
        .agg(F.min(F.struct("segment_id", "unbalance", "neutral_a")).alias("h"))
        .select("feeder_id", "h.unbalance", "h.neutral_a")
    )
    return volts.join(losses, "feeder_id").join(head, "feeder_id").join(res.progress, "feeder_id").select(
        "feeder_id",
        rnd("loss", 4).alias("total_loss_kw"),
        rnd("v_min", 5).alias("v_min_pu"),
        rnd("unbalance", 2).alias("max_unbalance_pct"),
        rnd("neutral_a", 2).alias("neutral_head_a"),
        "converged",
    )


def phase_loads(demand: DataFrame, sites: DataFrame, periods: DataFrame, hours: float, pf: float) -> DataFrame:
    """Mean kW and kvar per primary node and phase from the meters' phases."""
    tan_phi = math.tan(math.acos(pf))
    per_site = demand.groupBy(F.col("transformer_site_id").alias("site_id")).agg(
        *[F.sum(F.when(F.col("phase") == p.upper(), F.col("kwh_total")).otherwise(0.0)).alias(p) for p in PH]
    )
    kw = {p: F.sum(F.col(p) / (F.col("n_periods") * hours)) for p in PH}
    return (
        sites.join(per_site, "site_id")
        .join(periods, "feeder_id")
        .groupBy("feeder_id", F.col("node_id").alias("node"))
        .agg(*[kw[p].alias(f"p{p}") for p in PH])
        .select(*KEY, *[c for p in PH for c in (F.col(f"p{p}"), (F.col(f"p{p}") * tan_phi).alias(f"q{p}"))])
    )
