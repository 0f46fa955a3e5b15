"""A run that writes: changed feeders are analysed, and one snapshot holds what is known after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators import balance as B
from wattledger.operators import campaign, incremental, reconcile, reports, transfers
from wattledger.plans.run import Run, by_feeder, fitted, inspection_plan, screening
from wattledger.session import materialize
from wattledger.sources.lake import Lake
from wattledger.sources.snapshots import Writer, counts

#: entity tables whose content decides whether a feeder is analysed again
INPUTS = (
    "sites", "transformer_units", "customers", "segments", "streetlights", "switching_devices", "header_meters",
    "switching_events", "consumption", "poles", "theft_labels",
)
class Selected:
    """The entity tables of another table set, for some feeders only."""

    def __init__(self, tables, feeders: DataFrame):
        self._tables, self._feeders, self._made = tables, feeders.select("feeder_id"), {}

    def __getattr__(self, name: str):
        if name not in self._made:
            found = getattr(self._tables, name)
            if isinstance(found, DataFrame) and "feeder_id" in found.columns:
                found = found.join(self._feeders, "feeder_id", "left_semi")
            self._made[name] = found
        return self._made[name]


#: stage of the pipeline and the table by whose rows it is known to be done for a feeder
STAGE_TABLES = {"topology": "feeder_topology", "state_estimation": "zone_state_estimation", "ml_risk": "customer_risk"}


def campaign_tables(writer: Writer, run: Run) -> dict[str, DataFrame]:
    """The inspection plan over all feeders, from what the run has written for each."""
    risk, balance = writer.read("gold", "customer_risk"), writer.read("gold", "feeder_balance")
    plan = inspection_plan(run, risk, writer.read("gold", "reliability_index"))
    plan["ranking_feeders"] = campaign.ranking_feeders(balance)
    plan["ranking_zones"] = campaign.ranking_zones(writer.read("gold", "zone_state_estimation"))
    return plan


#: by level: the tables of changed feeders, those that are fitted over all feeders, those that follow from all of them
LEVELS: dict[str, tuple[Callable, Callable | None, Callable | None]] = {
    "screening": (screening, None, None),
    "full": (by_feeder, fitted, campaign_tables),
}


def status(writer: Writer, planned: bool) -> DataFrame:
    """Stages done per feeder, judged by the tables as they are after this run."""
    tables = {stage: writer.read("gold", name) for stage, name in STAGE_TABLES.items()}
    known = {stage: table for stage, table in tables.items() if table.columns}
    rows = reports.feeder_status(writer.read("gold", "feeder_balance"), known)
    # the campaign spends one budget over all feeders: each of them has taken part in it
    return reports.mark_prioritized(rows, rows) if planned else rows


def analyse(tables, cfg: dict, lake: Lake, level: str = "screening", force: bool = False, feeders: list[str] | None = None) -> DataFrame:
    """Analyse the feeders whose inputs changed since their last run at this level.

    ``feeders`` limits the analysis to some of them.  Everything the run writes becomes one
    snapshot, committed last: a feeder's rows are replaced in every table, also by none;
    feeders without a head meter any more leave all tables; a run that breaks off changes
    nothing.  What is fitted over all feeders (risk, load curves) is fitted on all of them
    again as soon as one has changed, so no table mixes two fits; then come transfers
    between all heads and their credits, the system's P/Q summary, the campaign, and the
    status of every feeder.  Returns (feeder_id, input_hash) of what was analysed.
    """
    state, store = f"done_{level}", lake.snapshots
    now = materialize(incremental.input_hash({n: getattr(tables, n) for n in INPUTS}, level), "hashes")
    done = store.read("state", state)
    wanted = now if feeders is None else now.where(F.col("feeder_id").isin(feeders))
    todo = wanted if force or not done.columns else incremental.needs_recompute(wanted, done)
    todo = materialize(todo, "todo")
    left = done.join(now, "feeder_id", "left_anti") if done.columns else done
    if todo.isEmpty() and left.isEmpty():
        return todo
    writer, changed = store.begin(), todo.select("feeder_id")
    run, everything = Run(Selected(tables, todo), cfg), Run(tables, cfg)
    of_changed, of_all, of_system = LEVELS[level]

    def put(name: str, table: DataFrame, replaced: DataFrame | None) -> None:
        per_feeder = "feeder_id" in table.columns
        writer.write("gold" if per_feeder else "system", name, table, replaced if per_feeder else None)

    for name, table in of_changed(run).items():
        put(name, table, changed)
    put("balance_inputs", run.balance_inputs, changed)
    for name, table in (of_all(everything) if of_all else {}).items():
        put(name, table, None)
    alive = now.select("feeder_id")
    found = materialize(transfers.infer_transfers(tables.header_transfer, cfg), "transfers")
    put("feeder_transfers", found, None)
    credits = transfers.quantify(tables.header_transfer, found)
    known = writer.read("gold", "balance_inputs").join(alive, "feeder_id", "left_semi")
    put("credited_balance", B.apply_credits(known, credits, cfg), None)
    reconciled = writer.read("gold", "pq_reconciliation")
    if reconciled.columns:
        put("pq_system", reconcile.pq_system(reconciled.join(alive, "feeder_id", "left_semi")), None)
    for name, table in (of_system(writer, everything) if of_system else {}).items():
        put(name, table, None)
    if writer.read("gold", "feeder_balance").columns:
        put("feeder_status", status(writer, of_system is not None).join(alive, "feeder_id", "left_semi"), None)
    writer.write("state", state, todo, changed)
    writer.commit(alive)
    return todo


def gold_counts(lake: Lake, names: list[str]) -> DataFrame:
    """(entity, rows, feeders) of gold tables."""
    return counts(lake.snapshots, "gold", names)
