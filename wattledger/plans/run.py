"""One analysis run over all feeders: the shared intermediate tables, each built at most once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.operators import balance as B
from wattledger.operators import campaign, flow, labels, lighting, loadpoint, quality, reconcile, risk, state, transfers
from wattledger.operators import features as X
from wattledger.operators import network as N
from wattledger.operators import series as S
from wattledger.session import materialize


class Run:
    """``t`` offers the canonical entity tables as attributes; nothing runs until asked for."""

    def __init__(self, t, cfg: dict):
        self.t, self.cfg = t, cfg
        self.hours = P.hours_per_period(cfg)

    @cached_property
    def consumption(self) -> DataFrame:
        """Readings on the full calendar, written once for all that read them."""
        return materialize(self.t.consumption, "consumption")

    @cached_property
    def energy(self) -> DataFrame:
        return materialize(loadpoint.meter_energy(self.consumption), "meter-energy")

    @cached_property
    def demand(self) -> DataFrame:
        return materialize(loadpoint.meter_demand(self.energy, self.t.customers, self.cfg), "meter-demand")

    @cached_property
    def head(self) -> DataFrame:
        return materialize(B.header_totals(self.t.header_meters), "head")

    @property
    def head_periods(self) -> DataFrame:
        return self.head.select("feeder_id", "n_periods")

    @cached_property
    def load_points(self) -> DataFrame:
        return loadpoint.load_points(self.demand, self.cfg)

    @cached_property
    def loading(self) -> DataFrame:
        return B.site_loading(self.t, self.demand, self.head, self.cfg)

    @cached_property
    def loadability(self) -> DataFrame:
        return B.loadability_table(self.loading, self.cfg)

    @cached_property
    def balance_inputs(self) -> DataFrame:
        return B.balance_inputs(self.t, self.demand, self.head, self.cfg)

    @cached_property
    def balance(self) -> DataFrame:
        return materialize(B.close_balance(self.balance_inputs, self.cfg), "balance")

    @cached_property
    def net(self) -> N.Network:
        return N.build(self.t.segments, self.t.sites)

    @cached_property
    def _zones(self) -> tuple[DataFrame, DataFrame]:
        return N.zones(self.net, self.t.switching_devices, self.t.sites, self.t.customers)

    @property
    def zones(self) -> DataFrame:
        return self._zones[0]

    @property
    def node_zone(self) -> DataFrame:
        return self._zones[1]

    @cached_property
    def node_load(self) -> DataFrame:
        return materialize(N.node_load(self.demand, self.t.sites, self.head_periods, self.hours), "node-load")

    @cached_property
    def findings(self) -> DataFrame:
        return materialize(quality.run_rules(self.t, self.net, self.zones, self.node_load, self.cfg), "findings")

    @cached_property
    def reliability(self) -> DataFrame:
        return B.reliability(self.findings, self.net.edge, self.balance)

    @cached_property
    def series(self) -> DataFrame:
        """From the tables' own series where they hold one row per meter already."""
        own = getattr(self.t, "series", None)
        return materialize(S.series(self.consumption) if own is None else own, "series")

    @cached_property
    def mined(self) -> DataFrame:
        return labels.mine_labels(self.series, self.t.customers, self.cfg)

    @cached_property
    def features(self) -> DataFrame:
        return materialize(X.build_features(self.series, self.t.customers), "features")

    @cached_property
    def proxy_risk(self) -> DataFrame:
        """Screening risk with the recoverable energy per month, no model needed."""
        monthly = S.mean(S.last(F.col("kwh"), 6)) / self.cfg["months_per_period"]
        recent = self.series.select("customer_unit_id", monthly.alias("recoverable_kwh_month"))
        return materialize(B.risk_proxy(self.series, self.cfg).join(recent, "customer_unit_id"), "proxy-risk")

    @cached_property
    def estimate(self) -> DataFrame:
        pseudo = state.pseudo_measurements(state.site_stats(self.consumption, self.t.customers, self.hours))
        return materialize(state.wls(pseudo, state.measured_total(self.balance, self.cfg)), "estimate")

    @cached_property
    def flow(self) -> tuple[flow.FlowNetwork, flow.FlowResult]:
        net = flow.network(self.t.segments, self.node_load, self.cfg)
        return net, flow.sweep(net)

    @cached_property
    def transfers(self) -> DataFrame:
        return transfers.infer_transfers(self.t.header_transfer, self.cfg)


def screening(run: Run) -> dict[str, DataFrame]:
    """The fast level: balance, load points, imbalance, uncertainty, lighting, topology, quality."""
    return {
        "feeder_balance": run.balance,
        "transformer_loadability": run.loadability,
        "customer_risk": B.risk_proxy(run.series, run.cfg),
        "load_point_balance": run.load_points,
        "load_point_findings": loadpoint.load_point_findings(run.load_points, run.cfg),
        "transformer_imbalance": reconcile.imbalance(run.demand, run.head_periods, run.cfg),
        "loss_uncertainty": reconcile.loss_uncertainty(run.balance, run.cfg),
        "streetlight_anomalies": lighting.lighting_anomalies(run.t.streetlights),
        "protection_zones": run.zones,
        "data_quality_findings": run.findings,
        "feeder_topology": N.summary(run.net, run.zones, N.validate(run.net), run.findings),
        "reliability_index": run.reliability,
        "pq_reconciliation": reconcile.pq_reconcile(run.energy, run.t.customers, run.cfg),
        "pq_reconciliation_causes": reconcile.pq_causes(run.energy, run.t.customers, run.cfg),
    }


def by_feeder(run: Run) -> dict[str, DataFrame]:
    """The tables of the full level that depend on each feeder alone."""
    out = screening(run)
    del out["customer_risk"]
    out.update(
        {
            "zone_state_estimation": state.zone_reconcile(run.estimate, run.t.sites, run.node_zone),
            "pnt_independent": state.independent_pnt(run.estimate, run.balance, run.cfg),
        }
    )
    return out


def fitted(run: Run) -> dict[str, DataFrame]:
    """The tables of the full level that are fitted over all feeders of the run."""
    from wattledger.operators import curves

    positive = risk.positives(run.t.theft_labels, run.mined)
    clusters, centroids = curves.load_curves(run.series)
    return {
        "customer_risk": risk.train_risk(run.features, positive, run.cfg),
        "load_clusters": clusters,
        "load_curve_centroids": centroids,
    }


def full(run: Run) -> dict[str, DataFrame]:
    """Screening plus state estimation, model risk and load curves."""
    return {**by_feeder(run), **fitted(run)}


def inspection_plan(run: Run, risk_table: DataFrame, reliability: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates, directed and exploratory picks, work orders, curve, rankings, summary.

    ``risk_table``: customer_unit_id, risk_score, recoverable_kwh_month, reason_1..3.
    """
    b = run.cfg["budget"]
    budget, reserve = b["field_usd"], b["exploration_reserve_frac"]
    directed = budget * (1.0 - reserve)
    cand = materialize(
        campaign.candidates(risk_table, run.t.customers, run.t.poles, run.cfg, reliability), "candidates"
    )
    selected = materialize(campaign.two_stage(cand, directed), "selected")
    explore = materialize(campaign.exploration(cand, budget, reserve), "exploration")
    why = campaign.reasons_by_site(risk_table, run.t.customers)
    plan = campaign.work_orders(selected, run.cfg).join(why, "site_id", "left")
    return {
        "candidates": cand,
        "inspection_plan": plan,
        "exploration_plan": explore,
        "allocation_curve": campaign.allocation_curve(cand, budget),
        "ranking_sites": campaign.ranking_sites(cand),
        "ranking_customer_units": campaign.ranking_units(risk_table),
        "campaign_summary": campaign.campaign_summary(
            cand, selected, campaign.greedy(cand, directed), explore, risk_table, run.t.theft_labels, run.cfg
        ),
    }
