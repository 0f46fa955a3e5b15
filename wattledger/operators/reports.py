"""Tables behind the status page, reports and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions.numeric import rnd
from wattledger.operators import network as N
from wattledger.scale import top_rows


def feeder_status(balance: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """Stages done per feeder, judged by which outputs hold rows for it."""
    rows = balance.withColumn("done", F.array(F.lit("ingest"), F.lit("electrical"), F.lit("balance")))
    for stage, out in outputs.items():
        present = out.select("feeder_id").distinct().withColumn("hit", F.lit(stage))
        rows = rows.join(present, "feeder_id", "left")
        rows = rows.withColumn("done", F.array_union("done", F.array_compact(F.array("hit")))).drop("hit")
    total = len(P.PIPELINE_STAGES)
    return rows.select(
        "feeder_id",
        F.lit(total).alias("stages_total"),
        F.size("done").alias("stages_done"),
        rnd(F.size("done") * (100.0 / total), 1).alias("progress_pct"),
        F.concat_ws(",", F.array_sort("done")).alias("stages_done_list"),
        (F.col("balance_coherent") & ~F.col("pnt_negative_alert")).alias("balance_closed"),
        "failed_checks",
        "pnt_pct",
        "technical_pct",
        "n_customers",
        "n_tx_sites",
    )


def mark_prioritized(status: DataFrame, plan: DataFrame) -> DataFrame:
    """Status with the campaign stage added for the feeders the plan covers."""
    total = len(P.PIPELINE_STAGES)
    hit = plan.select("feeder_id").distinct().withColumn("hit", F.lit("prioritization"))
    done = F.array_union(F.split("stages_done_list", ","), F.array_compact(F.array("hit")))
    return status.join(hit, "feeder_id", "left").withColumn("done", done).select(
        *[c for c in status.columns if c not in ("stages_done", "progress_pct", "stages_done_list")],
        F.size("done").alias("stages_done"),
        rnd(F.size("done") * (100.0 / total), 1).alias("progress_pct"),
        F.concat_ws(",", F.array_sort("done")).alias("stages_done_list"),
    )


def feeder_report(net: N.Network, leaves: DataFrame, topo: DataFrame, balance: DataFrame) -> DataFrame:
    """Connected elements by trace and the loss breakdown per feeder."""
    reached = net.tree.roots.where(
        (F.col("root") == N.source_of(F.col("feeder_id"))) & (F.col("hops") > 0)
    ).select(*N.KEY)
    meters = leaves.where(F.col("leaf") == "customer").select(*N.KEY)
    down = reached.join(meters, N.KEY, "left_semi").groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n_customers_downstream"))
    size = net.node.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    edge = net.edge.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n_edges"))
    rules = topo.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("topo_findings"))
    out = balance.select(
        "feeder_id", "energy_header_kwh", "energy_billed_kwh", "energy_streetlight_kwh", "energy_technical_kwh",
        "technical_pct", "pnt_kwh", "pnt_pct", "balance_coherent", "failed_checks",
    )
    for part in (size, edge, down, rules):
        out = out.join(part, "feeder_id", "left")
    return out.na.fill(0)


def consolidated(balance: DataFrame, status: DataFrame) -> DataFrame:
    """System totals, weighted by head energy."""
    head = F.sum("energy_header_kwh")
    closed = F.count(F.when(F.col("balance_closed"), 1))
    return balance.join(status.select("feeder_id", "balance_closed"), "feeder_id", "left").agg(
        F.count(F.lit(1)).alias("feeders"),
        rnd(F.sum("pnt_kwh") * 100.0 / head, 2).alias("pnt_pct"),
        rnd(F.sum("energy_technical_kwh") * 100.0 / head, 2).alias("technical_pct"),
        closed.alias("balances_closed"),
    )


def executive_sites(loadability: DataFrame, k: int = P.BUDGET["report_rows"]) -> DataFrame:
    """The most loaded sites of each feeder and its number of overloaded ones."""
    order = [F.col("loadability").desc_nulls_last(), F.col("site_id").asc()]
    over = loadability.groupBy("feeder_id").agg(
        F.count(F.when(F.col("loadability_class").contains("overloaded"), 1)).alias("n_overloaded")
    )
    return top_rows(loadability, ["feeder_id"], order, k, "rank").join(over, "feeder_id").select(
        "feeder_id", "rank", "site_id", "bank_config", "capacity_kva", "s_max_kva", "loadability_class", "n_overloaded"
    )


def executive_risk(risk: DataFrame, k: int = P.BUDGET["report_rows"]) -> DataFrame:
    order = [F.col("risk_score").desc(), F.col("customer_unit_id").asc()]
    return top_rows(risk, ["feeder_id"], order, k, "rank").select("feeder_id", "rank", "customer_unit_id", "risk_score")


def executive_split(balance: DataFrame) -> DataFrame:
    """Head energy by destination, one row per feeder and part."""
    parts = {"Facturada": "energy_billed_kwh", "Alumbrado": "energy_streetlight_kwh", "Técnicas": "energy_technical_kwh", "PNT": "pnt_kwh"}
    entries = F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).alias("kwh")) for n, c in parts.items()])
    return balance.select("feeder_id", F.explode(entries).alias("p")).select("feeder_id", "p.part", "p.kwh")


def inspection_sheets(plan: DataFrame, risk: DataFrame, customers: DataFrame, reasons: DataFrame, k: int = P.BUDGET["sheet_meters"]) -> DataFrame:
    """Per planned site: its visit, its riskiest meters and the checklist."""
    where = customers.select("customer_unit_id", F.col("transformer_site_id").alias("site_id"))
    visit = plan.select("site_id", "feeder_id", "roi", "benefit_usd", "visit_seq", "day")
    rows = risk.select("customer_unit_id", "risk_score").join(where, "customer_unit_id").join(visit, "site_id")
    order = [F.col("risk_score").desc(), F.col("customer_unit_id").asc()]
    text = F.coalesce(F.nullif("checklist", F.lit("")), F.lit("Inspección visual de acometidas y medidores"))
    return (
        top_rows(rows, ["site_id"], order, k, "rank")
        .join(reasons.select("site_id", "checklist"), "site_id", "left")
        .select("site_id", "feeder_id", "roi", "benefit_usd", "visit_seq", "day", "rank", "customer_unit_id", "risk_score", text.alias("checklist"))
    )


def dashboard(status: DataFrame, balance: DataFrame, loadability: DataFrame, findings: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Headline numbers and counts as (panel, item, detail, value) rows."""

    def panel(df: DataFrame, name: str, item: str, detail=None) -> DataFrame:
        detail = F.lit("") if detail is None else F.col(detail)
        keyed = df.select(F.coalesce(item, F.lit("none")).alias("item"), detail.alias("detail"))
        return keyed.groupBy("item", "detail").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit(name).alias("panel"), "item", "detail", "value"
        )

    head = F.sum("energy_header_kwh")
    kpis = {
        "feeders": F.count(F.lit(1)).cast("double"),
        "progress_pct": rnd(F.avg("progress_pct"), 1),
        "balances_closed": F.count(F.when(F.col("balance_closed"), 1)).cast("double"),
        "pnt_pct": rnd(F.sum("pnt_kwh") * 100.0 / head, 2),
        "technical_pct": rnd(F.sum("energy_technical_kwh") * 100.0 / head, 2),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in kpis])
    kpi = (
        balance.join(status.select("feeder_id", "progress_pct", "balance_closed"), "feeder_id")
        .agg(*[c.alias(n) for n, c in kpis.items()])
        .select(F.explode(entries).alias("k"))
        .select(F.lit("kpi").alias("panel"), "k.item", F.lit("").alias("detail"), "k.value")
    )
    return (
        kpi.unionByName(panel(loadability, "loadability", "loadability_class"))
        .unionByName(panel(findings, "quality", "rule_id", "severity"))
        .unionByName(panel(anomalies, "lighting", "anomaly", "severity"))
    )
