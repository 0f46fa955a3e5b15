"""Data-quality rules over segments, sites, meters, devices, zones and lamps."""

# The Spanish finding and evidence texts are output values that readers of the reports expect.
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions.numeric import lookup
from wattledger.operators import network as N
from wattledger.session import materialize

OUT = ("feeder_id", "rule_id", "element_id", "severity", "evidence", "confidence", "suggested_value")


def _num(c: Column) -> Column:
    """One decimal, as the source system prints voltages and lengths."""
    return F.format_string("%.1f", c)


def _emit(rows: DataFrame, cfg: dict, rule: str, element: str, evidence: Column, suggested: Column | None = None):
    enabled, severity, confidence = cfg["rules"][rule]
    hit = rows if enabled else rows.where(F.lit(False))
    return hit.select(
        "feeder_id",
        F.lit(rule).alias("rule_id"),
        F.col(element).alias("element_id"),
        F.lit(severity).alias("severity"),
        evidence.alias("evidence"),
        F.lit(confidence).alias("confidence"),
        (F.lit(None).cast("string") if suggested is None else suggested).alias("suggested_value"),
    )


def with_upstream(segments: DataFrame) -> DataFrame:
    """Each segment next to the segment that feeds its start node (``u_*`` columns).

    The feeding side has one row per node (smallest segment id), so a node with
    very many outgoing segments skews only the streamed side of the join.
    """
    fields = ("segment_id", "conductor_code", "material", "phase", "voltage_ll", "section")
    feed = (
        segments.groupBy("feeder_id", F.col("node_to").alias("node_from"))
        .agg(F.min(F.struct(*fields)).alias("u"))
        .select("feeder_id", "node_from", *[F.col(f"u.{f}").alias(f"u_{f}") for f in fields])
    )
    return segments.join(feed, ["feeder_id", "node_from"], "left")


def children_conductors(segments: DataFrame) -> DataFrame:
    """Per node: the range of conductor codes among its outgoing primary segments."""
    return (
        segments.where(F.col("section") == "primary")
        .groupBy("feeder_id", F.col("node_from").alias("node_to"))
        .agg(F.min("conductor_code").alias("c_min"), F.max("conductor_code").alias("c_max"))
    )


def sandwich_conductor(pairs: DataFrame, segments: DataFrame, cfg: dict) -> DataFrame:
    hit = pairs.join(children_conductors(segments), ["feeder_id", "node_to"]).where(
        (F.col("section") == "primary")
        & (F.col("u_section") == "primary")
        & (F.col("c_min") == F.col("c_max"))
        & (F.col("c_min") == F.col("u_conductor_code"))
        & (F.col("conductor_code") != F.col("u_conductor_code"))
    )
    text = F.format_string("Conductor %s entre tramos %s iguales", F.col("conductor_code"), F.col("u_conductor_code"))
    return _emit(hit, cfg, "R01", "segment_id", text, F.col("u_conductor_code"))


def short_change(pairs: DataFrame, cfg: dict) -> DataFrame:
    hit = pairs.where(
        (F.col("section") == "primary")
        & (F.col("length_m") < cfg["rule_min_length_m"])
        & (F.col("conductor_code") != F.col("u_conductor_code"))
    )
    return _emit(
        hit, cfg, "R02", "segment_id", F.concat(F.lit("Tramo de "), _num(F.col("length_m")), F.lit(" m con cambio de conductor"))
    )


def gauge_growth(pairs: DataFrame, cfg: dict) -> DataFrame:
    order = {code: i for i, code in enumerate(P.PRIMARY_CONDUCTORS)}
    own, up = lookup(order, F.col("conductor_code")), lookup(order, F.col("u_conductor_code"))
    hit = pairs.where((F.col("section") == "primary") & (own > up))
    text = F.format_string(
        "Calibre creciente %s->%s alejándose de la fuente", F.col("u_conductor_code"), F.col("conductor_code")
    )
    return _emit(hit, cfg, "R03", "segment_id", text)


def material_change(pairs: DataFrame, cfg: dict) -> DataFrame:
    hit = pairs.where(F.col("material") != F.col("u_material"))
    text = F.format_string("Cambio de material %s->%s", F.col("u_material"), F.col("material"))
    return _emit(hit, cfg, "R04", "segment_id", text)


def phase_gap(pairs: DataFrame, cfg: dict) -> DataFrame:
    missing = F.array_except(F.split("phase", ""), F.split("u_phase", ""))
    hit = pairs.where(F.col("u_phase").isNotNull() & (F.size(missing) > 0))
    text = F.format_string("Fases %s no contenidas en el padre %s", F.col("phase"), F.col("u_phase"))
    return _emit(hit, cfg, "R06", "segment_id", text)


def voltage_jump(pairs: DataFrame, cfg: dict) -> DataFrame:
    own, up = F.col("voltage_ll"), F.col("u_voltage_ll")
    hit = pairs.where((own != 0) & (up != 0) & (F.abs(up - own) / F.greatest(up, own) > 0.05))
    text = F.concat(F.lit("Salto de tensión "), _num(up), F.lit("->"), _num(own), F.lit(" V sin transformador"))
    return _emit(hit, cfg, "R07", "segment_id", text)


def wrong_feeder(segments: DataFrame, cfg: dict) -> DataFrame:
    hit = segments.where((F.col("feeder_id_declared") != "") & (F.col("feeder_id_declared") != F.col("feeder_id")))
    text = F.format_string("feeder_id declarado %s != traza %s", F.col("feeder_id_declared"), F.col("feeder_id"))
    return _emit(hit, cfg, "R08", "segment_id", text, F.col("feeder_id"))


def ampacity(segments: DataFrame, below: DataFrame, cfg: dict) -> DataFrame:
    """``below``: load in kW accumulated at each node from everything downstream."""
    kva = F.col("kw") / cfg["electrical"]["default_site_pf"]
    amps = kva * 1000.0 / F.when(F.col("phase") == "ABC", F.col("voltage_ll") * math.sqrt(3.0)).otherwise(
        F.col("voltage_ll")
    )
    loaded = segments.join(below.withColumnRenamed("node", "node_to"), ["feeder_id", "node_to"])
    hit = loaded.where((F.col("kw") > 0) & (F.col("voltage_ll") > 0)).withColumn("amps", amps)
    hit = hit.where(F.col("amps") > F.col("ampacity_a"))
    text = F.format_string("Corriente %.0f A > ampacidad %.0f A", F.round("amps", 0), F.col("ampacity_a"))
    return _emit(hit, cfg, "R09", "segment_id", text)


def wrong_section(segments: DataFrame, cfg: dict) -> DataFrame:
    v = F.coalesce("voltage_ll", F.lit(0.0))
    high = (F.col("section") == "secondary") & (v > 1000)
    low = (F.col("section") == "primary") & (v > 0) & (v < 1000)
    text = F.when(high, F.lit("Conductor secundario en tramo de tensión primaria")).otherwise(
        F.lit("Conductor primario en tramo de baja tensión")
    )
    return _emit(segments.where(high | low), cfg, "R10", "segment_id", text)


def transformer_feed(sites: DataFrame, segments: DataFrame, cfg: dict) -> DataFrame:
    feed = segments.groupBy("feeder_id", F.col("node_to").alias("node_id")).agg(
        F.min_by("voltage_ll", "segment_id").alias("v_up")
    )
    hit = sites.join(feed, ["feeder_id", "node_id"]).where(F.col("v_up") < 1000)
    text = F.concat(F.lit("Transformador en nodo de "), _num(F.col("v_up")), F.lit(" V (no primario)"))
    return _emit(hit, cfg, "R13", "site_id", text)


def untraced_customer(customers: DataFrame, net: N.Network, cfg: dict) -> DataFrame:
    """Meters that are nodes but whose feeding node is no transformer secondary."""
    at = customers.select("feeder_id", F.col("customer_unit_id").alias("node"))
    here = at.join(net.node, N.KEY, "left_semi").join(net.parent.select(*N.KEY, "parent"), N.KEY, "left")
    hit = here.where(~F.coalesce(F.col("parent").endswith("_S"), F.lit(False)))
    return _emit(hit, cfg, "R15", "node", F.lit("Cliente sin puesto de transformación por traza"))


def device_state(devices: DataFrame, cfg: dict) -> DataFrame:
    hit = devices.where(~F.coalesce(F.col("normal_state").isin("NA", "NC"), F.lit(False)))
    return _emit(hit, cfg, "R20", "device_id", F.lit("Dispositivo de maniobra sin estado normal definido"))


def not_reachable(sites: DataFrame, customers: DataFrame, net: N.Network, lost: DataFrame, cfg: dict) -> DataFrame:
    """Sites off the network or cut off; meters that are nodes but cut off."""
    at_site = sites.where(F.col("node_id").isNotNull()).withColumnRenamed("node_id", "node")
    absent = at_site.join(net.node, N.KEY, "left_anti")
    cut = at_site.join(lost, N.KEY, "left_semi")
    site_rows = _emit(absent.unionByName(cut), cfg, "R22", "site_id", F.lit("Puesto no alcanzable desde la fuente"))
    at = customers.select("feeder_id", F.col("customer_unit_id").alias("node")).join(lost, N.KEY, "left_semi")
    return site_rows.unionByName(_emit(at, cfg, "R22", "node", F.lit("Cliente no alcanzable desde la fuente")))


def orphan_zone(zones: DataFrame, cfg: dict) -> DataFrame:
    hit = zones.where((F.col("zone_id") != "HEAD") & ~F.col("has_upstream_device"))
    return _emit(hit, cfg, "R23", "zone_id", F.lit("Zona de protección sin dispositivo aguas arriba"))


def lamp_without_site(streetlights: DataFrame, cfg: dict) -> DataFrame:
    site = F.col("transformer_site_id")
    hit = streetlights.where(site.isNull() | (site == ""))
    return _emit(hit, cfg, "R25", "streetlight_id", F.lit("Luminaria sin puesto de transformación por traza"))


def run_rules(t, net: N.Network, zones: DataFrame, load: DataFrame, cfg: dict) -> DataFrame:
    """All rules as one union; disabled rules contribute nothing and are pruned."""
    segments = materialize(t.segments, "segments")
    pairs = materialize(with_upstream(segments), "segment-pairs")
    # first: with second feeds this numbers the network, and the sums go by the numbers
    lost = N.unreachable(net)
    below = N.downstream_sum(net, load, ["kw"])
    parts = [
        sandwich_conductor(pairs, segments, cfg),
        short_change(pairs, cfg),
        gauge_growth(pairs, cfg),
        material_change(pairs, cfg),
        phase_gap(pairs, cfg),
        voltage_jump(pairs, cfg),
        wrong_feeder(segments, cfg),
        ampacity(segments, below, cfg),
        wrong_section(segments, cfg),
        transformer_feed(t.sites, segments, cfg),
        untraced_customer(t.customers, net, cfg),
        device_state(t.switching_devices, cfg),
        not_reachable(t.sites, t.customers, net, lost, cfg),
        orphan_zone(zones, cfg),
        lamp_without_site(t.streetlights, cfg),
    ]
    return reduce(DataFrame.unionByName, parts)
