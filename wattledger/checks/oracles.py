"""The same results as plain SQL, for a second engine.

``CTES`` are named building blocks; an oracle is a SELECT over them and gets
exactly the blocks it mentions, directly or through other blocks.
"""

from __future__ import annotations

import math
import re

import numpy as np

from wattledger import params as P
from wattledger.checks.queries import CAMPAIGN, KS, PERIOD, SWEEP_CHECK, Z0_RATIO
from wattledger.sources.bench_tables import BANK_ORDER, BANK_SIZE, SEGMENT_TARIFF, UNIT_KVA
from wattledger.sources.vendor_layers import BANK_TEXT, TARIFF_TEXT

# What is expected is stated here and not taken from the code under test.
WINDOWS = (3, 6, 12, 24)
FEATURES = (
    *[f"{stat}_{w}" for w in WINDOWS for stat in ("mean", "std", "cv")], "trend", "zeros_frac", "max_zero_run", "yoy_ratio", "entropy",
    "estimated_frac", "kvarh_ratio_mean", "kvarh_ratio_std", "z_peer", "consumo_vs_instalada",
)
REQUIRED = {
    "customers": "customer_unit_id feeder_id site_id tariff_class transformer_site_id", "sites": "site_id feeder_id kind bank_config node_id",
    "transformer_units": "unit_id site_id feeder_id sn_kva", "streetlights": "streetlight_id feeder_id technology lamp_w",
    "segments": "segment_id feeder_id node_from node_to length_m conductor_code r_ohm_per_km x_ohm_per_km ampacity_a phase voltage_ll",
    "switching_devices": "device_id feeder_id node_id normal_state", "poles": "pole_id feeder_id", "header_meters": "feeder_id year_month kwh",
    "consumption": "customer_unit_id feeder_id year_month kwh", "theft_labels": "customer_unit_id is_theft", "switching_events": "device_id feeder_id timestamp",
}
ENUMS = {
    ("customers", "tariff_class"): P.TARIFF_CLASSES, ("customers", "phase"): P.PHASES, ("sites", "bank_config"): P.BANK_CONFIGS, ("segments", "phase"): P.PHASES,
    ("switching_devices", "normal_state"): ("NA", "NC"), ("streetlights", "technology"): P.LAMP_TECHNOLOGIES, ("switching_events", "motivo"): P.SWITCHING_REASONS,
}

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}
_BODY: dict[str, str] = {}

CFG = P.settings(months_per_period=3.0, budget=CAMPAIGN)
EL, TH = CFG["electrical"], CFG["thresholds"]
HP = P.hours_per_period(CFG)
FP = P.loss_factor_value(CFG)


def r(expr: str, n: int) -> str:
    """Half-up rounding with summation noise removed first."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,{n + 5})), {n}) AS DOUBLE)"


def case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def nth(values, index: str) -> str:
    return case(index, dict(enumerate(values)))


def feeder(f: str) -> str:
    return f"('F' || lpad(CAST({f} AS VARCHAR), 2, '0'))"


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def oracle(name: str, sql: str) -> None:
    _BODY[name] = sql


# --- canonical projection -----------------------------------------------------

cte("meter", f"""SELECT c_custkey AS ck, c_acctbal, c_mktsegment, c_nationkey AS f, c_custkey // 375 AS si, c_custkey // 75 AS lp,
  {feeder('c_nationkey')} AS feeder_id, (c_custkey // 375) * 20 + 7 AS nk FROM customer""")
cte("cust", f"""SELECT ck, f, si, lp, 'C' || ck AS customer_unit_id, feeder_id, feeder_id || '-LP' || lp AS site_id,
  'PO' || (nk * 25 + f) AS pole_id, {case('c_mktsegment', SEGMENT_TARIFF, "'residential'")} AS tariff_class,
  substr('ABC', CAST(ck % 3 + 1 AS INTEGER), 1) AS phase, 1.0::DOUBLE + abs(c_acctbal) / 1000.0 AS installed_load_kw,
  CAST(ck % 10 + 1 AS DOUBLE) AS service_drop_kva, feeder_id || '-S' || si AS transformer_site_id, c_acctbal FROM meter""")
cte("theft", "SELECT customer_unit_id, c_acctbal < -500 AS is_theft FROM cust")
cte("lines", """SELECT o_custkey AS ck, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q, l_quantity * 60.0::DOUBLE AS e, l_discount, l_tax, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("readings", """SELECT ck, q, sum(e) AS kwh, sum(e * (0.3::DOUBLE + l_discount)) AS kvarh, count(*) FILTER (l_returnflag = 'R') > 1 AS estimated
  FROM lines GROUP BY 1, 2""")
cte("quarters", """SELECT unnest(range(min(year(l_shipdate) * 4 + quarter(l_shipdate) - 1), max(year(l_shipdate) * 4 + quarter(l_shipdate) - 1) + 1)) AS q FROM lineitem""")
YM = "printf('%04d-%02d', CAST(q // 4 AS BIGINT), CAST((q % 4) * 3 + 1 AS BIGINT))"
cte("cons", f"""SELECT customer_unit_id, feeder_id, transformer_site_id, tariff_class, site_id, {YM} AS year_month, row_number() OVER (PARTITION BY m.ck ORDER BY q) - 1 AS t,
  coalesce(kwh, 0.0) AS kwh, coalesce(kvarh, 0.0) AS kvarh, coalesce(estimated, false) AS estimated
  FROM (SELECT * FROM cust CROSS JOIN quarters) m LEFT JOIN readings USING (ck, q)""")
cte("np", "SELECT count(*) AS n FROM quarters")
cte("head", f"""SELECT f, feeder_id, q, {YM} AS year_month, sum(e * (1.12::DOUBLE + l_tax)) AS kwh, sum(e * (0.3::DOUBLE + l_discount)) AS kvarh
  FROM lines JOIN meter USING (ck) GROUP BY 1, 2, 3, 4""")
cte("hp", "SELECT feeder_id, sum(kwh) AS energy_header, count(*) AS n_periods FROM head GROUP BY 1")
cte("htr", f"""SELECT feeder_id, f, q, {YM} AS year_month, q - min(q) OVER () AS t,
  m * (1.0::DOUBLE + CASE WHEN q - min(q) OVER () > 14 THEN CASE WHEN f % 2 = 0 THEN -0.4::DOUBLE ELSE 0.4::DOUBLE END ELSE 0.0 END
    + ((f * 7 + (q - min(q) OVER ())) % 3) * 0.01::DOUBLE) AS kwh
  FROM (SELECT f, feeder_id, avg(kwh) AS m FROM head GROUP BY 1, 2) CROSS JOIN quarters""")
cte("sk", "SELECT DISTINCT f, si, feeder_id, nk, (f + si * 3) % 7 AS b, feeder_id || '-S' || si AS site_id FROM meter")
cte("site", f"""SELECT f, si, b, nk, site_id, feeder_id, 'PO' || (nk * 25 + f) AS pole_id, {nth(BANK_ORDER, 'b')} AS bank_config, feeder_id || '-N' || nk AS node_id FROM sk""")
_P0 = case("sn_kva", {k: v[0] for k, v in P.TRANSFORMER_CATALOG.items()})
_PK = case("sn_kva", {k: v[1] for k, v in P.TRANSFORMER_CATALOG.items()})
_P0F = f"coalesce({_P0}, round(CAST(sn_kva * {P.CATALOG_P0_FRAC} AS DECIMAL(38,12)), 4)::DOUBLE)"
_PKF = f"coalesce({_PK}, round(CAST(sn_kva * {P.CATALOG_PK_FRAC} AS DECIMAL(38,12)), 4)::DOUBLE)"
cte("unit0", f"""SELECT *, {nth(BANK_SIZE, 'b')} - CASE WHEN (f + si) % 11 = 0 AND {nth(BANK_SIZE, 'b')} > 1 THEN 1 ELSE 0 END AS nu FROM sk""")
cte("unit", f"""SELECT site_id || '-U' || u AS unit_id, site_id, feeder_id, sn_kva, {_P0F} AS p0_kw, {_PKF} AS pk_kw, CASE WHEN u = 1 AND f % 9 = 0 THEN 127.0::DOUBLE ELSE 220.0::DOUBLE END AS voltage_ln
  FROM (SELECT *, CAST({nth(UNIT_KVA, '(f * 3 + si * 5 + CASE WHEN u = 0 AND (f + si) % 4 = 0 THEN 1 ELSE 0 END) % 7')} AS DOUBLE) AS sn_kva
    FROM (SELECT *, unnest(range(CAST(nu AS BIGINT))) AS u FROM unit0))""")
cte("prt", f"SELECT p_partkey AS pk, p_type, p_size, p_partkey % 25 AS f, p_partkey // 25 AS k, {feeder('p_partkey % 25')} AS feeder_id FROM part")
cte("pole", "SELECT 'PO' || pk AS pole_id, feeder_id, CAST((pk * 7919) % 5000 AS DOUBLE) AS x, CAST((pk * 104729) % 5000 AS DOUBLE) AS y FROM prt")
_COND = P.PRIMARY_CONDUCTORS | P.SECONDARY_CONDUCTORS
_prop = {n: case("conductor_code", {c: v[i] for c, v in _COND.items()}) for n, i in (("r_ohm_per_km", 1), ("x_ohm_per_km", 2), ("ampacity_a", 3))}
cte("seg", f"""SELECT *, {', '.join(f'CAST({v} AS DOUBLE) AS {n}' for n, v in _prop.items())} FROM (
  SELECT 'P' || pk AS segment_id, pk AS key, feeder_id, CASE WHEN pk % 97 = 0 THEN 'F99' ELSE feeder_id END AS feeder_id_declared,
    CASE WHEN k = 0 THEN feeder_id || '-SRC' ELSE feeder_id || '-N' || ((k - 1) // 2) END AS node_from, feeder_id || '-N' || k AS node_to,
    CAST(p_size * 3 + 5 AS DOUBLE) AS length_m, {nth(P.PRIMARY_CONDUCTORS, 'p_size % 4')} AS conductor_code,
    CASE WHEN k < 8 THEN 'ABC' ELSE {nth(('ABC', 'AB', 'A'), 'pk % 3')} END AS phase,
    CASE WHEN p_type = 'PROMO' AND p_size > 47 THEN 380.0::DOUBLE ELSE 13800.0::DOUBLE END AS voltage_ll,
    CASE WHEN p_type = 'SMALL' AND p_size > 45 THEN 'cu' ELSE 'al' END AS material, 'primary' AS section, k FROM prt
  UNION ALL
  SELECT 'B' || ck, NULL, feeder_id, feeder_id, feeder_id || '-N' || nk || '_S', 'C' || ck, CAST(ck % 70 + 10 AS DOUBLE),
    {nth(P.SECONDARY_CONDUCTORS, 'ck % 4')}, substr('ABC', CAST(ck % 3 + 1 AS INTEGER), 1), 380.0::DOUBLE,
    {nth([v[0] for v in P.SECONDARY_CONDUCTORS.values()], 'ck % 4')}, 'secondary', NULL FROM meter)""")
cte("lamp", f"""SELECT pk, k, 'L' || pk AS streetlight_id, feeder_id, CASE WHEN p_size <> 50 THEN feeder_id || '-S' || (k // 20) END AS transformer_site_id,
  {nth(('led', 'sodium', 'mercury'), 'pk % 3')} AS technology, CASE WHEN pk % 20 = 0 THEN 'led' ELSE {nth(('led', 'sodium', 'mercury'), 'pk % 3')} END AS installed_technology,
  pk % 33 = 0 AS photocell_fault, {nth((70.0, 100.0, 150.0), 'k % 3')}::DOUBLE AS lamp_w FROM prt WHERE p_size % 10 = 0""")
cte("device", """SELECT 'D' || pk AS device_id, feeder_id, feeder_id || '-N' || k AS node_id,
  CASE WHEN p_size < 3 THEN NULL WHEN p_size % 7 = 0 THEN 'NA' ELSE 'NC' END AS normal_state FROM prt WHERE k % 16 = 5""")
cte("ev", f"""SELECT event_id, {feeder('user_id % 25')} AS feeder_id, ts, {case('event_type', {'error': 'falla', 'purchase': 'transferencia'}, "'maniobra'")} AS motivo,
  value / 100.0 AS duration_h, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 AS affected_kw FROM events""")

# --- energy, load points, banks -------------------------------------------------

_VA = case("tariff_class", {c: v[0] for c, v in EL["velander"].items()}, repr(EL["velander"]["residential"][0]))
_VB = case("tariff_class", {c: v[1] for c, v in EL["velander"].items()}, repr(EL["velander"]["residential"][1]))
_PF = case("tariff_class", EL["power_factor_by_class"], "0.93")
_A, _B = EL["coincidence"]


def velander(e: str) -> str:
    return f"({_VA}::DOUBLE * {e} + {_VB}::DOUBLE * sqrt({e}))"


cte("energy", "SELECT customer_unit_id, feeder_id, sum(kwh) AS kwh_total, sum(kvarh) AS kvarh_total, count(*) AS n_readings FROM cons GROUP BY 1, 2")
cte("demand", f"""SELECT *, {velander('e_month')} AS dmax_kw, {_PF}::DOUBLE AS pf FROM (
  SELECT c.*, kwh_total, kwh_total / (n * 3.0::DOUBLE) AS e_month FROM cust c JOIN energy USING (customer_unit_id, feeder_id) CROSS JOIN np)""")
cte("lp0", f"""SELECT site_id, min(feeder_id) AS feeder_id, min(transformer_site_id) AS transformer_site_id, count(*) AS n, sum(kwh_total) AS energy,
  ({_A} + {_B} / sqrt(count(*))) * sum(dmax_kw) AS p_max, sum(pf * (e_month + 1e-9)) / sum(e_month + 1e-9) AS pf, max(service_drop_kva) AS drop_kva,
  stddev_pop(e_month) AS sd, min(e_month) AS low, sum(dmax_kw) AS peaks, quantile_cont(e_month, 0.5) AS med FROM demand GROUP BY 1""")
_smax = "(CASE WHEN p_max > 0 THEN p_max / pf ELSE 0.0 END)"
cte("lpt", f"""SELECT feeder_id, site_id AS load_point_id, transformer_site_id, n AS n_connections, {r('energy', 1)} AS energy_kwh, {r('p_max', 3)} AS p_max_diversified_kw,
  {r(_smax, 3)} AS s_max_kva, {r('pf', 4)} AS pf, {r('drop_kva', 2)} AS service_drop_kva, {r(f'{_smax} / drop_kva', 3)} AS drop_utilization,
  {r('CASE WHEN med > 0 THEN sd / med ELSE 0 END', 4)} AS intra_dispersion, {r('CASE WHEN med > 0 THEN low / med ELSE 1 END', 4)} AS min_to_median_ratio,
  {r('peaks', 3)} AS sum_of_peaks_kw FROM lp0""")
cte("smax", f"SELECT transformer_site_id AS site_id, ({_A} + {_B} / sqrt(count(*))) * sum(s_max_kva) AS s_max_lp FROM lpt GROUP BY 1")
_EXP = case("bank_config", P.BANK_UNITS)
cte("bk", f"""SELECT s.*, n_units, sn_min, sn_sum, p0_sum, pk_sum,
  CASE WHEN {_EXP} IS NULL OR {_EXP} = n_units THEN CASE WHEN bank_config IN ('single', 'independent') THEN sn_sum
    WHEN bank_config IN ('wye_closed', 'delta_closed', 'delta_4wire') THEN sn_min * 3.0 ELSE sn_min * {TH['open_delta_factor']!r} END END AS capacity_kva,
  CASE WHEN {_EXP} IS NULL OR {_EXP} = n_units THEN CASE WHEN {_EXP} > 1 THEN sn_sum - sn_min * {_EXP} ELSE 0.0 END END AS headroom_kva,
  concat_ws(',', CASE WHEN {_EXP} <> n_units THEN 'P03' END, CASE WHEN v_known >= 2 AND (v_max - v_min) / v_max > 0.01 THEN 'P04' END) AS bank_quality_flags
  FROM site s JOIN (SELECT site_id, count(*) AS n_units, min(sn_kva) AS sn_min, sum(sn_kva) AS sn_sum, sum(p0_kw) AS p0_sum, sum(pk_kw) AS pk_sum,
    count(voltage_ln) AS v_known, max(voltage_ln) AS v_max, min(voltage_ln) AS v_min FROM unit GROUP BY 1) USING (site_id)""")
_BAL = case("technology", CFG["streetlight"]["ballast_loss_frac"], "0.10")
_LIT = CFG["streetlight"]["hours_on_default"] * CFG["streetlight"]["days_per_month"] * 3.0
cte("apx", f"""SELECT feeder_id, transformer_site_id AS site_id, count(*) AS n_lights, sum(lamp_w / 1000.0 * (1.0 + {_BAL}::DOUBLE)) * (any_value(n_periods) * {_LIT!r}::DOUBLE) AS ap_kwh
  FROM lamp JOIN hp USING (feeder_id) GROUP BY 1, 2""")
_FCPF = EL["default_load_factor"] * EL["default_site_pf"]
cte("load", f"""SELECT *, p0_sum * hrs + pk_sum * pow(s_max / sn_sum, 2) * {FP!r}::DOUBLE * hrs AS loss_kwh, CASE WHEN capacity_kva > 0 THEN s_max / capacity_kva END AS ratio FROM (
  SELECT bk.*, n_periods * {HP!r}::DOUBLE AS hrs, CASE WHEN s_max_lp IS NOT NULL THEN s_max_lp + coalesce(ap_kwh, 0) / (n_periods * {HP!r}::DOUBLE) / {_FCPF!r}::DOUBLE
    ELSE (coalesce(billed, 0) + coalesce(ap_kwh, 0)) / (n_periods * {HP!r}::DOUBLE) / {_FCPF!r}::DOUBLE END AS s_max
  FROM bk JOIN hp USING (feeder_id) LEFT JOIN smax USING (site_id) LEFT JOIN (SELECT site_id, ap_kwh FROM apx WHERE site_id IS NOT NULL) USING (site_id)
  LEFT JOIN (SELECT transformer_site_id AS site_id, sum(kwh_total) AS billed FROM demand GROUP BY 1) USING (site_id))""")
_LB = CFG["loadability"]
_CLS = "CASE WHEN ratio IS NULL THEN NULL " + " ".join(
    f"WHEN ratio {'>' if i == 0 else '>='} {v} THEN '{n}'" for i, (n, v) in enumerate(_LB.items())
) + " ELSE 'very_underutilized' END"
cte("ldt", f"""SELECT feeder_id, site_id, pole_id, bank_config, n_units, {r('capacity_kva', 2)} AS capacity_kva, {r('s_max', 2)} AS s_max_kva, {r('ratio', 4)} AS loadability,
  {_CLS} AS loadability_class, {r('headroom_kva', 2)} AS single_phase_headroom_kva, {r('loss_kwh', 1)} AS energy_technical_kwh, bank_quality_flags FROM load""")
cte("ensx", "SELECT feeder_id, sum(duration_h * affected_kw) AS ens_kwh FROM ev WHERE motivo = 'falla' GROUP BY 1")
_SEC = EL["secondary_loss_frac"] * 1.0
cte("bin", f"""SELECT hp.feeder_id, energy_header AS header, coalesce(billed, 0) AS billed, coalesce(ap, 0) AS ap, coalesce(ens_kwh, 0) AS ens, 0.0::DOUBLE AS transferred,
  coalesce(site_loss, 0) + (coalesce(billed, 0) + coalesce(ap, 0)) * {_SEC!r}::DOUBLE * {FP!r}::DOUBLE AS technical, coalesce(nc, 0) AS n_customers, coalesce(ns, 0) AS n_tx_sites,
  CAST(coalesce(nl, 0) AS BIGINT) AS n_streetlights, n_periods FROM hp
  LEFT JOIN (SELECT feeder_id, sum(kwh_total) AS billed, count(*) AS nc FROM demand GROUP BY 1) USING (feeder_id)
  LEFT JOIN (SELECT feeder_id, sum(ap_kwh) AS ap, sum(n_lights) AS nl FROM apx GROUP BY 1) USING (feeder_id) LEFT JOIN ensx USING (feeder_id)
  LEFT JOIN (SELECT feeder_id, sum(loss_kwh) AS site_loss FROM load GROUP BY 1) USING (feeder_id)
  LEFT JOIN (SELECT feeder_id, count(*) AS ns FROM site GROUP BY 1) USING (feeder_id)""")


def close_balance(inputs: str) -> str:
    return f"""SELECT feeder_id, {r('header', 1)} AS energy_header_kwh, {r('billed', 1)} AS energy_billed_kwh, {r('ap', 1)} AS energy_streetlight_kwh, {r('ens', 1)} AS energy_ens_kwh,
  {r('transferred', 1)} AS energy_transferred_kwh, {r('technical', 1)} AS energy_technical_kwh, {r('losses', 1)} AS losses_total_kwh, {r('pnt', 1)} AS pnt_kwh,
  {r('pnt / header * 100', 3)} AS pnt_pct, {r('tech_pct', 3)} AS technical_pct, {r('total_pct', 3)} AS total_losses_pct, failed_checks = '' AS balance_coherent, failed_checks,
  pnt < 0 AS pnt_negative_alert, n_customers, n_tx_sites, n_streetlights, n_periods AS n_months
  FROM (SELECT *, concat_ws(',', CASE WHEN pnt < 0 THEN 'pnt_non_negative' END, CASE WHEN billed + ap + ens > header * 1.0001 THEN 'accounted_within_header' END,
    CASE WHEN NOT (total_pct BETWEEN 0 AND {TH['total_losses_max_pct']}) THEN 'total_losses_plausible' END,
    CASE WHEN NOT (tech_pct BETWEEN {TH['technical_min_pct']} AND {TH['technical_max_pct']}) THEN 'technical_plausible' END, CASE WHEN header <= 0 THEN 'header_positive' END) AS failed_checks
  FROM (SELECT *, losses - technical AS pnt, losses / header * 100 AS total_pct, technical / header * 100 AS tech_pct
  FROM (SELECT *, header + transferred - billed - ap - ens AS losses FROM {inputs})))"""


cte("bal", close_balance("bin"))

# --- network ------------------------------------------------------------------

cte("edge", """SELECT feeder_id, node_from AS parent, node_to AS node, segment_id, length_m, r_ohm_per_km * (length_m / 1000.0) AS r, x_ohm_per_km * (length_m / 1000.0) AS x, section FROM seg
  UNION ALL SELECT feeder_id, node_id, node_id || '_S', site_id || '-TX', 0.0, 0.0, 0.0, 'transformer' FROM site
  WHERE node_id IN (SELECT node_to FROM seg) AND node_id || '_S' IN (SELECT node_from FROM seg)""")
cte("nodes", "SELECT DISTINCT feeder_id, node FROM (SELECT feeder_id, node FROM edge UNION ALL SELECT feeder_id, parent FROM edge)")
cte("closure", """SELECT feeder_id, node, parent AS anc, 1 AS hops, length_m AS dist, r, x FROM edge
  UNION ALL SELECT c.feeder_id, c.node, e.parent, c.hops + 1, c.dist + e.length_m, c.r + e.r, c.x + e.x FROM closure c JOIN edge e ON e.feeder_id = c.feeder_id AND e.node = c.anc""")
cte("selfclosure", "SELECT feeder_id, node, anc, hops FROM closure UNION ALL SELECT feeder_id, node, node, 0 FROM nodes")
cte("nload", f"""SELECT s.feeder_id, node_id AS node, sum(kwh / (n_periods * {HP!r}::DOUBLE)) AS kw FROM site s JOIN (SELECT transformer_site_id AS site_id, sum(kwh_total) AS kwh FROM demand GROUP BY 1) USING (site_id)
  JOIN hp ON hp.feeder_id = s.feeder_id GROUP BY 1, 2""")
cte("accum", "SELECT c.feeder_id, anc AS node, sum(kw) AS kw FROM nload l JOIN selfclosure c ON c.feeder_id = l.feeder_id AND c.node = l.node GROUP BY 1, 2")
cte("leaf", """SELECT feeder_id, customer_unit_id AS node, 'customer' AS leaf FROM cust WHERE customer_unit_id IN (SELECT node FROM nodes)
  UNION ALL SELECT feeder_id, streetlight_id, 'streetlight' FROM lamp WHERE streetlight_id IN (SELECT node FROM nodes)""")
cte("bound", """SELECT feeder_id, node_id AS node, max(device_id) AS zone_id FROM device GROUP BY 1, 2 UNION ALL SELECT DISTINCT feeder_id, feeder_id || '-SRC', 'HEAD' FROM edge""")
cte("nzone", """SELECT c.feeder_id, c.node, arg_min(zone_id, hops) AS zone_id FROM selfclosure c JOIN bound b ON b.feeder_id = c.feeder_id AND b.node = c.anc GROUP BY 1, 2""")
cte("zone", """SELECT b.feeder_id, b.zone_id, p.zone_id AS parent_zone, n_nodes, n_customers, n_tx_sites, (p.zone_id IS NOT NULL OR b.zone_id = 'HEAD') AS has_upstream_device FROM bound b
  LEFT JOIN (SELECT e.feeder_id, e.node, z.zone_id FROM edge e JOIN nzone z ON z.feeder_id = e.feeder_id AND z.node = e.parent) p ON p.feeder_id = b.feeder_id AND p.node = b.node
  LEFT JOIN (SELECT z.feeder_id, z.zone_id, count(*) AS n_nodes, count(c.customer_unit_id) AS n_customers, count(s.site_id) AS n_tx_sites FROM nzone z
    LEFT JOIN cust c ON c.customer_unit_id = z.node LEFT JOIN site s ON s.node_id = z.node GROUP BY 1, 2) n ON n.feeder_id = b.feeder_id AND n.zone_id = b.zone_id""")

# --- quality ------------------------------------------------------------------

cte("pair", """SELECT s.*, u.segment_id AS u_id, u.conductor_code AS u_code, u.material AS u_material, u.phase AS u_phase, u.voltage_ll AS u_v, u.section AS u_section
  FROM seg s LEFT JOIN seg u ON u.feeder_id = s.feeder_id AND u.node_to = s.node_from""")


def rule(name: str, rows: str, element: str, evidence: str, suggested: str = "CAST(NULL AS VARCHAR)") -> str:
    _, severity, confidence = P.RULES[name]
    return f"SELECT feeder_id, '{name}' AS rule_id, {element} AS element_id, '{severity}' AS severity, {evidence} AS evidence, {confidence}::DOUBLE AS confidence, {suggested} AS suggested_value FROM {rows}"


_RANK = {c: i for i, c in enumerate(P.PRIMARY_CONDUCTORS)}


def amps_rule(load: str) -> str:
    return rule(
        "R09",
        f"(SELECT s.*, kw / 0.92 * 1000.0 / CASE WHEN phase = 'ABC' THEN voltage_ll * sqrt(3.0::DOUBLE) ELSE voltage_ll END AS amps FROM seg s JOIN {load} a ON a.feeder_id = s.feeder_id AND a.node = s.node_to WHERE kw > 0) WHERE amps > ampacity_a",
        "segment_id", "printf('Corriente %.0f A > ampacidad %.0f A', round(CAST(amps AS DECIMAL(38,9)), 0)::DOUBLE, ampacity_a)",
    )


RULES = {
    "R01": rule(
        "R01",
        """(SELECT p.*, c_min FROM pair p JOIN (SELECT feeder_id, node_from, min(conductor_code) AS c_min, max(conductor_code) AS c_max FROM seg WHERE section = 'primary' GROUP BY 1, 2) k
      ON k.feeder_id = p.feeder_id AND k.node_from = p.node_to WHERE section = 'primary' AND u_section = 'primary' AND c_min = c_max AND c_min = u_code AND conductor_code <> u_code)""",
        "segment_id", "printf('Conductor %s entre tramos %s iguales', conductor_code, u_code)", "u_code",
    ),
    "R02": rule("R02", f"pair WHERE section = 'primary' AND length_m < {P.RULE_MIN_LENGTH_M} AND conductor_code <> u_code", "segment_id", "printf('Tramo de %.1f m con cambio de conductor', length_m)"),
    "R03": rule("R03", f"pair WHERE section = 'primary' AND {case('conductor_code', _RANK)} > {case('u_code', _RANK)}", "segment_id", "printf('Calibre creciente %s->%s alejándose de la fuente', u_code, conductor_code)"),
    "R04": rule("R04", "pair WHERE material <> u_material", "segment_id", "printf('Cambio de material %s->%s', u_material, material)"),
    "R06": rule("R06", "pair WHERE u_phase IS NOT NULL AND len(list_filter(string_split(phase, ''), lambda c: NOT contains(u_phase, c))) > 0", "segment_id", "printf('Fases %s no contenidas en el padre %s', phase, u_phase)"),
    "R07": rule("R07", "pair WHERE abs(u_v - voltage_ll) / greatest(u_v, voltage_ll) > 0.05", "segment_id", "printf('Salto de tensión %.1f->%.1f V sin transformador', u_v, voltage_ll)"),
    "R08": rule("R08", "seg WHERE feeder_id_declared <> feeder_id", "segment_id", "printf('feeder_id declarado %s != traza %s', feeder_id_declared, feeder_id)", "feeder_id"),
    "R09": amps_rule("accum"),
    "R10": rule(
        "R10", "seg WHERE (section = 'secondary' AND voltage_ll > 1000) OR (section = 'primary' AND voltage_ll < 1000)", "segment_id",
        "CASE WHEN section = 'secondary' THEN 'Conductor secundario en tramo de tensión primaria' ELSE 'Conductor primario en tramo de baja tensión' END",
    ),
    "R13": rule("R13", "(SELECT site.feeder_id, site_id, voltage_ll FROM site JOIN seg ON seg.node_to = site.node_id WHERE voltage_ll < 1000)", "site_id", "printf('Transformador en nodo de %.1f V (no primario)', voltage_ll)"),
    "R20": rule("R20", "device WHERE normal_state IS NULL", "device_id", "'Dispositivo de maniobra sin estado normal definido'"),
    "R25": rule("R25", "lamp WHERE transformer_site_id IS NULL", "streetlight_id", "'Luminaria sin puesto de transformación por traza'"),
}
cte("finding", " UNION ALL ".join(RULES.values()))


def reliability(findings: str, edges: str, balance: str) -> str:
    return f"""SELECT feeder_id, {r('greatest(0.0, 100.0 - q - b)', 1)} AS reliability_index, {r('q', 1)} AS quality_penalty, b AS balance_penalty, n_findings FROM (
  SELECT feeder_id, least(coalesce(pts, 0) / greatest(coalesce(ne, 0), 1), 1.0) * 80.0 AS q, CASE WHEN balance_coherent THEN 0.0::DOUBLE ELSE 20.0::DOUBLE END AS b, coalesce(nf, 0) AS n_findings
  FROM {balance} LEFT JOIN (SELECT feeder_id, sum(CASE severity WHEN 'critica' THEN 5.0::DOUBLE WHEN 'alta' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS pts, count(*) AS nf FROM {findings} GROUP BY 1) USING (feeder_id)
  LEFT JOIN (SELECT feeder_id, count(*) AS ne FROM {edges} GROUP BY 1) USING (feeder_id))"""


cte("rel", reliability("finding", "edge", "bal"))

# --- series, labels, features -------------------------------------------------

cte("risk", f"""SELECT feeder_id, customer_unit_id, {r('s', 4)} AS risk_score, s >= {TH['drop_recovery_pct']} AS flagged_drop, rec AS recoverable_kwh_month FROM (
  SELECT *, CASE WHEN base > 0 THEN greatest(0.0, least(1.0, (base - low) / base)) ELSE 0.0 END AS s FROM (
  SELECT feeder_id, customer_unit_id, quantile_cont(kwh, 0.5) FILTER (t < n // 3) AS base, min(kwh) AS low, (sum(kwh) FILTER (t >= n - 6)) / 6 / 3.0::DOUBLE AS rec FROM cons CROSS JOIN np GROUP BY 1, 2))""")


def label(source: str, weight: float, rows: str, evidence: str) -> str:
    return f"SELECT customer_unit_id, '{source}' AS label_source, {weight}::DOUBLE AS confidence_weight, {evidence} AS evidence FROM {rows}"


def low_runs(drop) -> str:
    """Low runs per meter with what follows them."""
    return f"""(SELECT customer_unit_id, min(t) AS t0, count(*) AS run, any_value(base) AS base, max(t) + 1 AS nxt FROM (
    SELECT *, t - row_number() OVER (PARTITION BY customer_unit_id ORDER BY t) AS g FROM (SELECT cons.customer_unit_id, t, kwh, base FROM cons JOIN base USING (customer_unit_id) WHERE base > 0 AND kwh < base * (1.0::DOUBLE - {drop}::DOUBLE)))
    GROUP BY customer_unit_id, g)"""


def m1_rows(drop) -> str:
    return f"""(SELECT a.customer_unit_id, arg_min(run, t0) AS run FROM {low_runs(drop)} a JOIN cons c ON c.customer_unit_id = a.customer_unit_id AND c.t = a.nxt
    WHERE run >= {TH['drop_recovery_months']} AND c.kwh >= base * 0.9::DOUBLE GROUP BY 1)"""


cte("base", "SELECT customer_unit_id, quantile_cont(kwh, 0.5) FILTER (t < greatest(n // 4, 1)) AS base FROM cons CROSS JOIN np GROUP BY 1")
cte("halves", """SELECT customer_unit_id, quantile_cont(kwh, 0.5) FILTER (t < n // 2) AS a, quantile_cont(kwh, 0.5) FILTER (t >= n // 2) AS b FROM cons CROSS JOIN np GROUP BY 1""")
cte("zrun", """SELECT customer_unit_id, max(run) AS run FROM (SELECT customer_unit_id, g, count(*) AS run FROM (
  SELECT customer_unit_id, t - row_number() OVER (PARTITION BY customer_unit_id ORDER BY t) AS g FROM cons WHERE kwh <= 0.01) GROUP BY 1, 2) GROUP BY 1""")
cte("mean", "SELECT customer_unit_id, transformer_site_id, tariff_class, site_id, sum(kwh) / count(*) AS mean_kwh FROM cons GROUP BY 1, 2, 3, 4")
cte("p05", "SELECT transformer_site_id, tariff_class, count(*) AS n, quantile_cont(mean_kwh, 0.05) AS p05 FROM mean GROUP BY 1, 2")
cte("pmed", "SELECT site_id, count(*) AS n, quantile_cont(mean_kwh, 0.5) AS med FROM mean GROUP BY 1")

# optimal segmentation on the grid 5, 10, 15, 20, 25, 28 with minimum size 3
_T = 28
_ENDS = [*range(5, _T, 5), _T]
cte("brk0", "SELECT customer_unit_id, avg(kwh) AS mu, stddev_pop(kwh) AS sd, " + ", ".join(
    f"sum(kwh) FILTER (t < {e}) AS s{e}, sum(kwh * kwh) FILTER (t < {e}) AS q{e}" for e in _ENDS
) + " FROM cons GROUP BY 1 HAVING stddev_pop(kwh) >= 1e-6")
_prev = "brk0"
for _e in _ENDS:
    _opts = []
    for _s in (0, *_ENDS):
        if _s > _e - 3 or (_s and _s % 5):
            continue
        _ds = f"(s{_e} - s{_s})" if _s else f"s{_e}"
        _dq = f"(q{_e} - q{_s})" if _s else f"q{_e}"
        _cost = f"{_dq} - {_ds} * {_ds} / {_e - _s} + sd * sd * 3.0" + (f" + best{_s}.cost" if _s else "")
        _first = f"best{_s}.first" if _s else str(_e)
        _opts.append(f"{{'cost': {_cost}, 'start': {_s}, 'first': {_first}}}")
    cte(f"brk{_e}", f"SELECT *, list_min([{', '.join(_opts)}]) AS best{_e} FROM {_prev}")
    _prev = f"brk{_e}"
cte("brk", f"SELECT customer_unit_id, mu, best{_T}.first AS b FROM {_prev} WHERE best{_T}.first < {_T}")
cte("shift", """SELECT brk.customer_unit_id, any_value(b) AS b FROM brk JOIN cons USING (customer_unit_id) GROUP BY 1
  HAVING abs(avg(kwh) FILTER (t < b) - avg(kwh) FILTER (t >= b)) > (any_value(mu) + 1e-9) * 0.3""")
cte("shift", """SELECT customer_unit_id, b FROM (SELECT brk.customer_unit_id, b, mu, avg(kwh) FILTER (t < b) AS m1, avg(kwh) FILTER (t >= b) AS m2 FROM brk JOIN cons USING (customer_unit_id) GROUP BY 1, 2, 3)
  WHERE abs(m1 - m2) > (mu + 1e-9) * 0.3""")


def m6(kvarh: str) -> str:
    return label(
        "M6_pf_collapse", 0.5,
        f"""(SELECT customer_unit_id, {r('a', 9)} AS a, {r('b', 9)} AS b FROM (SELECT customer_unit_id, quantile_cont(ratio, 0.5) FILTER (t < n // 2) AS a, quantile_cont(ratio, 0.5) FILTER (t >= n // 2) AS b
      FROM (SELECT customer_unit_id, t, {kvarh} / kwh AS ratio FROM cons CROSS JOIN np WHERE kwh > 0) CROSS JOIN np GROUP BY 1)) WHERE a > 0 AND abs(b - a) / a > 0.5""",
        f"printf('cambio de kVArh/kWh %.2f->%.2f', {r('a', 2)}, {r('b', 2)})",
    )


LABELS = {
    "M1": label("M1_drop_recovery", 0.9, m1_rows(TH["drop_recovery_pct"]), "printf('caída>40%% por %d meses y recuperación', run)"),
    "M2": label("M2_jump_after_intervention", 0.85, f"halves WHERE a > 0 AND b >= a * {1.0 + TH['jump_after_intervention_pct']!r}::DOUBLE", f"printf('salto permanente +%.0f%%', {r('(b / a - 1.0) * 100.0', 0)})"),
    "M4": label("M4_zero_active", 0.5, f"zrun JOIN energy USING (customer_unit_id) WHERE run >= {TH['zero_active_months']} AND kwh_total > 0", "printf('%d meses en cero con servicio activo', run)"),
    "M5": label("M5_level_break", 0.5, "shift", "printf('ruptura de nivel en el mes %d', b)"),
    "M6": m6("kvarh"),
    "M7": label("M7_peer_divergence", 0.35, "mean JOIN p05 USING (transformer_site_id, tariff_class) WHERE mean_kwh < p05 AND mean_kwh > 0", "'bajo el percentil 5 del grupo par'"),
    "M8": label(
        "M8_intra_site_dispersion", 0.6, "mean JOIN pmed USING (site_id) WHERE n >= 2 AND mean_kwh < med * 0.4::DOUBLE AND mean_kwh > 0",
        f"printf('%.0f%% de la mediana de su punto de carga (%d conexiones)', {r('mean_kwh / med * 100.0', 0)}, n)",
    ),
}
cte("mined", " UNION ALL ".join(LABELS.values()))

_win = ", ".join(f"avg(kwh) FILTER (t >= n - {w}) AS mean_{w}, stddev_pop(kwh) FILTER (t >= n - {w}) AS std_{w}" for w in WINDOWS)
_cv = ", ".join(f"CASE WHEN mean_{w} > 0 THEN std_{w} / mean_{w} ELSE 0.0 END AS cv_{w}" for w in WINDOWS)
cte("trend", """SELECT a.customer_unit_id, quantile_cont((b.kwh - a.kwh) / (b.t - a.t), 0.5) AS trend FROM cons a JOIN cons b ON a.customer_unit_id = b.customer_unit_id AND a.t < b.t GROUP BY 1""")
cte("own", f"""SELECT *, {_cv}, CASE WHEN prev > 0 THEN mean_12 / prev ELSE 1.0 END AS yoy_ratio FROM (SELECT customer_unit_id, any_value(feeder_id) AS feeder_id, any_value(transformer_site_id) AS transformer_site_id,
  any_value(tariff_class) AS tariff_class, {_win}, avg(CASE WHEN kwh <= 0.01 THEN 1.0 ELSE 0.0 END) AS zeros_frac, avg(kwh) FILTER (t >= n - 24 AND t < n - 12) AS prev,
  avg(CASE WHEN estimated THEN 1.0 ELSE 0.0 END) AS estimated_frac, avg(kvarh / kwh) FILTER (kwh > 0) AS kvarh_ratio_mean, stddev_pop(CASE WHEN kwh > 0 THEN kvarh / kwh END) AS kvarh_ratio_std
  FROM cons CROSS JOIN np GROUP BY 1)""")
cte("entro", """SELECT customer_unit_id, coalesce(-sum(CASE WHEN kwh > 0 THEN kwh / (tot + 1e-9) * ln(kwh / (tot + 1e-9)) END), 0.0) AS entropy FROM (SELECT *, sum(kwh) OVER (PARTITION BY customer_unit_id) AS tot FROM cons) GROUP BY 1""")
cte("peer", "SELECT transformer_site_id, tariff_class, avg(mean_6) AS pm, stddev_samp(mean_6) AS ps FROM own GROUP BY 1, 2")
cte("feat", """SELECT own.*, trend, coalesce(run, 0)::DOUBLE AS max_zero_run, entropy, coalesce((mean_6 - pm) / (ps + 1e-9), 0.0) AS z_peer, mean_6 / (installed_load_kw * 720.0 + 1e-9) AS consumo_vs_instalada
  FROM own JOIN trend USING (customer_unit_id) LEFT JOIN zrun USING (customer_unit_id) JOIN entro USING (customer_unit_id) JOIN peer USING (transformer_site_id, tariff_class)
  JOIN (SELECT customer_unit_id, installed_load_kw FROM cust) USING (customer_unit_id)""")
cte("flong", " UNION ALL ".join(f"SELECT feeder_id, customer_unit_id, '{n}' AS f, coalesce({n}, 0.0) AS raw, {r(f'coalesce({n}, 0.0)', 9)} AS v FROM feat" for n in FEATURES))
cte("tails", """SELECT *, -ln(count(*) OVER (PARTITION BY feeder_id, f ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY feeder_id, f)::DOUBLE) AS l,
  -ln(count(*) OVER (PARTITION BY feeder_id, f ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY feeder_id, f)::DOUBLE) AS rt, v - avg(v) OVER (PARTITION BY feeder_id, f) AS d FROM flong""")
cte("ecod", f"""SELECT feeder_id, customer_unit_id, {r('greatest(sum(l), sum(rt), sum(CASE WHEN sk < 0 THEN l ELSE rt END))', 6)} AS ecod FROM (SELECT *, sum(d * d * d) OVER (PARTITION BY feeder_id, f) AS sk FROM tails) GROUP BY 1, 2""")
cte("unsup", "SELECT feeder_id, customer_unit_id, percent_rank() OVER (PARTITION BY feeder_id ORDER BY ecod) AS score_unsup FROM ecod")
cte("fstat", "SELECT f, avg(raw) AS m, stddev_pop(raw) AS s FROM flong GROUP BY 1")
cte("reason", """SELECT customer_unit_id, max(txt) FILTER (rn = 1) AS reason_1, max(txt) FILTER (rn = 2) AS reason_2, max(txt) FILTER (rn = 3) AS reason_3 FROM (
  SELECT customer_unit_id, f || CASE WHEN z > 0 THEN ' (+)' ELSE ' (-)' END AS txt, row_number() OVER (PARTITION BY customer_unit_id ORDER BY round(abs(z), 6) DESC, f) AS rn FROM (
  SELECT customer_unit_id, f, CASE WHEN s > 1e-12 THEN (raw - m) / s ELSE 0.0 END AS z FROM flong JOIN fstat USING (f))) GROUP BY 1""")

# --- state estimation ---------------------------------------------------------

cte("sstat", f"""SELECT feeder_id, site_id, avg(kwh) / {HP!r}::DOUBLE AS mean_kw, coalesce(stddev_samp(kwh), 0) / {HP!r}::DOUBLE AS std_kw FROM (
  SELECT feeder_id, transformer_site_id AS site_id, year_month, sum(kwh) AS kwh FROM cons GROUP BY 1, 2, 3) GROUP BY 1, 2""")
cte("pseudo", "SELECT feeder_id, site_id, mean_kw AS z, greatest(std_kw, greatest(mean_kw, 1e-6) * 0.05 + 1e-3) AS sigma FROM sstat")
cte("gain", f"""SELECT feeder_id, w * (total - sz) / (1 + w * ss) AS g, ss FROM (SELECT feeder_id, total, sz, ss, 1.0 / pow(greatest(abs(total) * 0.005, 1e-3), 2) AS w FROM (
  SELECT feeder_id, greatest(0.0, (energy_header_kwh - energy_technical_kwh) / (n_months * {HP!r}::DOUBLE)) AS total FROM bal) JOIN (SELECT feeder_id, sum(z) AS sz, sum(sigma * sigma) AS ss FROM pseudo GROUP BY 1) USING (feeder_id))""")
cte("est", """SELECT p.*, g * sigma * sigma AS correction, z + g * sigma * sigma AS estimate, -g * sigma AS nr, g * g * ss AS chi2, g * g * ss > 1 + 3 * sqrt(2.0::DOUBLE) AS gross_error FROM pseudo p JOIN gain USING (feeder_id)""")
cte("zest", f"""SELECT feeder_id, zone_id, {r('u', 4)} AS unaccounted_load_kw, {r('mx', 4)} AS max_norm_residual, n_sites, {r('CASE WHEN sum(u) OVER (PARTITION BY feeder_id) > 0 THEN u / sum(u) OVER (PARTITION BY feeder_id) ELSE 0 END', 4)} AS share_of_unaccounted,
  gross_error, {r('chi2', 2)} AS chi2 FROM (SELECT e.feeder_id, coalesce(zone_id, 'HEAD') AS zone_id, sum(greatest(correction, 0)) AS u, max(abs(nr)) AS mx, count(*) AS n_sites, bool_or(gross_error) AS gross_error, max(chi2) AS chi2
  FROM est e JOIN site s ON s.site_id = e.site_id LEFT JOIN nzone n ON n.feeder_id = s.feeder_id AND n.node = s.node_id GROUP BY 1, 2)""")

# --- campaign -----------------------------------------------------------------

BUD = CFG["budget"]
_COST = BUD["visit_usd"] + BUD["normalization_usd"]
_DIRECTED = BUD["field_usd"] * (1.0 - BUD["exploration_reserve_frac"])
cte("cand", f"""SELECT site_id, feeder_id, n_units, {r('ben', 4)} AS benefit_usd, {r('mean_risk', 6)} AS mean_risk, max_risk, {r('rec', 4)} AS recoverable_kwh_month, reliability_index, {_COST!r}::DOUBLE AS cost_usd,
  {r(f'ben - {_COST!r}', 4)} AS ve_neto_usd, {r(f'ben / {_COST!r}', 6)} AS roi, pole_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (
  SELECT c.*, ben0 * (coalesce(reliability_index, 100) / 100.0 * 0.5 + 0.5) AS ben, coalesce(rl.reliability_index, 100) AS reliability_index FROM (
  SELECT transformer_site_id AS site_id, min(cust.feeder_id) AS feeder_id, count(*) AS n_units, sum(greatest(0.0, least(1.0, risk_score)) * recoverable_kwh_month * {BUD['recovery_months'] * BUD['tariff_usd_per_kwh']!r}::DOUBLE) AS ben0,
    avg(risk_score) AS mean_risk, max(risk_score) AS max_risk, sum(recoverable_kwh_month) AS rec, min(pole_id) AS pole_id FROM risk JOIN cust USING (customer_unit_id) GROUP BY 1) c
  LEFT JOIN rel rl USING (feeder_id)) LEFT JOIN (SELECT pole_id, x, y FROM pole) USING (pole_id)""")
_run = "sum(cost_usd) OVER ({p} ORDER BY {o} ROWS UNBOUNDED PRECEDING)"
cte("greedy", f"""SELECT *, {_run.format(p='', o='roi DESC, site_id')} AS spent, row_number() OVER (ORDER BY roi DESC, site_id) AS pos FROM cand""")
cte("sel", f"""SELECT * FROM (SELECT c.*, {_run.format(p='PARTITION BY feeder_id', o='ve_neto_usd DESC, site_id')} AS spent, pot / (SELECT sum(greatest(ve_neto_usd, 0)) FROM cand) * {_DIRECTED!r}::DOUBLE AS fb
  FROM cand c JOIN (SELECT feeder_id, sum(greatest(ve_neto_usd, 0)) AS pot FROM cand GROUP BY 1) USING (feeder_id) WHERE ve_neto_usd > 0) WHERE spent <= fb""")


def explore(budget: float) -> str:
    return f"""SELECT * FROM (SELECT *, sum(cost_usd) OVER (ORDER BY turn, feeder_id, site_id ROWS UNBOUNDED PRECEDING) AS spent FROM (
  SELECT *, row_number() OVER (PARTITION BY feeder_id ORDER BY md5(site_id || ':0'), site_id) AS turn FROM cand)) WHERE spent <= {budget!r}::DOUBLE"""


cte("expl", explore(BUD["field_usd"] * BUD["exploration_reserve_frac"]))
_CELL = "(CAST(floor(x / 1000.0) AS BIGINT) * 4294967296 + CAST(floor(y / 1000.0) AS BIGINT))"
_MORTON = " | ".join(
    f"((((CAST(floor({c}) AS BIGINT) + 1073741824) >> {b}) & 1) << {2 * b + odd})" for c, odd in (("x", 0), ("y", 1)) for b in range(31)
)


def orders(rows: str) -> str:
    cap, crews = BUD["visits_per_crew_day"], BUD["num_crews"]
    return f"""SELECT *, (visit_seq // {cap}) % {crews} AS crew, visit_seq // {cap * crews} AS day FROM (
  SELECT *, row_number() OVER (ORDER BY cluster_benefit DESC, cluster, route_key, site_id) - 1 AS visit_seq FROM (
  SELECT *, {r('sum(benefit_usd) OVER (PARTITION BY cluster)', 2)} AS cluster_benefit FROM (SELECT *, {_CELL} AS cluster, ({_MORTON}) AS route_key FROM {rows})))"""


cte("plan", orders("sel"))
cte("rreason", """SELECT r.*, transformer_site_id AS site_id, coalesce(reason_1, '') AS reason_1, coalesce(reason_2, '') AS reason_2, coalesce(reason_3, '') AS reason_3 FROM risk r JOIN cust USING (customer_unit_id) LEFT JOIN reason USING (customer_unit_id)""")
cte("why", """SELECT site_id, reason_1, reason_2, reason_3, concat_ws(' | ', nullif(reason_1, ''), nullif(reason_2, ''), nullif(reason_3, '')) AS checklist FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY risk_score DESC, customer_unit_id DESC) AS rn FROM rreason) WHERE rn = 1""")
cte("ranked", "SELECT r.*, is_theft, row_number() OVER (ORDER BY risk_score DESC, customer_unit_id) AS pos FROM risk r JOIN theft USING (customer_unit_id)")

# --- oracles: sources, ingestion ------------------------------------------------

oracle("src_entity", f"SELECT feeder_id, year_month, {r('kwh', 1)} AS kwh FROM head WHERE feeder_id = 'F03'")
oracle("src_sql", f"SELECT feeder_id, count(*) AS n_months, {r('sum(kwh)', 1)} AS kwh FROM head GROUP BY 1")
oracle("src_list_feeders", "SELECT DISTINCT feeder_id FROM head")
oracle("src_csv_layers", "SELECT feeder_id, units, sites FROM (SELECT feeder_id, count(*) AS units FROM unit GROUP BY 1) JOIN (SELECT feeder_id, count(*) AS sites FROM site GROUP BY 1) USING (feeder_id)")
cte("bill", f"""SELECT ck, CASE WHEN ck % 53 = 0 THEN 'CX' || ck ELSE 'CC' || ck END AS cta, CASE WHEN ck % 97 = 0 THEN 'sin fecha' ELSE {YM} || '-01' END AS periodo,
  CASE WHEN ck % 89 = 0 THEN 0.0 ELSE kwh END AS kwh, CASE WHEN ck % 97 = 0 THEN 'sin fecha' ELSE {YM} END AS year_month FROM readings""")
_BRONZE = {"transformer_units": "unit", "sites": "site", "load_points": "(SELECT *, split_part(site_id, '-', 1) AS feeder_id FROM vlp)", "customers": "vmeter", "poles": "pole", "streetlights": "lamp", "switching_devices": "device", "segments": "seg"}
oracle("ingest_layers", " UNION ALL ".join(f'SELECT \'{n}\' AS entity, count(*) AS "rows", count(DISTINCT feeder_id) AS feeders FROM {t}' for n, t in _BRONZE.items()))
oracle("src_tabular", "SELECT periodo AS period, count(*) AS records, count(DISTINCT cta) AS accounts FROM bill GROUP BY 1")
oracle("sink_partition", f"SELECT feeder_id, count(*) AS n_months, {r('sum(kwh) * (CASE WHEN f % 2 = 0 THEN 2 ELSE 1 END)', 1)} AS kwh FROM head GROUP BY feeder_id, f")
oracle("sink_csv_export", f"SELECT feeder_id, count(*) AS n, {r('sum(installed_load_kw)', 2)} AS installed_load_kw FROM cust WHERE feeder_id IN ('F01', 'F02', 'F03') GROUP BY 1")
oracle("sink_result_layers", "SELECT site_id, loadability, loadability_class, x, y, printf('POINT(%.1f %.1f)', x, y) AS wkt FROM ldt JOIN pole USING (pole_id)")
oracle("geo_points", "SELECT customer_unit_id, pole_id, x, y, printf('POINT(%.1f %.1f)', x, y) AS wkt FROM cust JOIN pole USING (pole_id)")
cte("ncoord", """SELECT node_id AS node, x, y FROM site JOIN pole USING (pole_id) UNION ALL SELECT node_id || '_S', x, y FROM site JOIN pole USING (pole_id)
  UNION ALL SELECT customer_unit_id, x, y FROM cust JOIN pole USING (pole_id) UNION ALL SELECT feeder_id || '-SRC', avg(x), avg(y) FROM pole GROUP BY feeder_id""")
oracle("geo_lines", """SELECT segment_id, printf('LINESTRING(%.1f %.1f,%.1f %.1f)', round(a.x::DECIMAL(38,9), 1)::DOUBLE, round(a.y::DECIMAL(38,9), 1)::DOUBLE, round(b.x::DECIMAL(38,9), 1)::DOUBLE, round(b.y::DECIMAL(38,9), 1)::DOUBLE) AS wkt
  FROM seg JOIN ncoord a ON a.node = node_from JOIN ncoord b ON b.node = node_to""")
oracle("map_fields", "SELECT pole_id, feeder_id, 'POSTE HC' AS pole_type, x, y FROM pole")
oracle("map_union_layers", f"SELECT feeder_id, CASE section WHEN 'primary' THEN 'TramoDistribucionAereo' ELSE 'TramoBajaTensionAereo' END AS source_layer, count(*) AS n, {r('sum(length_m)', 1)} AS length_m FROM seg GROUP BY 1, 2")
_RAWPH = f"CASE WHEN ck % 5 = 0 THEN NULL WHEN ck % 7 = 0 THEN ' a' ELSE {nth(('1', '2', '4', '6', '9'), 'ck % 5')} END"
cte("vmeter", f"""SELECT ck, 'G' || ck AS global_id, feeder_id, feeder_id || '-LP' || lp AS site_id, {_RAWPH} AS phase_raw,
  CASE {_RAWPH} WHEN ' a' THEN 'A' WHEN '1' THEN 'C' WHEN '2' THEN 'B' WHEN '4' THEN 'A' WHEN '6' THEN 'AB' END AS phase,
  CASE WHEN ck % 41 = 0 OR ck % 37 = 0 THEN 'G' || ck ELSE 'C' || ck END AS customer_unit_id, c_mktsegment, c_acctbal FROM meter""")
oracle("decode_phase", "SELECT global_id, phase_raw, phase FROM vmeter")
_TEXT = {"Monofasico": "single", "Estrella Cerrada": "wye_closed", "DELTA": "delta_closed", "Delta-Abierta": "open_delta", "Y abierta / Delta abierta": "open_wye_open_delta", "delta 4 hilos": "delta_4wire"}
oracle("decode_bank_config", f"""SELECT site_id, coalesce({case(nth(BANK_TEXT, 'b'), _TEXT)}, CASE nu WHEN 1 THEN 'single' WHEN 2 THEN 'open_delta' WHEN 3 THEN 'wye_closed' ELSE 'independent' END) AS bank_config FROM unit0""")
_TAR = {"RESIDENCIAL-A": "residential", "Residencial temporal": "residential", "Comercial / Otros B": "commercial", "Otros": "commercial", "INDUSTRIAL ARTESANAL": "industrial"}
cte("vattr", f"""SELECT 'C' || ck AS customer_unit_id, 'CC' || ck AS cuenta_contrato, CASE WHEN ck % 29 = 0 THEN 'residential' ELSE {case(case('c_mktsegment', TARIFF_TEXT), _TAR)} END AS tariff_class,
  1.0 + abs(c_acctbal) / 1000.0 AS installed_load_kw FROM meter WHERE ck % 11 <> 0""")
oracle("decode_tariff", "SELECT customer_unit_id, tariff_class FROM vattr")
oracle("parse_kva", "SELECT unit_id, replace(printf('%.1f kVA', sn_kva), '.', ',') AS \"POTENCIANOMINAL\", sn_kva FROM unit")


def hexv(column: str) -> str:
    return f"(instr('0123456789abcdef', substring(md5({column}), 1, 1)) - 1)"


oracle("catalog_losses", f"""SELECT feeder_id, CASE WHEN h % 3 = 0 THEN 'plate' ELSE 'catalog' END AS plate_source, count(*) AS n,
  {r(f'sum(CASE WHEN h % 3 = 0 OR h % 5 = 0 THEN 0.05::DOUBLE ELSE {_P0F} END)', 4)} AS p0_kw, {r(f'sum(CASE WHEN h % 3 = 0 THEN 0.25::DOUBLE ELSE {_PKF} END)', 4)} AS pk_kw
  FROM (SELECT feeder_id, {hexv('unit_id')} AS h, sn_kva + CASE WHEN {hexv('unit_id')} % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sn_kva FROM unit) GROUP BY 1, 2""")
oracle("cust_id_fallback", "SELECT global_id, customer_unit_id FROM vmeter")
cte("vlp", f"""SELECT DISTINCT feeder_id || '-LP' || lp AS site_id, feeder_id || '-S' || si AS transformer_site_id, 'PO' || (nk * 25 + f) AS pole_id, {nth(('ABC', 'A', 'AB'), 'lp % 3')} AS lp_phase, lp FROM meter""")
oracle("cust_inherit", "SELECT customer_unit_id, site_id, transformer_site_id, pole_id, coalesce(phase, lp_phase) AS phase FROM vmeter JOIN vlp USING (site_id)")
oracle("cust_attributes", f"SELECT m.customer_unit_id, cuenta_contrato, coalesce(tariff_class, 'residential') AS tariff_class, {r('installed_load_kw', 4)} AS installed_load_kw FROM vmeter m LEFT JOIN vattr USING (customer_unit_id)")
oracle("trace_parent_site", "SELECT streetlight_id, site_id AS transformer_site_id FROM (SELECT 'L' || pk AS streetlight_id, CASE WHEN p_size <> 50 THEN feeder_id || '-N' || (k // 20 * 20 + 7) END AS pn FROM prt WHERE p_size % 10 = 0) LEFT JOIN site ON node_id = pn")
oracle("derive_section", "SELECT segment_id, section, phase FROM seg")
oracle("hierarchy_summary", f"""SELECT 'site -> unit' AS relation, (SELECT count(*) FROM site) AS parents, CAST(sum(n) AS BIGINT) AS children, max(n) AS children_per_parent_max, {r('avg(n)', 2)} AS children_per_parent_mean, count(*) FILTER (n > 1) AS parents_multi
  FROM (SELECT site_id, count(*) AS n FROM unit GROUP BY 1)
  UNION ALL SELECT 'load point -> meter', (SELECT count(*) FROM vlp), CAST(sum(n) AS BIGINT), max(n), {r('avg(n)', 2)}, count(*) FILTER (n > 1) FROM (SELECT site_id, count(*) AS n FROM cust GROUP BY 1)""")
# a meter is found by its account only when its attributes row is linked by the unique code
cte("acct", "SELECT cuenta_contrato AS cta, m.customer_unit_id, feeder_id FROM vmeter m JOIN vattr USING (customer_unit_id)")
cte("linked", "SELECT bill.*, acct.customer_unit_id, feeder_id FROM bill LEFT JOIN acct USING (cta)")
oracle("link_consumption", f"""SELECT records, matched, records - matched AS unmatched, {r('matched / records::DOUBLE', 4)} AS match_rate, customers_matched, {r('matched / records::DOUBLE', 4)} < 0.95 AS low_match
  FROM (SELECT count(*) AS records, count(customer_unit_id) AS matched, count(DISTINCT customer_unit_id) AS customers_matched FROM linked)""")
oracle("ingest_consumption", "SELECT customer_unit_id, feeder_id, year_month, kwh, false AS estimated FROM linked")
oracle("ingest_header", f"SELECT feeder_id, year_month, CASE WHEN year_month LIKE '%-10' THEN 0.0 ELSE {r(r('kwh', 2), 1)} END AS kwh FROM head")
oracle("norm_year_month", "SELECT periodo AS raw, year_month, count(*) AS n FROM bill GROUP BY 1, 2")
_TABLES = {"customers": "cust", "sites": "site", "transformer_units": "unit", "segments": "seg", "streetlights": "lamp", "switching_devices": "device", "poles": "pole", "header_meters": "head",
    "consumption": "cons", "theft_labels": "theft", "switching_events": "(SELECT *, ts AS timestamp, CAST(NULL AS VARCHAR) AS device_id FROM ev)"}
_ABSENT = {("sites", "kind")}
oracle("validate_required", " UNION ALL ".join(
    f"SELECT '{e}' AS entity, '{c}' AS \"column\", {'0' if (e, c) in _ABSENT else f'count(*) FILTER ({c} IS NULL)'} AS nulls, count(*) AS \"rows\" FROM {t}"
    for e, t in _TABLES.items() for c in REQUIRED[e].split()
))
oracle("validate_labels_enum", " UNION ALL ".join(
    f"SELECT '{e}' AS entity, '{c}' AS \"column\", count(*) FILTER (coalesce({c} NOT IN ({', '.join(repr(v) for v in allowed)}), true)) AS violations FROM {_TABLES[e]}"
    for (e, c), allowed in ENUMS.items()
))

# --- oracles: formulas --------------------------------------------------------

HT = repr(2190.0 * 28) + "::DOUBLE"
cte("fm", "SELECT e.customer_unit_id, kwh_total AS e, kvarh_total AS q, tariff_class, installed_load_kw AS inst, service_drop_kva AS drp, kwh_total / (2190.0::DOUBLE * 28) AS pm FROM energy e JOIN cust USING (customer_unit_id)")


def formula(name: str, **columns: str) -> None:
    oracle(name, "SELECT customer_unit_id, " + ", ".join(f"{r(sql, 6)} AS {n}" for n, sql in columns.items()) + " FROM fm")


_HYP = "sqrt(e * e + q * q)"
_PFE = f"(CASE WHEN {_HYP} = 0 THEN 1.0 ELSE e / {_HYP} END)"
_AMP = "(drp * 1000.0 / 220.0)"
formula("f_mean_power", p_mean_kw="pm")
formula("f_load_factor", load_factor="pm / inst")
formula("f_loss_factor", loss_factor="CASE WHEN pm / inst BETWEEN 0 AND 1 THEN 0.15 * pm / inst + 0.85 * pow(pm / inst, 2) END")
formula("f_velander", dmax_kw=velander("(e / 84.0)"))
formula("f_pf_energy", pf=_PFE)
formula("f_tanphi", tan_phi="CASE WHEN e <> 0 THEN q / e END")
formula("f_q_from_p", q_kvar=f"inst * tan(acos({_PFE}))")
formula("f_s_from_p_pf", s_kva=f"inst / {_PFE}")
formula("f_s_from_pq", s_kva="sqrt(inst * inst + drp * drp)")
formula("f_current_3ph", amps="drp * 1000.0 / (sqrt(3.0::DOUBLE) * 13800.0)")
formula("f_current_1ph_2w", amps=_AMP)
formula("f_current_1ph_3w", amps="drp * 1000.0 / 240.0")
formula("f_neutral_current", neutral_a="sqrt(pow(inst + drp * cos(radians(-115.0)) + 3.0 * cos(radians(115.0)), 2) + pow(drp * sin(radians(-115.0)) + 3.0 * sin(radians(115.0)), 2))")
formula("f_loss_3ph_bal", loss_kw=f"3.0 * {_AMP} * {_AMP} * 0.276::DOUBLE * 0.4::DOUBLE / 1000.0")
formula("f_loss_3ph_unbal", loss_kw=f"(({_AMP} * {_AMP} + inst * inst + 9.0) * 0.276::DOUBLE + 4.0 * 0.3::DOUBLE) * 0.4::DOUBLE / 1000.0")
formula("f_loss_1ph_2w", loss_kw=f"2.0 * {_AMP} * {_AMP} * 0.83::DOUBLE * 0.05::DOUBLE / 1000.0")
formula("f_loss_1ph_3w", loss_kw=f"(({_AMP} * {_AMP} + inst * inst) * 0.83::DOUBLE + 4.0 * 0.9::DOUBLE) * 0.05::DOUBLE / 1000.0")
formula("f_energy_loss", loss_kwh="inst * 0.2875::DOUBLE * 2190.0")
formula("f_tx_power_loss", loss_kw="0.145::DOUBLE + 0.55::DOUBLE * pow(drp / 50.0, 2)")
formula("f_tx_energy_loss", loss_kwh="0.145::DOUBLE * 2190.0 + 0.55::DOUBLE * pow(drp / 50.0, 2) * 0.2875::DOUBLE * 2190.0")
_DROP = f"{_AMP} * 0.4::DOUBLE * (0.276::DOUBLE * 0.92::DOUBLE + 0.375::DOUBLE * sqrt(1.0::DOUBLE - 0.92::DOUBLE * 0.92::DOUBLE))"
formula("f_voltage_drop", drop_3ph_v=f"sqrt(3.0::DOUBLE) * {_DROP}", drop_1ph_v=f"2.0 * {_DROP}")
oracle("f_coincidence", f"SELECT transformer_site_id AS site_id, count(*) AS n, {r('0.2 + 0.8 / sqrt(count(*))', 6)} AS coincidence FROM cust GROUP BY 1")
oracle("f_diversified", f"SELECT transformer_site_id AS site_id, {r('(0.2 + 0.8 / sqrt(count(*))) * sum(dmax_kw)', 4)} AS diversified_kw FROM demand GROUP BY 1")
oracle("f_aggregate_pqs", f"SELECT feeder_id, {r('p', 4)} AS p_kw, {r('q', 4)} AS q_kvar, {r('sqrt(p * p + q * q)', 4)} AS s_kva FROM (SELECT feeder_id, sum(kwh) / {HT} AS p, sum(kvarh) / {HT} AS q FROM cons GROUP BY 1)")
oracle("f_r_at_temp", f"SELECT segment_id, {r('''r_ohm_per_km * (1.0::DOUBLE + CASE WHEN material = 'cu' THEN 0.00393::DOUBLE ELSE 0.00403::DOUBLE END * 30.0)''', 6)} AS r_hot_ohm_per_km FROM seg")
oracle("f_night_hours", f"""SELECT latitude, month, {r('avg(24.0 - degrees(acos(greatest(-1.0, least(1.0, ch)))) * (2.0 / 15.0))', 3)} AS hours_on FROM (
  SELECT latitude, CAST(month(d) AS INTEGER) AS month, (sin(radians(-0.833)) - sin(radians(latitude)) * sin(dc)) / (cos(radians(latitude)) * cos(dc)) AS ch FROM (
  SELECT latitude, d, asin(sin(radians(-23.44)) * cos(radians((dayofyear(d) + 9.0) * (360.0::DOUBLE / 365.24)) + radians(1.914) * sin(radians((dayofyear(d) - 3) * (360.0::DOUBLE / 365.24))))) AS dc
  FROM (SELECT DISTINCT CAST(floor(y / 500) * 6 - 30 AS DOUBLE) AS latitude FROM pole) CROSS JOIN (SELECT unnest(range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY)) AS d))) GROUP BY 1, 2""")

# --- oracles: banks, balance --------------------------------------------------

oracle("bank_capacity", f"SELECT site_id, {r('capacity_kva', 4)} AS capacity_kva, {r('headroom_kva', 4)} AS headroom_kva FROM bk")
oracle("bank_no_load", f"SELECT site_id, {r('sum(p0_kw)', 4)} AS p0_total_kw FROM unit GROUP BY 1")
oracle("bank_load_losses", f"""SELECT site_id, {r('sum(pk_kw * pow(kwh / ' + HT + ' / 0.92 / n / sn_kva, 2))', 6)} AS load_loss_kw FROM unit JOIN (SELECT site_id, count(*) AS n FROM unit GROUP BY 1) USING (site_id)
  JOIN (SELECT transformer_site_id AS site_id, sum(kwh_total) AS kwh FROM demand GROUP BY 1) USING (site_id) GROUP BY 1""")
oracle("bank_evaluate", f"SELECT feeder_id, site_id, bank_config, {r('capacity_kva', 4)} AS capacity_kva, {r('headroom_kva', 4)} AS single_phase_headroom_kva, {r('p0_sum', 4)} AS p0_total_kw, n_units FROM bk")
oracle("bank_validate", "SELECT site_id, bank_config, n_units, bank_quality_flags FROM bk WHERE bank_quality_flags <> ''")
for _n in ("P03", "P04"):
    oracle(_n, f"SELECT site_id, bank_config, n_units FROM bk WHERE contains(bank_quality_flags, '{_n}')")
oracle("tx_site_loss", f"SELECT site_id, {r('loss_kwh', 1)} AS loss_kwh FROM load")
oracle("secondary_loss", f"SELECT feeder_id, {r(f'(billed + ap) * {_SEC!r}::DOUBLE * {FP!r}::DOUBLE', 1)} AS loss_kwh FROM bin")
oracle("loadability_class", "SELECT site_id, loadability, loadability_class FROM ldt")
oracle("load_point_agg", "SELECT * FROM lpt")
oracle("load_point_findings", """SELECT feeder_id, load_point_id, 'acometida_sobrecargada' AS finding, 'alta' AS severity, printf('utilización %.2f > 1.0', round(drop_utilization::DECIMAL(38,9), 2)::DOUBLE) AS evidence FROM lpt WHERE drop_utilization > 1.0
  UNION ALL SELECT feeder_id, load_point_id, 'acometida_subutilizada', 'media', printf('utilización %.2f < 0.1', round(drop_utilization::DECIMAL(38,9), 2)::DOUBLE) FROM lpt WHERE drop_utilization < 0.1
  UNION ALL SELECT feeder_id, load_point_id, 'dispersion_intra_punto', 'alta', printf('una conexión consume %.0f%% de la mediana del punto (%d medidores)', round((min_to_median_ratio * 100)::DECIMAL(38,9), 0)::DOUBLE, n_connections) FROM lpt WHERE n_connections >= 2 AND min_to_median_ratio < 0.4""")
oracle("site_smax", f"SELECT site_id, {r('s_max_lp', 3)} AS s_max_kva FROM smax")
oracle("ap_energy", f"SELECT feeder_id, site_id, n_lights, {r('ap_kwh', 2)} AS ap_kwh FROM apx")
_ANOM = """SELECT feeder_id, streetlight_id, 'tech_mismatch' AS anomaly, 'alta' AS severity, 'declarada ' || technology || ' != instalada ' || installed_technology AS evidence FROM lamp WHERE technology <> installed_technology
  UNION ALL SELECT feeder_id, streetlight_id, 'day_burning', 'media', 'fotocelda averiada: consumo 24 h' FROM lamp WHERE photocell_fault
  UNION ALL SELECT feeder_id, streetlight_id, 'no_transformer_site', 'media', 'sin puesto de transformación por traza (R25)' FROM lamp WHERE transformer_site_id IS NULL"""
cte("anom", _ANOM)
oracle("ap_anomalies", "SELECT * FROM anom")
oracle("loadability_table", "SELECT * FROM ldt")
oracle("feeder_balance", "SELECT * FROM bal")
oracle("balance_checks", "SELECT feeder_id, balance_coherent, failed_checks, pnt_negative_alert FROM bal")
oracle("risk_proxy", "SELECT feeder_id, customer_unit_id, risk_score, flagged_drop FROM risk")
oracle("ens", f"SELECT feeder_id, {r('ens_kwh', 3)} AS ens_kwh FROM ensx")
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
oracle("topology_versions", f"""SELECT feeder_id, printf('TV%03d', pos) AS topology_version_id, stamp AS valid_from, coalesce(lead(stamp) OVER (PARTITION BY feeder_id ORDER BY pos), '{PERIOD[1]}') AS valid_to, CAST(CASE WHEN pos > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_events FROM (
  SELECT feeder_id, row_number() OVER (PARTITION BY feeder_id ORDER BY ts, event_id) AS pos, {_TS} AS stamp FROM ev UNION ALL SELECT DISTINCT feeder_id, 0, '{PERIOD[0]}' FROM ev)""")
cte("hprof", """SELECT feeder_id, count(*) AS n, avg(kwh) AS mean_month, avg(kwh) FILTER (t >= half) / avg(kwh) FILTER (t < half) AS rt, (avg(kwh) FILTER (t >= half) - avg(kwh) FILTER (t < half)) / (abs(avg(kwh) FILTER (t < half)) + 1e-9) AS shift
  FROM htr CROSS JOIN (SELECT count(*) // 2 AS half FROM quarters) GROUP BY 1""")
cte("hdiff", "SELECT * FROM (SELECT feeder_id, t, year_month, kwh - lag(kwh) OVER (PARTITION BY feeder_id ORDER BY t) AS d FROM htr) WHERE d IS NOT NULL")
cte("tpair", f"""SELECT feeder_a, feeder_b, {r('least(1.0, abs(c) * (abs(sa) + abs(sb)))', 3)} AS confidence, month, {r('sa * 100.0', 2)} AS shift_a_pct, {r('sb * 100.0', 2)} AS shift_b_pct FROM (
  SELECT a.feeder_id AS feeder_a, b.feeder_id AS feeder_b, corr(a.d, b.d) AS c, any_value(pa.shift) AS sa, any_value(pb.shift) AS sb, arg_max(a.year_month, {{'g': round(abs(a.d - b.d), 6), 'o': -a.t}}) AS month
  FROM hdiff a JOIN hdiff b ON a.t = b.t AND a.feeder_id < b.feeder_id JOIN hprof pa ON pa.feeder_id = a.feeder_id JOIN hprof pb ON pb.feeder_id = b.feeder_id
  WHERE pa.shift * pb.shift < 0 AND greatest(abs(pa.shift), abs(pb.shift)) >= {TH['transfer_min_shift']} GROUP BY 1, 2) WHERE c <= {TH['transfer_corr']}""")
oracle("infer_transfers", "SELECT * FROM tpair")
cte("tpe", """SELECT t.*, least(abs(shift_a_pct), abs(shift_b_pct)) / 100.0 * (a.mean_month + b.mean_month) * 0.5 * (a.n // 2) AS e FROM tpair t JOIN hprof a ON a.feeder_id = feeder_a JOIN hprof b ON b.feeder_id = feeder_b""")
cte("credit", f"""SELECT feeder_id, {r('sum(kwh)', 1)} AS transferred_kwh FROM (SELECT feeder_a AS feeder_id, CASE WHEN shift_a_pct > 0 THEN -e ELSE e END AS kwh FROM tpe
  UNION ALL SELECT feeder_b, CASE WHEN shift_b_pct > 0 THEN -e ELSE e END FROM tpe) GROUP BY 1""")
oracle("quantify_transfers", "SELECT * FROM credit")
cte("binc", "SELECT bin.* REPLACE (coalesce(transferred_kwh, 0.0) AS transferred) FROM bin LEFT JOIN credit USING (feeder_id)")
oracle("apply_transfer_credits", close_balance("binc"))
_IMB = {p: f"sum(CASE WHEN phase = '{p}' THEN kwh_total ELSE 0 END) / (any_value(n_periods) * {HP!r}::DOUBLE) * 1000.0 / 220.0" for p in "ABC"}
oracle("imbalance", f"""SELECT feeder_id, site_id, {r('i_a', 2)} AS i_a, {r('i_b', 2)} AS i_b, {r('i_c', 2)} AS i_c, {r('i_n', 2)} AS i_neutral, {r('pct', 1)} AS imbalance_pct, pct > {TH['imbalance_warn_pct']} AS flagged,
  {r('loss', 1)} AS neutral_loss_kwh, {r('loss', 1)} AS rebalance_benefit_kwh FROM (SELECT *, i_n * i_n * {EL['neutral_r_ohm']}::DOUBLE * {FP!r}::DOUBLE * h / 1000.0 AS loss FROM (
  SELECT *, greatest(abs(i_a - m), abs(i_b - m), abs(i_c - m)) / m * 100.0 AS pct, sqrt(greatest(0.0, i_a * i_a + i_b * i_b + i_c * i_c - i_a * i_b - i_b * i_c - i_c * i_a)) AS i_n FROM (
  SELECT *, (i_a + i_b + i_c) / 3.0 AS m FROM (SELECT min(demand.feeder_id) AS feeder_id, transformer_site_id AS site_id, any_value(n_periods) * {HP!r}::DOUBLE AS h, {_IMB['A']} AS i_a, {_IMB['B']} AS i_b, {_IMB['C']} AS i_c
  FROM demand JOIN hp ON hp.feeder_id = demand.feeder_id GROUP BY transformer_site_id)) WHERE m > 0))""")
_TANN = repr(math.tan(math.acos(EL["naive_pf_default"])))
cte("pq", f"""SELECT *, s * 1000.0 / (sqrt(3.0::DOUBLE) * 13800.0) AS i, energy / 730.0 AS p_mean, p * {_TANN}::DOUBLE AS q_flat, s * 1000.0 / 13800.0 AS i_no_sqrt3 FROM (
  SELECT *, sqrt(p * p + q * q) AS s FROM (SELECT *, p * tan(acos(pf)) AS q FROM (SELECT *, ({_A} + {_B} / sqrt(n)) * peaks AS p FROM (
  SELECT feeder_id, count(*) AS n, sum({velander('e')}) AS peaks, sum({_PF}::DOUBLE * (e + 1e-9)) / sum(e + 1e-9) AS pf, sum(e) AS energy FROM (
  SELECT e.feeder_id, tariff_class, kwh_total / n_readings / 3.0::DOUBLE AS e FROM energy e JOIN cust USING (customer_unit_id)) GROUP BY 1))))""")


def dev(bad: str, good: str) -> str:
    return r(f"CASE WHEN {good} <> 0 THEN ({bad} - {good}) / {good} * 100.0 ELSE 0 END", 2)


cte("pqr", f"""SELECT feeder_id, n AS n_customers, {r('pf', 4)} AS pf_agg, {r('p', 2)} AS p_corr_kw, {r('q', 2)} AS q_corr_kvar, {r('s', 2)} AS s_corr_kva, {r('i', 2)} AS i_corr_a, {r('peaks', 2)} AS p_naive_sumpeaks_kw,
  {r('p_mean', 2)} AS p_naive_meandemand_kw, {r('q_flat', 2)} AS q_naive_cosphi_kvar, {r('i_no_sqrt3', 2)} AS i_naive_no_sqrt3_a, {dev('peaks', 'p')} AS dp_coincidence_pct, {dev('i_no_sqrt3', 'i')} AS di_sqrt3_pct FROM pq""")
oracle("pq_reconcile", "SELECT * FROM pqr")
_CAUSES = {
    "coincidencia (sumar picos)": ("kW", "p", "peaks"), "energia_vs_demanda (usar media)": ("kW", "p", "p_mean"),
    "cosphi_sobre_energia": ("kVAr", "q", "q_flat"), "factor_sqrt3 (omitido)": ("A", "i", "i_no_sqrt3"),
}
oracle("pq_causes", " UNION ALL ".join(
    f"SELECT feeder_id, '{n}' AS cause, '{u}' AS unit, {r(g, 2)} AS corrected, {r(b, 2)} AS current, {r(f'{b} - {g}', 2)} AS delta, {dev(b, g)} AS pct FROM pq" for n, (u, g, b) in _CAUSES.items()
))
oracle("pq_system", f"SELECT count(*) AS feeders, {r('avg(dp_coincidence_pct)', 2)} AS system_dp_coincidence_pct FROM pqr")
# draws of mean one: the logarithm has variance ln(1 + sigma^2) and mean minus half of it
_MC = CFG["montecarlo"]
_VAR = math.log(1.0 + _MC["sigma_technical"] ** 2)
_DRAWS = np.random.default_rng(_MC["seed"]).lognormal(-_VAR / 2, math.sqrt(_VAR), _MC["n_samples"])
_Q = {p: float(np.percentile(_DRAWS, p)) for p in (10, 50, 90)}
oracle("montecarlo", "SELECT feeder_id, " + ", ".join(
    [f"{r(f'energy_technical_kwh * {_Q[p]!r}::DOUBLE', 1)} AS technical_p{p}" for p in (10, 50, 90)]
    + [f"{r(f'losses_total_kwh - energy_technical_kwh * {_Q[100 - p]!r}::DOUBLE', 1)} AS pnt_p{p}" for p in (10, 50, 90)]
) + ", CAST(500 AS INTEGER) AS n_samples, 0.12::DOUBLE AS sigma_technical FROM bal")
oracle("reliability", "SELECT * FROM rel")


def status(stages: str, n: int) -> str:
    return f"""SELECT feeder_id, CAST(8 AS INTEGER) AS stages_total, CAST({n} AS INTEGER) AS stages_done, {100.0 / 8 * n}::DOUBLE AS progress_pct, '{stages}' AS stages_done_list, balance_coherent AND NOT pnt_negative_alert AS balance_closed,
  failed_checks, pnt_pct, technical_pct, n_customers, n_tx_sites FROM bal"""


cte("stat4", status("balance,electrical,ingest,topology", 4))
oracle("feeder_status", f"""SELECT s.* REPLACE (CAST(CASE WHEN hit THEN 6 ELSE 5 END AS INTEGER) AS stages_done, {r('CASE WHEN hit THEN 75.0 ELSE 62.5 END', 1)} AS progress_pct,
  CASE WHEN hit THEN 'balance,electrical,ingest,ml_risk,prioritization,topology' ELSE 'balance,electrical,ingest,ml_risk,topology' END AS stages_done_list) FROM stat4 s LEFT JOIN (SELECT DISTINCT feeder_id, true AS hit FROM cand WHERE ve_neto_usd > 0) USING (feeder_id)""")
oracle("feeder_report", """SELECT feeder_id, energy_header_kwh, energy_billed_kwh, energy_streetlight_kwh, energy_technical_kwh, technical_pct, pnt_kwh, pnt_pct, balance_coherent, failed_checks, n_nodes, n_edges, n_customers_downstream, CAST(0 AS BIGINT) AS topo_findings FROM bal
  JOIN (SELECT feeder_id, count(*) AS n_nodes FROM nodes GROUP BY 1) USING (feeder_id) JOIN (SELECT feeder_id, count(*) AS n_edges FROM edge GROUP BY 1) USING (feeder_id)
  JOIN (SELECT c.feeder_id, count(*) AS n_customers_downstream FROM closure c JOIN leaf l ON l.node = c.node WHERE anc = c.feeder_id || '-SRC' AND leaf = 'customer' GROUP BY 1) USING (feeder_id)""")
oracle("consolidated_report", f"""SELECT count(*) AS feeders, {r('sum(pnt_kwh) * 100.0 / sum(energy_header_kwh)', 2)} AS pnt_pct, {r('sum(energy_technical_kwh) * 100.0 / sum(energy_header_kwh)', 2)} AS technical_pct, count(*) FILTER (balance_coherent AND NOT pnt_negative_alert) AS balances_closed FROM bal""")
oracle("exec_report_sites", """SELECT feeder_id, CAST(rn AS INTEGER) AS rank, site_id, bank_config, capacity_kva, s_max_kva, loadability_class, n_overloaded FROM (SELECT *, row_number() OVER (PARTITION BY feeder_id ORDER BY loadability DESC NULLS LAST, site_id) AS rn,
  count(*) FILTER (loadability_class LIKE '%overloaded%') OVER (PARTITION BY feeder_id) AS n_overloaded FROM ldt) WHERE rn <= 10""")
oracle("exec_report_risk", "SELECT feeder_id, CAST(rn AS INTEGER) AS rank, customer_unit_id, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY feeder_id ORDER BY risk_score DESC, customer_unit_id) AS rn FROM risk) WHERE rn <= 10")
oracle("exec_report_split", " UNION ALL ".join(
    f"SELECT feeder_id, '{n}' AS part, {c} AS kwh FROM bal" for n, c in (("Facturada", "energy_billed_kwh"), ("Alumbrado", "energy_streetlight_kwh"), ("Técnicas", "energy_technical_kwh"), ("PNT", "pnt_kwh"))
))
oracle("exec_report_tables", """SELECT 'sites' AS "table", feeder_id, CAST(rn AS VARCHAR) AS line, site_id AS item, s_max_kva AS value FROM (SELECT *, row_number() OVER (PARTITION BY feeder_id ORDER BY loadability DESC NULLS LAST, site_id) AS rn FROM ldt) WHERE rn <= 10
  UNION ALL SELECT 'customers', feeder_id, CAST(rn AS VARCHAR), customer_unit_id, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY feeder_id ORDER BY risk_score DESC, customer_unit_id) AS rn FROM risk) WHERE rn <= 10
  UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'energy', feeder_id, '', '{n}', {c} FROM bal" for n, c in (("Facturada", "energy_billed_kwh"), ("Alumbrado", "energy_streetlight_kwh"), ("Técnicas", "energy_technical_kwh"), ("PNT", "pnt_kwh"))
))
oracle("inspection_sheet_tables", """SELECT p.site_id, p.feeder_id, roi, benefit_usd, visit_seq, day, CAST(rn AS INTEGER) AS rank, customer_unit_id, risk_score, coalesce(nullif(checklist, ''), 'Inspección visual de acometidas y medidores') AS checklist
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY risk_score DESC, customer_unit_id) AS rn FROM rreason) x JOIN plan p USING (site_id) LEFT JOIN why USING (site_id) WHERE rn <= 30""")
oracle("dashboard_aggs", f"""SELECT 'kpi' AS panel, 'feeders' AS item, '' AS detail, count(*)::DOUBLE AS value FROM bal UNION ALL SELECT 'kpi', 'progress_pct', '', 50.0
  UNION ALL SELECT 'kpi', 'balances_closed', '', (count(*) FILTER (balance_coherent AND NOT pnt_negative_alert))::DOUBLE FROM bal
  UNION ALL SELECT 'kpi', 'pnt_pct', '', {r('sum(pnt_kwh) * 100.0 / sum(energy_header_kwh)', 2)} FROM bal UNION ALL SELECT 'kpi', 'technical_pct', '', {r('sum(energy_technical_kwh) * 100.0 / sum(energy_header_kwh)', 2)} FROM bal
  UNION ALL SELECT 'loadability', coalesce(loadability_class, 'none'), '', count(*)::DOUBLE FROM ldt GROUP BY 2 UNION ALL SELECT 'quality', rule_id, severity, count(*)::DOUBLE FROM finding GROUP BY 2, 3
  UNION ALL SELECT 'lighting', anomaly, severity, count(*)::DOUBLE FROM anom GROUP BY 2, 3""")

# --- oracles: topology --------------------------------------------------------

oracle("edges", f"SELECT feeder_id, parent, node, segment_id, length_m, {r('r', 6)} AS r_ohm, {r('x', 6)} AS x_ohm, section FROM edge")
oracle("closure", f"SELECT feeder_id, node, anc, CAST(hops AS INTEGER) AS hops, {r('dist', 3)} AS distance_m, {r('r', 6)} AS r_ohm, {r('x', 6)} AS x_ohm FROM closure WHERE hops IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)")
oracle("trace_downstream", "SELECT c.feeder_id, anc AS start, c.node, CAST(hops AS INTEGER) AS hops FROM closure c JOIN device d ON d.feeder_id = c.feeder_id AND d.node_id = c.anc")
oracle("trace_upstream", "SELECT c.feeder_id, c.node AS start, anc AS node, CAST(hops AS INTEGER) AS hops FROM closure c JOIN site s ON s.feeder_id = c.feeder_id AND s.node_id = c.node")
oracle("path_to_source", f"""SELECT c.feeder_id, c.node AS start, string_agg(anc, '>' ORDER BY hops DESC) || '>' || c.node AS path, CAST(max(hops) AS BIGINT) AS hops, {r('max(dist)', 3)} AS distance_m, {r('max(r)', 6)} AS r_ohm, {r('max(x)', 6)} AS x_ohm,
  bool_or(anc = c.feeder_id || '-SRC') AS reaches_source FROM closure c JOIN site s ON s.feeder_id = c.feeder_id AND s.node_id || '_S' = c.node GROUP BY 1, 2""")
oracle("subtree_load", f"""SELECT n.feeder_id, n.node, count(l.node) FILTER (leaf = 'customer') AS n_customers, count(l.node) FILTER (leaf = 'streetlight') AS n_streetlights, {r('coalesce(sum(kw), 0)', 3)} AS load_kva, count(c.node) AS n_nodes
  FROM nodes n LEFT JOIN closure c ON c.feeder_id = n.feeder_id AND c.anc = n.node LEFT JOIN leaf l ON l.node = c.node LEFT JOIN nload w ON w.feeder_id = c.feeder_id AND w.node = c.node GROUP BY 1, 2""")
oracle("leaf_sets", "SELECT * FROM leaf")
oracle("accumulate_downstream", f"SELECT feeder_id, node, {r('kw', 4)} AS kw FROM accum")
oracle("branch_decomposition", "SELECT e.feeder_id, e.parent AS from_node, e.node AS to_node FROM edge e JOIN (SELECT feeder_id, parent, count(*) AS n FROM edge GROUP BY 1, 2) o USING (feeder_id, parent) WHERE n > 1 OR parent = feeder_id || '-SRC'")
cte("dseg", """SELECT feeder_id, segment_id, node_from, node_to FROM seg WHERE key IS NULL OR key % 101 <> 50
  UNION ALL SELECT feeder_id, 'T' || key, feeder_id || '-N' || (key // 75), node_to FROM seg WHERE key % 211 = 7 AND k >= 3
  UNION ALL SELECT feeder_id, 'Z' || key, node_to, feeder_id || '-N' || ((k - 1) // 2) FROM seg WHERE key % 311 = 100 AND k >= 1""")
cte("dends", "SELECT node_from AS node FROM dseg UNION SELECT node_to FROM dseg")
cte("dedge", """SELECT feeder_id, segment_id, node_from AS parent, node_to AS node FROM dseg UNION ALL SELECT feeder_id, site_id || '-TX', node_id, node_id || '_S' FROM site WHERE node_id IN (SELECT node FROM dends) AND node_id || '_S' IN (SELECT node FROM dends)""")
cte("dnode", "SELECT DISTINCT feeder_id, node FROM (SELECT feeder_id, node FROM dedge UNION ALL SELECT feeder_id, parent FROM dedge UNION ALL SELECT feeder_id, feeder_id || '-SRC' FROM dedge)")
cte("dreach", "SELECT DISTINCT feeder_id, feeder_id || '-SRC' AS node FROM dedge UNION SELECT e.feeder_id, e.node FROM dreach d JOIN dedge e ON e.feeder_id = d.feeder_id AND e.parent = d.node")
cte("dlost", "SELECT feeder_id, node FROM dnode EXCEPT SELECT feeder_id, node FROM dreach")
cte("dloop", "SELECT feeder_id, parent AS s, node FROM dedge WHERE parent NOT LIKE '%_S' UNION SELECT l.feeder_id, l.s, e.node FROM dloop l JOIN dedge e ON e.feeder_id = l.feeder_id AND e.parent = l.node WHERE e.parent NOT LIKE '%_S'")
cte("dmulti", "SELECT feeder_id, node FROM dedge GROUP BY 1, 2 HAVING count(*) > 1")


def topo(rows: str, name: str, severity: str, text: str) -> str:
    return f"SELECT feeder_id, '{name}' AS rule_id, '{severity}' AS severity, printf('{text}', count(*) OVER (PARTITION BY feeder_id)) AS evidence, node FROM {rows}"


oracle("topo_validate", "SELECT DISTINCT feeder_id, 'TOPO_CYCLE' AS rule_id, 'critica' AS severity, 'El grafo del alimentador contiene ciclos (no radial)' AS evidence, CAST(NULL AS VARCHAR) AS node FROM dloop WHERE s = node UNION ALL "
    + topo("dlost", "TOPO_ISLAND", "critica", "%d nodos no alcanzables desde la fuente") + " UNION ALL " + topo("dmulti", "TOPO_MULTIFEED", "alta", "%d nodos con más de un padre"))
oracle("topo_summary", """SELECT feeder_id, n_nodes, n_edges, n_zones, CAST(0 AS BIGINT) AS topo_findings, coalesce(nq, 0) AS n_quality_findings, coalesce(nc, 0) AS critical_findings FROM (SELECT feeder_id, count(*) AS n_nodes FROM nodes GROUP BY 1)
  JOIN (SELECT feeder_id, count(*) AS n_edges FROM edge GROUP BY 1) USING (feeder_id) JOIN (SELECT feeder_id, count(*) AS n_zones FROM bound GROUP BY 1) USING (feeder_id)
  LEFT JOIN (SELECT feeder_id, count(*) AS nq, count(*) FILTER (severity = 'critica') AS nc FROM finding GROUP BY 1) USING (feeder_id)""")
oracle("zones", "SELECT * FROM zone")
oracle("zones_by_guid", """SELECT d.feeder_id, d.node_id AS zone_id, device_id, coalesce(nc, 0) AS n_customers, coalesce(ns, 0) AS n_tx_sites, coalesce(nl, 0) AS n_streetlights, 'arcfm_trace' AS source FROM device d
  LEFT JOIN (SELECT feeder_id || '-N' || (nk // 16 * 16 + 5) AS g, count(*) AS nc FROM meter GROUP BY 1) c ON c.g = node_id LEFT JOIN (SELECT feeder_id || '-N' || (nk // 16 * 16 + 5) AS g, count(*) AS ns FROM site GROUP BY 1) s ON s.g = node_id
  LEFT JOIN (SELECT feeder_id || '-N' || (k // 16 * 16 + 5) AS g, count(*) AS nl FROM lamp GROUP BY 1) l ON l.g = node_id""")
oracle("node_load_map", f"SELECT feeder_id, node, {r('kw', 4)} AS kw FROM nload")

# --- oracles: quality, labels -------------------------------------------------

oracle("dq_engine", "SELECT * FROM finding")
for _n in ("R01", "R02", "R03", "R04", "R06", "R07", "R08", "R10", "R13", "R20", "R25"):
    oracle(_n, RULES[_n])
cte("accumk", "SELECT feeder_id, node, kw * 1000.0 AS kw FROM accum")
oracle("R09", amps_rule("accumk"))
oracle("R15", rule("R15", "cust WHERE ck % 17 = 0", "customer_unit_id", "'Cliente sin puesto de transformación por traza'"))
oracle("R22", rule("R22", "(SELECT feeder_id, site_id AS el FROM site WHERE node_id IN (SELECT node FROM dlost) OR node_id NOT IN (SELECT node FROM dnode) UNION ALL SELECT feeder_id, customer_unit_id AS el FROM cust WHERE customer_unit_id IN (SELECT node FROM dlost))", "el",
    "CASE WHEN el LIKE 'C%' THEN 'Cliente no alcanzable desde la fuente' ELSE 'Puesto no alcanzable desde la fuente' END"))
# nearest device or source above a device along tree edges (smallest segment id per node)
cte("dpar", "SELECT feeder_id, node, arg_min(parent, segment_id) AS parent FROM dedge GROUP BY 1, 2")
cte("dup", "SELECT d.feeder_id, device_id, p.parent AS up FROM device d JOIN dpar p ON p.feeder_id = d.feeder_id AND p.node = d.node_id UNION SELECT u.feeder_id, device_id, p.parent FROM dup u JOIN dpar p ON p.feeder_id = u.feeder_id AND p.node = u.up")
oracle("R23", rule("R23", "device WHERE device_id NOT IN (SELECT device_id FROM dup JOIN bound b ON b.node = dup.up)", "device_id", "'Zona de protección sin dispositivo aguas arriba'"))
oracle("series_pivot", f"SELECT customer_unit_id, t, year_month, {r('kwh', 2)} AS kwh, {r('kvarh', 2)} AS kvarh FROM cons")
for _n in ("M1", "M2", "M4", "M5", "M7", "M8"):
    oracle(_n, LABELS[_n])
oracle("M6", m6("(CASE WHEN CAST(substr(customer_unit_id, 2) AS BIGINT) % 13 = 0 AND t >= n / 2 THEN kvarh * 3.0 ELSE kvarh END)"))
oracle("mine_labels", "SELECT * FROM mined")
cte("mflag", "SELECT customer_unit_id, bool_or(label_source IN ('M1_drop_recovery', 'M2_jump_after_intervention')) AS high FROM mined GROUP BY 1")
oracle("validate_labels", f"""SELECT confirmed, {r('hh / confirmed::DOUBLE', 4)} AS recall_high_conf, {r('ha / confirmed::DOUBLE', 4)} AS recall_all, mined_total, {r('ha / greatest(mined_total, 1)::DOUBLE', 4)} AS precision_all_vs_confirmed FROM (
  SELECT count(*) FILTER (is_theft) AS confirmed, count(high) AS mined_total, count(*) FILTER (is_theft AND high) AS hh, count(*) FILTER (is_theft AND high IS NOT NULL) AS ha FROM theft LEFT JOIN mflag USING (customer_unit_id))""")
_fixed = " UNION ALL ".join(f"SELECT customer_unit_id FROM ({LABELS[n]})" for n in ("M2", "M4", "M5", "M6", "M7", "M8"))
cte("otherlabels", _fixed)
oracle("threshold_sweep", " UNION ALL ".join(
    f"""SELECT {d}::DOUBLE AS drop_recovery_pct, mined_total, {r('hits / c::DOUBLE', 4)} AS recall_all, {r('hits / mined_total::DOUBLE', 4)} AS precision_vs_conf FROM (SELECT count(*) AS mined_total, count(*) FILTER (is_theft) AS hits, (SELECT count(*) FROM theft WHERE is_theft) AS c
  FROM (SELECT customer_unit_id FROM otherlabels UNION SELECT customer_unit_id FROM {m1_rows(d)}) JOIN theft USING (customer_unit_id))""" for d in (0.25, 0.35, 0.45, 0.55)
))
oracle("peer_percentile", f"SELECT transformer_site_id, tariff_class, n, {r('p05', 4)} AS p05 FROM p05")

oracle("quantile", "SELECT site_id, count(*) AS n, " + ", ".join(f"{r(f'quantile_cont(mean_kwh, {p})', 4)} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + " FROM mean GROUP BY 1")

# --- oracles: features, risk --------------------------------------------------

oracle("feat_cutoff", f"SELECT customer_unit_id, {r('avg(kwh)', 4)} AS mean_12 FROM (SELECT *, row_number() OVER (PARTITION BY customer_unit_id ORDER BY year_month DESC) AS back FROM cons WHERE year_month <= '1999-12') WHERE back <= 12 GROUP BY 1")
oracle("feat_windows", "SELECT customer_unit_id, " + ", ".join(f"{r(f'{s}_{w}', 4)} AS {s}_{w}" for w in WINDOWS for s in ("mean", "std", "cv")) + " FROM own")
oracle("feat_theil_sen", f"SELECT customer_unit_id, {r('trend', 6)} AS trend FROM trend")
oracle("feat_yoy", f"SELECT customer_unit_id, {r('yoy_ratio', 6)} AS yoy_ratio FROM own")
oracle("feat_entropy", f"SELECT customer_unit_id, {r('entropy', 6)} AS entropy FROM entro")
oracle("feat_estimated", f"SELECT customer_unit_id, {r('estimated_frac', 6)} AS estimated_frac FROM own")
oracle("feat_zero", f"SELECT customer_unit_id, {r('zeros_frac', 6)} AS zeros_frac, coalesce(run, 0)::DOUBLE AS max_zero_run FROM own LEFT JOIN zrun USING (customer_unit_id)")
oracle("feat_kvarh", f"SELECT customer_unit_id, {r('kvarh_ratio_mean', 6)} AS kvarh_ratio_mean, {r('kvarh_ratio_std', 6)} AS kvarh_ratio_std FROM own")
oracle("feat_peer_z", f"SELECT customer_unit_id, {r('z_peer', 4)} AS z_peer FROM feat")
oracle("feat_load_ratio", f"SELECT customer_unit_id, {r('consumo_vs_instalada', 6)} AS consumo_vs_instalada FROM feat")
oracle("build_features", "SELECT customer_unit_id, feeder_id, " + ", ".join(f"{r(f'coalesce({n}, 0.0)', 4)} AS {n}" for n in FEATURES) + " FROM feat")
oracle("rank_norm", f"SELECT customer_unit_id, {r('percent_rank() OVER (PARTITION BY feeder_id ORDER BY risk_score)', 6)} AS rank FROM risk")
oracle("unsup_scores", f"SELECT customer_unit_id, {r('score_unsup', 6)} AS score_unsup FROM unsup")
oracle("risk_ensemble", f"SELECT customer_unit_id, {r('0.6 * pr + 0.4 * score_unsup', 6)} AS ensemble FROM unsup JOIN (SELECT customer_unit_id, percent_rank() OVER (PARTITION BY feeder_id ORDER BY risk_score) AS pr FROM risk) USING (customer_unit_id)")
cte("ens", f"SELECT customer_unit_id, least(floor({r('0.6 * pr + 0.4 * score_unsup', 6)} * 1000), 1000) AS b FROM unsup JOIN (SELECT customer_unit_id, percent_rank() OVER (PARTITION BY feeder_id ORDER BY risk_score) AS pr FROM risk) USING (customer_unit_id)")
# isotonic shares of the bins: max over starts of the min over ends of the mean between
cte("ebin", "SELECT *, sum(s) OVER (ORDER BY b) AS su, sum(n) OVER (ORDER BY b) AS nu FROM (SELECT b, sum(is_theft::INTEGER) AS s, count(*) AS n FROM ens JOIN theft USING (customer_unit_id) GROUP BY 1)")
cte("eiso", """SELECT k AS b, max(m) AS p FROM (SELECT i.b AS i, j.b AS k, min((j.su - i.su + i.s) / (j.nu - i.nu + i.n)::DOUBLE) OVER (PARTITION BY i.b ORDER BY j.b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m
  FROM ebin i JOIN ebin j ON i.b <= j.b) GROUP BY 1""")
oracle("calibrate", f"SELECT customer_unit_id, {r('p', 5)} AS risk_score FROM ens JOIN eiso USING (b)")
oracle("explain_top3", "SELECT * FROM reason")
oracle("precision_at_k", " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, {r('count(*) FILTER (is_theft) / count(*)::DOUBLE', 4)} AS precision_at_k FROM ranked WHERE pos <= {k}" for k in KS))
oracle("energy_at_k", " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, {r('sum(CASE WHEN is_theft THEN recoverable_kwh_month ELSE 0 END)', 1)} AS energy_at_k FROM ranked WHERE pos <= {k}" for k in KS))

# --- oracles: state, flow -----------------------------------------------------

oracle("site_monthly_stats", f"SELECT feeder_id, site_id, {r('mean_kw', 5)} AS mean_kw, {r('std_kw', 5)} AS std_kw FROM sstat")
oracle("pseudo_measurements", f"SELECT feeder_id, site_id, {r('z', 5)} AS z_kw, {r('sigma', 5)} AS sigma_kw FROM pseudo")
oracle("wls", f"""SELECT feeder_id, site_id, {r('estimate', 4)} AS estimate_kw, {r('correction', 4)} AS correction_kw, {r('nr', 4)} AS norm_residual, {r('chi2', 2)} AS chi2, gross_error,
  row_number() OVER (PARTITION BY feeder_id ORDER BY round(abs(nr), 9) DESC, site_id DESC) = 1 AS is_lnr FROM est""")
oracle("zone_reconcile", "SELECT * FROM zest")
oracle("pnt_independent", f"""SELECT feeder_id, pnt_kwh, {r('p', 1)} AS pnt_independent_kwh, {r('abs(p - pnt_kwh) / energy_header_kwh * 100.0', 4)} AS unexplained_pct FROM (
  SELECT bal.*, u * (n_months * {HP!r}::DOUBLE) - energy_streetlight_kwh - energy_ens_kwh AS p FROM bal JOIN (SELECT feeder_id, sum(greatest(correction, 0)) AS u FROM est GROUP BY 1) USING (feeder_id))""")

_V0 = EL["voltage"]["ll_mv"] / math.sqrt(3.0)
_TP = math.tan(math.acos(CFG["powerflow"]["pf"]))
cte("pbr", "SELECT feeder_id, node_to AS node, node_from AS parent, segment_id, r_ohm_per_km * (length_m / 1000.0) AS r, x_ohm_per_km * (length_m / 1000.0) AS x FROM seg WHERE section = 'primary'")
cte("pnode", f"""SELECT n.feeder_id, n.node, coalesce(kw, 0) * 50.0 AS p, coalesce(kw, 0) * 50.0 * {_TP!r}::DOUBLE AS q FROM (SELECT feeder_id, node FROM pbr UNION SELECT feeder_id, parent FROM pbr) n LEFT JOIN nload l ON l.feeder_id = n.feeder_id AND l.node = n.node""")
cte("pclo", """SELECT feeder_id, node, node AS anc FROM pnode UNION ALL SELECT c.feeder_id, c.node, b.parent FROM pclo c JOIN pbr b ON b.feeder_id = c.feeder_id AND b.node = c.anc""")
cte("v0", f"SELECT *, {_V0!r}::DOUBLE AS vr, 0.0::DOUBLE AS vi, NULL::DOUBLE AS dv FROM pnode")
_N = 5
for _i in range(1, _N + 1):
    cte(f"i{_i}", f"""SELECT c.feeder_id, c.anc AS node, sum((p * vr + q * vi) * {1000.0 / 3!r}::DOUBLE / (vr * vr + vi * vi)) AS ir, sum((p * vi - q * vr) * {1000.0 / 3!r}::DOUBLE / (vr * vr + vi * vi)) AS ii
  FROM v{_i - 1} v JOIN pclo c ON c.feeder_id = v.feeder_id AND c.node = v.node GROUP BY 1, 2""")
    cte(f"v{_i}", f"""SELECT v.feeder_id, v.node, v.p, v.q, {_V0!r}::DOUBLE - dr AS vr, -di AS vi, sqrt(pow({_V0!r}::DOUBLE - dr - v.vr, 2) + pow(-di - v.vi, 2)) AS dv FROM v{_i - 1} v JOIN (
  SELECT c.feeder_id, c.node, sum(coalesce(b.r * ir - b.x * ii, 0)) AS dr, sum(coalesce(b.r * ii + b.x * ir, 0)) AS di FROM pclo c JOIN i{_i} i ON i.feeder_id = c.feeder_id AND i.node = c.anc
  LEFT JOIN pbr b ON b.feeder_id = c.feeder_id AND b.node = c.anc GROUP BY 1, 2) d ON d.feeder_id = v.feeder_id AND d.node = v.node""")


def flow_result(n: int, cap: int) -> str:
    """Results after sweep ``n`` of a run that may take at most ``cap`` sweeps."""
    steps = " UNION ALL ".join(f"SELECT feeder_id, {i} AS turn, max(dv) < {1e-6 * _V0!r}::DOUBLE AS ok FROM v{i} GROUP BY 1" for i in range(1, n + 1))
    return f"""SELECT feeder_id, {r('loss', 3)} AS primary_loss_kw, {r('v_min', 4)} AS v_min_pu, {r('v_max', 4)} AS v_max_pu, it < {cap} AS converged, CAST(it AS INTEGER) AS iterations, n_branches, src, load, loss FROM (
  SELECT feeder_id, min(sqrt(vr * vr + vi * vi)) / {_V0!r}::DOUBLE AS v_min, max(sqrt(vr * vr + vi * vi)) / {_V0!r}::DOUBLE AS v_max, sum(p) AS load FROM v{n} GROUP BY 1) JOIN (
  SELECT b.feeder_id, sum((ir * ir + ii * ii) * r * 3.0 / 1000.0) AS loss, count(*) AS n_branches, sum(CASE WHEN parent = b.feeder_id || '-SRC' THEN ir ELSE 0 END) * {3.0 * _V0 / 1000.0!r}::DOUBLE AS src FROM pbr b JOIN i{n} i ON i.feeder_id = b.feeder_id AND i.node = b.node GROUP BY 1) USING (feeder_id) JOIN (
  SELECT feeder_id, coalesce(min(turn) FILTER (ok), {cap}) AS it FROM ({steps}) GROUP BY 1) USING (feeder_id)"""


cte("flowres", flow_result(_N, 100))
cte("flowa", flow_result(SWEEP_CHECK[0], SWEEP_CHECK[0]))
cte("flowb", flow_result(SWEEP_CHECK[1], SWEEP_CHECK[1]))
oracle("pf_network", f"SELECT n.feeder_id, n.node, parent, segment_id, {r('p', 4)} AS p_kw, {r('q', 4)} AS q_kvar, {r('r', 6)} AS r_ohm, {r('x', 6)} AS x_ohm FROM pnode n LEFT JOIN pbr b ON b.feeder_id = n.feeder_id AND b.node = n.node")
oracle("pf_sweep", "SELECT feeder_id, primary_loss_kw, v_min_pu, v_max_pu, converged, iterations, n_branches FROM flowres")
oracle("pf_conservation", f"SELECT feeder_id, {r('src', 3)} AS source_kw, {r('load', 3)} AS load_kw, {r('loss', 3)} AS loss_kw, abs(src - load - loss) / greatest(load, 1e-9) < 1e-4 AS conserved FROM flowres")
oracle("pf_tolerance_check", f"""SELECT feeder_id, a.primary_loss_kw, b.primary_loss_kw AS other_loss_kw, {r('abs(a.primary_loss_kw - b.primary_loss_kw) * 100.0 / greatest(abs(b.primary_loss_kw), 1e-6)', 3)} AS loss_diff_pct,
  abs(a.primary_loss_kw - b.primary_loss_kw) * 100.0 / greatest(abs(b.primary_loss_kw), 1e-6) <= 2.0 AS within_loss_tol, {r('abs(a.v_min_pu - b.v_min_pu) * 100.0', 3)} AS voltage_diff_pct, abs(a.v_min_pu - b.v_min_pu) * 100.0 <= 0.5 AS within_voltage_tol FROM flowa a JOIN flowb b USING (feeder_id)""")
_ZS, _ZM = f"(z * {Z0_RATIO} + z * 2.0) / 3.0", f"(z * {Z0_RATIO} - z) / 3.0"
oracle("pf_zmatrix", f"""SELECT feeder_id, segment_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r(f'CASE WHEN i = j THEN (r * {Z0_RATIO} + r * 2.0) / 3.0 ELSE (r * {Z0_RATIO} - r) / 3.0 END', 6)} AS r_ohm,
  {r(f'CASE WHEN i = j THEN (x * {Z0_RATIO} + x * 2.0) / 3.0 ELSE (x * {Z0_RATIO} - x) / 3.0 END', 6)} AS x_ohm FROM pbr CROSS JOIN (SELECT unnest(range(3)) AS i) CROSS JOIN (SELECT unnest(range(3)) AS j)""")

# --- oracles: campaign --------------------------------------------------------

_PICK = "site_id, feeder_id, cost_usd, benefit_usd, ve_neto_usd, roi"
oracle("candidates", "SELECT * FROM cand")
oracle("greedy_roi", f"SELECT {_PICK}, 'greedy_roi' AS selected_by FROM greedy WHERE spent <= {_DIRECTED!r} AND pos <= 30")
oracle("knapsack", f"SELECT {_PICK}, 'knapsack' AS selected_by FROM (SELECT *, {_run.format(p='', o='ve_neto_usd DESC, site_id')} AS spent FROM cand WHERE ve_neto_usd > 0) WHERE spent <= {_DIRECTED!r}")
cte("mixed", f"""SELECT * EXCLUDE (c2) REPLACE (c2 AS cost_usd, {r('benefit_usd - c2', 4)} AS ve_neto_usd, {r('benefit_usd / c2', 6)} AS roi) FROM (
  SELECT *, cost_usd * ((CAST(regexp_extract(site_id, '-S([0-9]+)$', 1) AS BIGINT) % 4) * 0.5::DOUBLE + 0.5::DOUBLE) AS c2 FROM cand)""")
cte("mixed_order", "SELECT *, row_number() OVER (ORDER BY roi DESC, site_id) AS i FROM mixed")
oracle("greedy_mixed_costs", f"""SELECT {_PICK}, 'greedy_roi' AS selected_by FROM mixed_order JOIN (
  WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS spent, false AS taken
    UNION ALL SELECT o.i, CASE WHEN g.spent + o.cost_usd <= {_DIRECTED!r} THEN g.spent + o.cost_usd ELSE g.spent END, g.spent + o.cost_usd <= {_DIRECTED!r}
    FROM g JOIN mixed_order AS o ON o.i = g.i + 1) SELECT i FROM g WHERE taken) USING (i)""")
oracle("knapsack_mixed_costs", f"""SELECT {r(f'sum(ve_neto_usd * least(1.0, greatest(0.0, ({_DIRECTED!r} - before) / cost_usd)))', 2)} AS bound_usd, true AS within_budget_and_bound FROM (
  SELECT *, coalesce(sum(cost_usd) OVER (ORDER BY ve_neto_usd / cost_usd DESC, site_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mixed WHERE ve_neto_usd > 0)""")
oracle("two_stage", f"SELECT {_PICK}, 'two_stage' AS selected_by FROM sel")
oracle("exploration_reserve", f"SELECT {_PICK}, 'exploration' AS selected_by FROM ({explore(BUD['field_usd'] * 5 * BUD['exploration_reserve_frac'])})")
oracle("allocation_curve", " UNION ALL ".join(
    f"SELECT {r(f'{b!r}::DOUBLE', 0)} AS budget_usd, count(*) AS n_sites, {r('coalesce(sum(benefit_usd), 0)', 0)} AS expected_benefit_usd, {r('coalesce(sum(recoverable_kwh_month), 0)', 0)} AS recoverable_kwh_month FROM greedy WHERE spent <= {b!r}::DOUBLE"
    # 20 budgets from 5 % to 150 %
    for b in [BUD["field_usd"] * (0.05 + 1.45 * i / 19) for i in range(20)]
))
oracle("geo_cluster", f"SELECT site_id, {_CELL} AS cluster FROM cand")
oracle("route", f"SELECT site_id, cluster, route_key, row_number() OVER (PARTITION BY cluster ORDER BY route_key, site_id) AS route_seq FROM (SELECT site_id, {_CELL} AS cluster, ({_MORTON}) AS route_key FROM cand)")
oracle("work_orders", f"SELECT site_id, cluster, cluster_benefit, visit_seq, crew, day FROM ({orders('cand')})")
oracle("reasons_by_site", "SELECT site_id, reason_1, reason_2, reason_3, checklist FROM why")
oracle("ranking_feeders", "SELECT feeder_id, pnt_pct, technical_pct, pnt_kwh, total_losses_pct FROM bal")
oracle("ranking_sites", "SELECT site_id, feeder_id, benefit_usd, roi FROM cand ORDER BY roi DESC, site_id LIMIT 500")
oracle("ranking_customer_units", "SELECT customer_unit_id, risk_score FROM risk ORDER BY risk_score DESC, customer_unit_id LIMIT 1000")
oracle("ranking_zones", "SELECT feeder_id, zone_id, unaccounted_load_kw FROM zest")
oracle("rankings", """SELECT 'feeders' AS ranking, feeder_id AS item, pnt_kwh AS value FROM bal UNION ALL SELECT 'sites', site_id, roi FROM (SELECT * FROM cand ORDER BY roi DESC, site_id LIMIT 500)
  UNION ALL SELECT 'customer_units', customer_unit_id, risk_score FROM (SELECT * FROM risk ORDER BY risk_score DESC, customer_unit_id LIMIT 1000) UNION ALL SELECT 'zones', feeder_id || '/' || zone_id, unaccounted_load_kw FROM zest""")
_KB = {cpv: int(BUD["field_usd"] / cpv) for cpv in BUD["cost_per_visit_grid"]}
oracle("campaign_summary", f"""SELECT {BUD['field_usd']!r}::DOUBLE AS budget_field_usd, {r(f'{_DIRECTED!r}::DOUBLE', 0)} AS directed_budget_usd, {r(repr(BUD['field_usd'] * BUD['exploration_reserve_frac']), 0)} AS exploration_budget_usd, n AS sites_selected,
  (SELECT count(*) FROM expl) AS exploration_sites, n AS visits_total, {r('ben', 0)} AS expected_benefit_usd, {r('kwh', 0)} AS expected_recoverable_kwh_month, {r('cost', 0)} AS cost_spent_usd, {r('ben / greatest(1.0, cost)', 2)} AS roi_campaign,
  {r(f'gain - (SELECT sum(greatest(ve_neto_usd, 0)) FROM greedy WHERE spent <= {_DIRECTED!r})', 0)} AS milp_vs_greedy_improvement_usd, CAST({BUD['num_crews']} AS INTEGER) AS crews, CAST({BUD['visits_per_crew_day']} AS INTEGER) AS visits_per_crew_day, """
    + ", ".join(f"(SELECT {r('count(*) FILTER (is_theft) / count(*)::DOUBLE', 4)} FROM ranked WHERE pos <= {k}) AS precision_at_cost_{c}" for c, k in _KB.items())
    + " FROM (SELECT count(*) AS n, sum(benefit_usd) AS ben, sum(recoverable_kwh_month) AS kwh, sum(cost_usd) AS cost, sum(greatest(ve_neto_usd, 0)) AS gain FROM sel)")
oracle("inspection_plan", "SELECT p.site_id, feeder_id, n_units, benefit_usd, roi, cluster, visit_seq, crew, day, checklist FROM plan p LEFT JOIN why USING (site_id)")
oracle("field_feedback", f"""SELECT CASE WHEN {hexv('site_id')} < 11 THEN 'directed' ELSE 'exploration' END AS source, count(*) AS n_inspections, count(*) FILTER (max_risk > 0.9) AS n_findings, {r('avg(CASE WHEN max_risk > 0.9 THEN 1.0 ELSE 0.0 END)', 4)} AS hit_rate,
  {r('sum(CASE WHEN max_risk > 0.9 THEN recoverable_kwh_month END)', 1)} AS recovered_kwh, {r('sum(cost_usd)', 2)} AS cost_usd FROM cand GROUP BY 1""")

# --- oracles: incremental, streaming --------------------------------------------

oracle("needs_recompute", "SELECT DISTINCT feeder_id FROM head WHERE f % 5 = 0")
oracle("mark_done", "SELECT count(DISTINCT feeder_id) AS feeders, CAST(0 AS BIGINT) AS still_open FROM head")
_GOLD = {"feeder_balance": "bal", "transformer_loadability": "ldt", "protection_zones": "zone", "data_quality_findings": "finding", "reliability_index": "rel", "credited_balance": "bal"}
oracle("run_screening", " UNION ALL ".join(
    f'SELECT \'{n}\' AS entity, count(*) AS "rows", count(DISTINCT feeder_id) AS feeders, (SELECT count(*) FROM bal) AS analysed, CAST(0 AS BIGINT) AS analysed_again FROM {t}' for n, t in _GOLD.items()
))
oracle("stream_bronze", f"SELECT feeder_id, year_month, count(*) AS records, {r('sum(kwh)', 1)} AS kwh FROM linked GROUP BY 1, 2")
oracle("stream_corrections", f"""SELECT feeder_id, year_month, count(*) AS records, {r("sum(CASE WHEN CAST(substr(cta, 3) AS BIGINT) % 7 = 0 THEN 1000.5 ELSE kwh END)", 1)} AS kwh
  FROM linked WHERE customer_unit_id IS NOT NULL AND year_month <> 'sin fecha' GROUP BY 1, 2""")
_ROW_HALF = "CAST('0x' || substr(md5(concat_ws(chr(31), {0})), 1, 16) AS UBIGINT)"
_CONS_ROW = _ROW_HALF.format("customer_unit_id, CASE WHEN estimated THEN 'true' ELSE 'false' END, feeder_id, printf('%.6f', kvarh), printf('%.6f', kwh), year_month")
_HEAD_ROW = _ROW_HALF.format("feeder_id, printf('%.6f', kvarh), printf('%.6f', kwh), year_month")
oracle("content_sums", f"""SELECT feeder_id, 'consumption' AS t, CAST(sum({_CONS_ROW}) % 18446744073709551616 AS VARCHAR) AS h, count(*) AS n FROM cons GROUP BY 1
  UNION ALL SELECT feeder_id, 'header_meters', CAST(sum({_HEAD_ROW}) % 18446744073709551616 AS VARCHAR), count(*) FROM head GROUP BY 1""")
oracle("stream_ens", f"""SELECT feeder_id, strftime(d, '%Y-%m-%d') AS day, {r('sum(duration_h * affected_kw)', 3)} AS ens_kwh, count(*) AS n_faults FROM (SELECT *, date_trunc('day', ts) AS d FROM ev WHERE motivo = 'falla') GROUP BY 1, 2""")


def _assemble(body: str) -> str:
    """The SELECT with the building blocks it needs, in definition order."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", frontier.pop()))
        for name in CTES.keys() & words - needed:
            needed.add(name)
            frontier.append(CTES[name])
    blocks = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    return f"WITH RECURSIVE {blocks}\n{body}" if blocks else body


ORACLES.update({name: _assemble(body) for name, body in _BODY.items()})
