"""Electrical relations as column expressions (no UDF, NULL where undefined)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger.functions.numeric import col, lookup
from wattledger.params import ELECTRICAL

SQRT3 = math.sqrt(3.0)


def _positive(den: Column, value: Column) -> Column:
    return F.when(den > 0, value)


def mean_power_kw(energy_kwh, hours) -> Column:
    e, h = col(energy_kwh), col(hours)
    return _positive(h, e / h)


def load_factor(p_mean_kw, p_max_kw) -> Column:
    mean, peak = col(p_mean_kw), col(p_max_kw)
    return _positive(peak, mean / peak)


def loss_factor(fc, k: float = ELECTRICAL["loss_factor_k"]) -> Column:
    fc = col(fc)
    return F.when(fc.between(0.0, 1.0), fc * k + fc * fc * (1.0 - k))


def velander_kw(energy_kwh, tariff_class, coefficients=None) -> Column:
    """a*E + b*sqrt(E); unknown classes use the residential coefficients."""
    table = coefficients or ELECTRICAL["velander"]
    e, cls = col(energy_kwh), col(tariff_class)
    base_a, base_b = table["residential"]
    a = lookup({c: ab[0] for c, ab in table.items()}, cls, base_a)
    b = lookup({c: ab[1] for c, ab in table.items()}, cls, base_b)
    return F.when(e >= 0, a * e + b * F.sqrt(e))


def class_pf(tariff_class, table=None) -> Column:
    table = table or ELECTRICAL["power_factor_by_class"]
    return lookup(table, col(tariff_class), table["residential"])


def coincidence(n, ab=ELECTRICAL["coincidence"]) -> Column:
    n = col(n)
    return F.when(n >= 1, F.lit(ab[0]) + F.lit(ab[1]) / F.sqrt(n))


def diversified_kw(peak_kw, ab=ELECTRICAL["coincidence"]) -> Column:
    """Aggregate: coincidence of the group times the sum of its peaks."""
    peak = col(peak_kw)
    return F.coalesce(coincidence(F.count(peak), ab) * F.sum(peak), F.lit(0.0))


def pf_from_energy(kwh, kvarh) -> Column:
    p, q = col(kwh), col(kvarh)
    s = F.hypot(p, q)
    return F.when(s == 0, F.lit(1.0)).otherwise(p / s)


def tan_phi(kwh, kvarh) -> Column:
    p, q = col(kwh), col(kvarh)
    return F.when(p != 0, q / p)


def tan_of_pf(pf) -> Column:
    return F.tan(F.acos(col(pf)))


def q_from_p(p_kw, pf) -> Column:
    pf = col(pf)
    return F.when((pf > 0) & (pf <= 1), col(p_kw) * tan_of_pf(pf))


def s_from_p(p_kw, pf) -> Column:
    pf = col(pf)
    return F.when((pf > 0) & (pf <= 1), col(p_kw) / pf)


def s_from_pq(p, q) -> Column:
    return F.hypot(col(p), col(q))


def current_3ph(s_kva, v_ll) -> Column:
    v = col(v_ll)
    return _positive(v, col(s_kva) * 1000.0 / (v * SQRT3))


def current_1ph(s_kva, v) -> Column:
    """Two-wire against line-neutral, three-wire against the 240 V pair."""
    v = col(v)
    return _positive(v, col(s_kva) * 1000.0 / v)


def r_at_temp(r_ref, material, underground=None) -> Column:
    t = ELECTRICAL["temperature"]
    alpha = F.when(col(material) == "cu", F.lit(t["alpha_cu"])).otherwise(F.lit(t["alpha_al"]))
    op = F.lit(t["op_c_overhead"])
    if underground is not None:
        op = F.when(col(underground), F.lit(t["op_c_underground"])).otherwise(op)
    return col(r_ref) * (F.lit(1.0) + alpha * (op - t["ref_c"]))


def neutral_current(ia, ib, ic, theta_a=0.0, theta_b=0.0, theta_c=0.0) -> Column:
    """Magnitude of the three-phasor sum; angles in degrees added to 0/-120/+120."""
    parts = ((ia, theta_a, 0.0), (ib, theta_b, -120.0), (ic, theta_c, 120.0))

    def angle(theta, base):
        theta = F.lit(theta) if isinstance(theta, (int, float)) else col(theta)
        return F.radians(theta + base)

    re = sum((col(i) * F.cos(angle(t, b)) for i, t, b in parts), F.lit(0.0))
    im = sum((col(i) * F.sin(angle(t, b)) for i, t, b in parts), F.lit(0.0))
    return F.hypot(re, im)


def conductor_loss_3ph(i, r_km, length_km) -> Column:
    return col(i) * col(i) * col(r_km) * col(length_km) * 3.0 / 1000.0


def conductor_loss_3ph_unbalanced(ia, ib, ic, i_n, r_km, rn_km, length_km) -> Column:
    phases = (col(ia) * col(ia) + col(ib) * col(ib) + col(ic) * col(ic)) * col(r_km)
    return (phases + col(i_n) * col(i_n) * col(rn_km)) * col(length_km) / 1000.0


def conductor_loss_1ph_2w(i, r_km, length_km) -> Column:
    return col(i) * col(i) * col(r_km) * col(length_km) * 2.0 / 1000.0


def conductor_loss_1ph_3w(i1, i2, i_n, r_km, rn_km, length_km) -> Column:
    lines = (col(i1) * col(i1) + col(i2) * col(i2)) * col(r_km)
    return (lines + col(i_n) * col(i_n) * col(rn_km)) * col(length_km) / 1000.0


def energy_loss_kwh(p_peak_kw, fp, hours) -> Column:
    return col(p_peak_kw) * col(fp) * col(hours)


def tx_power_loss_kw(p0_kw, pk_kw, s_kva, sn_kva) -> Column:
    sn = col(sn_kva)
    return _positive(sn, col(p0_kw) + col(pk_kw) * F.pow(col(s_kva) / sn, 2))


def tx_energy_loss_kwh(p0_kw, pk_kw, s_max_kva, sn_kva, fp, hours) -> Column:
    """No-load losses run all hours; only the load part carries the loss factor."""
    sn = col(sn_kva)
    load = col(pk_kw) * F.pow(col(s_max_kva) / sn, 2) * col(fp) * col(hours)
    return _positive(sn, col(p0_kw) * col(hours) + load)


def voltage_drop(i, length_km, r_km, x_km, pf, three_phase: bool = True) -> Column:
    pf = col(pf)
    sin_phi = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - pf * pf))
    k = SQRT3 if three_phase else 2.0
    return col(i) * col(length_km) * (col(r_km) * pf + col(x_km) * sin_phi) * k


def night_hours(latitude, day_of_year) -> Column:
    """Hours between sunset and sunrise (sunrise equation, -0.833 deg altitude)."""
    lat = F.radians(col(latitude))
    g = F.radians((col(day_of_year) - 1 + 10.0) * (360.0 / 365.24))
    decl = F.asin(
        F.sin(F.radians(F.lit(-23.44)))
        * F.cos(g + F.radians(F.lit(1.914)) * F.sin(F.radians((col(day_of_year) - 3) * (360.0 / 365.24))))
    )
    cos_h = (F.sin(F.radians(F.lit(-0.833))) - F.sin(lat) * F.sin(decl)) / (F.cos(lat) * F.cos(decl))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_h))
    return F.lit(24.0) - F.degrees(F.acos(clipped)) * (2.0 / 15.0)
