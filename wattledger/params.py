"""Business constants.

Every number the operators use lives here (or is passed in by the caller); the
operator modules themselves hold relations only.  All tables below are fixed
values: results are comparable only if they stay as they are.
"""

from __future__ import annotations

import copy
import math

# --- fixed values -----------------------------------------------------------

ELECTRICAL = {
    "loss_factor_k": 0.15,
    "naive_pf_default": 0.80,
    "neutral_r_ohm": 0.30,
    "default_load_factor": 0.45,
    "default_site_pf": 0.92,
    "secondary_loss_frac": 0.035,
    "hours_per_month": 730.0,
    "power_factor_by_class": {
        "residential": 0.93,
        "commercial": 0.90,
        "industrial": 0.88,
    },
    "velander": {
        "residential": (0.0002, 0.03),
        "commercial": (0.0003, 0.05),
        "industrial": (0.0004, 0.08),
    },
    "coincidence": (0.20, 0.80),
    "temperature": {
        "alpha_al": 0.00403,
        "alpha_cu": 0.00393,
        "ref_c": 20.0,
        "op_c_overhead": 50.0,
        "op_c_underground": 65.0,
    },
    "voltage": {"ll_mv": 13800.0, "ll_lv": 380.0, "ln_lv": 220.0, "split_240": 240.0},
}

POWERFLOW = {"tol_losses_pct": 2.0, "tol_voltage_pct": 0.5, "pf": 0.92, "sweeps": 4}

STREETLIGHT = {
    "hours_on_default": 11.5,
    "latitude_default": 0.0,
    "days_per_month": 30.0,
    "ballast_loss_frac": {"led": 0.10, "sodium": 0.18, "mercury": 0.20, "metal_halide": 0.15},
}

# class bounds, highest first; the first bound is exclusive, the others inclusive
LOADABILITY = {
    "overloaded_critical": 1.20,
    "overloaded": 1.00,
    "high_load": 0.80,
    "adequate": 0.30,
    "underutilized": 0.15,
}

THRESHOLDS = {
    "imbalance_warn_pct": 10.0,
    "open_delta_factor": math.sqrt(3.0),
    "total_losses_max_pct": 40.0,
    "technical_max_pct": 15.0,
    "technical_min_pct": 1.0,
    "drop_recovery_pct": 0.40,
    "drop_recovery_months": 3,
    "jump_after_intervention_pct": 0.30,
    "zero_active_months": 4,
    "drop_overload_ratio": 1.0,
    "drop_underuse_ratio": 0.10,
    "intra_dispersion_min_ratio": 0.40,
    "transfer_min_shift": 0.15,
    "transfer_corr": -0.6,
}

MONTECARLO = {"n_samples": 500, "sigma_technical": 0.12, "seed": 20260803}

# rule id -> (enabled, severity, confidence)
RULES = {
    "R01": (True, "alta", 0.9),
    "R02": (True, "alta", 0.8),
    "R03": (True, "media", 0.6),
    "R04": (True, "media", 0.5),
    "R06": (True, "alta", 0.85),
    "R07": (True, "critica", 0.9),
    "R08": (True, "critica", 1.0),
    "R09": (True, "alta", 0.8),
    "R10": (True, "critica", 1.0),
    "R13": (True, "critica", 0.9),
    "R15": (True, "alta", 0.5),
    "R20": (True, "critica", 1.0),
    "R22": (True, "critica", 1.0),
    "R23": (True, "alta", 1.0),
    "R25": (True, "media", 1.0),
}
RULE_MIN_LENGTH_M = 15.0
SEVERITY_WEIGHT = {"critica": 5.0, "alta": 2.0, "media": 1.0}

# code -> (material, r ohm/km, x ohm/km, ampacity A); gauge grows down each list
PRIMARY_CONDUCTORS = {
    "ACSR_1/0": ("al", 0.556, 0.400, 230.0),
    "ACSR_2/0": ("al", 0.441, 0.390, 270.0),
    "ACSR_4/0": ("al", 0.276, 0.375, 340.0),
    "ACSR_266": ("al", 0.216, 0.365, 460.0),
}
SECONDARY_CONDUCTORS = {
    "CU_6": ("cu", 1.320, 0.100, 80.0),
    "CU_4": ("cu", 0.830, 0.095, 105.0),
    "AL_2": ("al", 0.856, 0.090, 120.0),
    "TRIPLEX_2": ("al", 0.868, 0.088, 115.0),
}

# kVA -> (no-load kW, load kW)
TRANSFORMER_CATALOG = {
    5.0: (0.030, 0.090),
    10.0: (0.045, 0.150),
    15.0: (0.060, 0.200),
    25.0: (0.085, 0.310),
    37.5: (0.115, 0.430),
    50.0: (0.145, 0.550),
    75.0: (0.200, 0.780),
    100.0: (0.250, 1.000),
    112.5: (0.270, 1.100),
    150.0: (0.340, 1.400),
    167.0: (0.370, 1.550),
    200.0: (0.420, 1.800),
    250.0: (0.500, 2.150),
    300.0: (0.580, 2.500),
    400.0: (0.720, 3.200),
    500.0: (0.850, 3.900),
    630.0: (1.030, 4.800),
    750.0: (1.180, 5.600),
    1000.0: (1.500, 7.200),
}
CATALOG_P0_FRAC = 0.0030
CATALOG_PK_FRAC = 0.0110

BUDGET = {
    "field_usd": 4_000_000.0,
    "exploration_reserve_frac": 0.075,
    "tariff_usd_per_kwh": 0.15,
    "recovery_months": 18.0,
    "visit_usd": 45.0,
    "normalization_usd": 200.0,
    "visits_per_crew_day": 12,
    "num_crews": 20,
    "cost_per_visit_grid": (20, 30, 50, 80),
    "grid_m": 1000.0,
    # rows of the rankings and of the report tables
    "ranked_sites": 500,
    "ranked_units": 1000,
    "report_rows": 10,
    "sheet_meters": 30,
}

PHASE_DESIGNATION = {1: "C", 2: "B", 3: "BC", 4: "A", 5: "CA", 6: "AB", 7: "ABC"}
LAMP_TECHNOLOGIES = ("led", "sodium", "mercury", "metal_halide")
SWITCHING_REASONS = ("falla", "maniobra", "transferencia")
PHASES = ("A", "B", "C", "AB", "BC", "CA", "ABC")

BANK_CONFIG_DOMAIN = {
    "MONOFASICO": "single",
    "MONOFASICA": "single",
    "SIMPLE": "single",
    "ESTRELLA": "wye_closed",
    "ESTRELLACERRADA": "wye_closed",
    "YCERRADA": "wye_closed",
    "DELTA": "delta_closed",
    "DELTACERRADA": "delta_closed",
    "DELTAABIERTA": "open_delta",
    "VV": "open_delta",
    "ESTRELLAABIERTADELTAABIERTA": "open_wye_open_delta",
    "YABIERTADELTAABIERTA": "open_wye_open_delta",
    "DELTA4HILOS": "delta_4wire",
    "INDEPENDIENTE": "independent",
}
BANK_UNITS = {
    "single": 1,
    "wye_closed": 3,
    "delta_closed": 3,
    "open_delta": 2,
    "open_wye_open_delta": 2,
    "delta_4wire": 3,
}
BANK_CONFIGS = tuple(BANK_UNITS) + ("independent",)

TARIFF_DOMAIN = {
    "RESIDENCIAL": "residential",
    "RESIDENCIALTEMPORAL": "residential",
    "COMERCIAL": "commercial",
    "COMERCIALOTROS": "commercial",
    "INDUSTRIAL": "industrial",
    "INDUSTRIALARTESANAL": "industrial",
    "ALUMBRADOPUBLICO": "streetlight_led",
    "OTROS": "commercial",
}
TARIFF_DEFAULT = "residential"
TARIFF_CLASSES = ("residential", "commercial", "industrial", "streetlight_led")

PIPELINE_STAGES = (
    "ingest",
    "topology",
    "electrical",
    "power_flow",
    "balance",
    "state_estimation",
    "ml_risk",
    "prioritization",
)

# --- one run's settings -------------------------------------------------------

_DEFAULTS = {
    "electrical": ELECTRICAL,
    "powerflow": POWERFLOW,
    "streetlight": STREETLIGHT,
    "loadability": LOADABILITY,
    "thresholds": THRESHOLDS,
    "montecarlo": MONTECARLO,
    "rules": RULES,
    "rule_min_length_m": RULE_MIN_LENGTH_M,
    "budget": BUDGET,
    "months_per_period": 1.0,
}


def settings(**overrides) -> dict:
    """A private copy of the defaults; a dict override updates that section."""
    out = copy.deepcopy(_DEFAULTS)
    for name, value in overrides.items():
        if isinstance(value, dict):
            out[name].update(value)
        else:
            out[name] = value
    return out


def hours_per_period(cfg: dict) -> float:
    """Hours covered by one consumption period (730 h per month)."""
    return cfg["electrical"]["hours_per_month"] * cfg["months_per_period"]


def loss_factor_value(cfg: dict) -> float:
    """Buller-Woodrow loss factor at the default load factor."""
    k = cfg["electrical"]["loss_factor_k"]
    fc = cfg["electrical"]["default_load_factor"]
    return k * fc + (1.0 - k) * fc * fc
