"""Canonical entities: names, types and which columns must be filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# entity -> "column type" list; a trailing ! marks a required column
_DDL = {
    "poles": "pole_id string!, feeder_id string!, x double, y double, pole_type string, height_m double",
    "sites": "site_id string!, feeder_id string!, pole_id string, kind string!, bank_config string!, node_id string!",
    "transformer_units": "unit_id string!, site_id string!, feeder_id string!, sn_kva double!, p0_kw double, "
    "pk_kw double, z_pct double, voltage_ln double, phase string, serial string, plate_source string",
    "load_points": "load_point_id string!, feeder_id string!, transformer_site_id string!, pole_id string, "
    "phase string, service_drop_kva double, reading_route string, reading_sequence string, x double, y double",
    "customers": "customer_unit_id string!, feeder_id string!, site_id string!, pole_id string, "
    "tariff_class string!, phase string, installed_load_kw double, service_drop_kva double, "
    "transformer_site_id string!, customer_code string",
    "consumption": "customer_unit_id string!, feeder_id string!, year_month string!, kwh double!, "
    "kvarh double, estimated boolean",
    "segments": "segment_id string!, feeder_id string!, feeder_id_declared string, node_from string!, "
    "node_to string!, length_m double!, conductor_code string!, r_ohm_per_km double!, x_ohm_per_km double!, "
    "ampacity_a double!, phase string!, voltage_ll double!, construction string, section string, material string",
    "streetlights": "streetlight_id string!, feeder_id string!, site_id string, transformer_site_id string, "
    "technology string!, installed_technology string, photocell_fault boolean, lamp_w double!",
    "header_meters": "feeder_id string!, year_month string!, kwh double!, kvarh double",
    "switching_devices": "device_id string!, feeder_id string!, node_id string!, type string, "
    "normal_state string!, current_state string, remote boolean",
    "switching_events": "device_id string!, feeder_id string!, timestamp timestamp!, estado_previo string, "
    "estado_nuevo string, motivo string, duration_h double, affected_kw double",
    "protection_zones": "feeder_id string!, zone_id string!, parent_zone string, n_nodes long, "
    "n_customers long, n_tx_sites long, has_upstream_device boolean",
    "theft_labels": "customer_unit_id string!, feeder_id string, is_theft boolean!, stolen_kwh double",
    "field_inspections": "inspection_id string!, site_id string!, inspected_date date!, finding boolean!, "
    "recovered_kwh double, actual_cost_usd double, source string",
}


def required_columns(entity: str) -> list[str]:
    return [f.split()[0] for f in _DDL[entity].split(", ") if f.endswith("!")]


def schema(entity: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[entity].replace("!", ""))


def entities() -> list[str]:
    return list(_DDL)


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Typed columns in canonical order; absent optional columns become typed NULLs."""
    have = set(df.columns)
    fields = schema(entity).fields
    known = [
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ]
    extra = [c for c in df.columns if c not in {f.name for f in fields}]
    return df.select(*known, *extra)
