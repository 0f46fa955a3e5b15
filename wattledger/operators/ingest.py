"""From source layers and billing tables to canonical entities."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger import schemas
from wattledger.functions import domains as D
from wattledger.functions.numeric import rnd

FEEDER_FIELD = "ALIMENTADORID"
UNKNOWN_FEEDER = "UNKNOWN"

# entity -> (source layers, canonical field <- source field); vendor format, fixed values
MAPPING = {
    "poles": (
        ("EstructuraSoporte",),
        {"pole_id": "GLOBALID", "pole_type": "TIPOESTRUCTURA", "height_m": "ALTURA", "x": "COORD_X", "y": "COORD_Y"},
    ),
    "sites": (
        ("PuestoTransfDistribucion",),
        {
            "site_id": "GLOBALID", "site_code": "CODIGOPUESTO", "pole_id": "ESTRUCTURASOPORTEGLOBALID",
            "bank_config_raw": "CONFIGURACIONLADOBAJA", "phase_raw": "FASECONEXION", "voltage_mv": "VOLTAJE",
            "declared_kva": "POTENCIAKVA", "metered": "MEDIDO", "node_id": "CIRCUITSOURCEGUID",
        },
    ),
    "transformer_units": (
        ("UNIDADTRANSFDISTRIBUCION",),
        {
            "unit_id": "GLOBALID", "site_id": "PUESTOTRANSFDISTGLOBALID", "sn_kva": "POTENCIANOMINAL",
            "voltage_ln": "TENSIONLADOALTA", "phase_raw": "FASECONEXION", "serial": "NUMEROSERIE",
            "brand": "MARCA", "model": "MODELO", "unit_type": "TIPO",
        },
    ),
    "load_points": (
        ("PuntoCarga",),
        {
            "load_point_id": "GLOBALID", "transformer_site_id": "PUESTOTRANSFDISTGLOBALID",
            "pole_id": "ESTRUCTURASOPORTEGLOBALID", "phase_raw": "FASECONEXION",
            "reading_route": "RUTALECTURA", "reading_sequence": "SECUENCIALECTURA", "x": "COORD_X", "y": "COORD_Y",
        },
    ),
    "customers": (
        ("CONEXIONCONSUMIDOR",),
        {
            "customer_unit_id": "CODIGOUNICO", "global_id": "GLOBALID", "site_id": "PUNTOCARGAGLOBALID",
            "customer_code": "CODIGOCLIENTE", "meter_serial": "MDENUMFAB", "meter_brand": "MEDMAR",
            "meter_type": "TIPOMEDIDOR", "phase_raw": "SECUENCIAFASE", "prepaid": "PREPAGO", "status": "ESTADO",
        },
    ),
    "customer_attributes": (
        ("ATRIBUTOSCONSUMIDOR",),
        {
            "customer_unit_id": "CODIGOUNICO", "cuenta_contrato": "CUENTACONTRATO", "tariff_raw": "TIPOTARIFA",
            "category": "CATEGORIA", "installed_load_kw": "POTENCIAACTIVA",
            "installed_reactive_kvar": "POTENCIAREACTIVA", "meter_number": "NUMMEDIDOR",
        },
    ),
    "streetlights": (
        ("Luminaria",),
        {
            "streetlight_id": "GLOBALID", "pole_id": "ESTRUCTURASOPORTEGLOBALID",
            "parent_circuit_source": "PARENTCIRCUITSOURCEGUID", "phase_raw": "FASECONEXION",
            "technology": "TECNOLOGIA", "lamp_w": "POTENCIA",
        },
    ),
    "segments": (
        ("TramoDistribucionAereo", "TramoBajaTensionAereo"),
        {
            "segment_id": "GLOBALID", "node_from": "NODOINICIAL", "node_to": "NODOFINAL", "conductor_code": "CALIBRE",
            "length_m": "LONGITUD", "phase_raw": "FASECONEXION", "voltage_ll": "VOLTAJE", "material": "MATERIAL",
            "r_ohm_per_km": "RESISTENCIA", "x_ohm_per_km": "REACTANCIA", "ampacity_a": "AMPACIDAD",
        },
    ),
    "switching_devices": (
        ("PuestoProteccionDinamico",),
        {"device_id": "GLOBALID", "node_id": "CIRCUITSOURCEGUID", "pole_id": "ESTRUCTURASOPORTEGLOBALID"},
    ),
}


def map_fields(layer: DataFrame, fields: dict[str, str], feeder: str = UNKNOWN_FEEDER) -> DataFrame:
    """Canonical projection of one source layer; absent source fields are skipped."""
    have = set(layer.columns)
    known = [F.col(src).alias(name) for name, src in fields.items() if src in have]
    owner = F.col(FEEDER_FIELD).cast("string") if FEEDER_FIELD in have else F.lit(feeder)
    return layer.select(*known, owner.alias("feeder_id"))


def map_entity(layers: Mapping[str, DataFrame], entity: str, mapping: Mapping = MAPPING) -> DataFrame | None:
    """All source layers of an entity under one schema, with their layer name."""
    names, fields = mapping[entity]
    parts = [map_fields(layers[n], fields).withColumn("source_layer", F.lit(n)) for n in names if n in layers]
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def decode_phases(rows: DataFrame) -> DataFrame:
    if "phase_raw" not in rows.columns:
        return rows
    return rows.withColumn("phase", D.decode_phase("phase_raw")).drop("phase_raw")


def fill_plate(units: DataFrame) -> DataFrame:
    """Plate losses where both are known, else the catalogue by rating."""
    p0, pk = D.catalog_losses("sn_kva")
    own_p0 = F.col("p0_kw") if "p0_kw" in units.columns else F.lit(None).cast("double")
    own_pk = F.col("pk_kw") if "pk_kw" in units.columns else F.lit(None).cast("double")
    source = F.when(own_p0.isNotNull() & own_pk.isNotNull(), "plate").otherwise("catalog")
    return units.select(
        *[c for c in units.columns if c not in ("p0_kw", "pk_kw")],
        F.coalesce(own_p0, p0).alias("p0_kw"), F.coalesce(own_pk, pk).alias("pk_kw"), source.alias("plate_source"),
    )


def units(layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> DataFrame:
    rows = map_entity(layers, "transformer_units", mapping).withColumn("sn_kva", D.parse_kva("sn_kva"))
    return fill_plate(decode_phases(rows))


def sites(layers: Mapping[str, DataFrame], unit_rows: DataFrame, mapping: Mapping = MAPPING) -> DataFrame:
    count = unit_rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_units"))
    rows = map_entity(layers, "sites", mapping).join(count, "site_id", "left")
    rows = rows.withColumn("bank_config", D.decode_bank_config("bank_config_raw", "n_units"))
    rows = rows.withColumn("declared_kva", D.parse_kva("declared_kva")).withColumn("kind", F.lit("transformer"))
    return decode_phases(rows).drop("bank_config_raw", "n_units")


def first_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by all other columns, an aggregate rather than a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *[F.col(f"r.{c}") for c in rest])


def load_points(layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> DataFrame:
    rows = map_entity(layers, "load_points", mapping)
    order = ["reading_route"] + [c for c in rows.columns if c not in ("reading_route", "load_point_id")]
    return first_per_key(decode_phases(rows.select("load_point_id", *order)), "load_point_id")


def identify_customers(layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> DataFrame:
    """A blank unique code falls back to the GIS id so no meter is lost."""
    rows = map_entity(layers, "customers", mapping)
    if "customer_unit_id" not in rows.columns:
        rows = rows.withColumn("customer_unit_id", F.lit(None).cast("string"))
    code = F.coalesce(F.nullif(F.trim("customer_unit_id"), F.lit("")), F.col("global_id"))
    return decode_phases(rows.withColumn("customer_unit_id", code))


def inherit_from_load_point(customers: DataFrame, points: DataFrame) -> DataFrame:
    """Transformer and pole come from the load point; phase only where missing."""
    have = points.columns
    up = points.select(
        F.col("load_point_id").alias("site_id"),
        "transformer_site_id",
        F.col("pole_id"),
        F.col("phase").alias("lp_phase"),
        *([F.col("service_drop_kva")] if "service_drop_kva" in have else []),
    )
    rows = customers.drop("transformer_site_id", "pole_id").join(up, "site_id", "left")
    return rows.withColumn("phase", F.coalesce("phase", "lp_phase")).drop("lp_phase")


def add_attributes(customers: DataFrame, layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> DataFrame:
    """Billing attributes by unique code (first per code) and the tariff class."""
    attrs = map_entity(layers, "customer_attributes", mapping).drop("feeder_id", "source_layer")
    rows = customers.join(first_per_key(attrs, "customer_unit_id"), "customer_unit_id", "left")
    return rows.withColumn("tariff_class", D.decode_tariff("tariff_raw")).drop("tariff_raw")


def trace_parent(rows: DataFrame, site_rows: DataFrame) -> DataFrame:
    """Transformer site by the parent circuit id the source system carries."""
    key = site_rows.groupBy(F.col("node_id").alias("parent_circuit_source")).agg(
        F.max("site_id").alias("traced_site_id")
    )
    out = rows.join(key, "parent_circuit_source", "left")
    own = F.col("transformer_site_id") if "transformer_site_id" in rows.columns else F.lit(None).cast("string")
    return out.withColumn("transformer_site_id", F.coalesce(own, "traced_site_id")).drop("traced_site_id")


def section(source_layer) -> Column:
    return F.when(F.lower(source_layer).contains("bajatension"), "secondary").otherwise("primary")


def segments(layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> DataFrame:
    rows = decode_phases(map_entity(layers, "segments", mapping))
    return rows.withColumn("section", section(F.col("source_layer")))


def build_canonical(layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> dict[str, DataFrame]:
    """All entities the layers allow, lazily; each is one plan."""
    out: dict[str, DataFrame] = {}
    if "UNIDADTRANSFDISTRIBUCION" in layers:
        out["transformer_units"] = units(layers, mapping=mapping)
    if "PuestoTransfDistribucion" in layers:
        out["sites"] = sites(layers, out["transformer_units"], mapping=mapping)
    if "PuntoCarga" in layers:
        out["load_points"] = load_points(layers, mapping=mapping)
    if "CONEXIONCONSUMIDOR" in layers:
        meters = identify_customers(layers, mapping=mapping)
        if "load_points" in out:
            meters = inherit_from_load_point(meters, out["load_points"])
        if "ATRIBUTOSCONSUMIDOR" in layers:
            meters = add_attributes(meters, layers, mapping=mapping)
        else:
            meters = meters.withColumn("tariff_class", F.lit(P.TARIFF_DEFAULT))
        out["customers"] = meters
    if "EstructuraSoporte" in layers:
        out["poles"] = map_entity(layers, "poles", mapping)
    if "Luminaria" in layers:
        out["streetlights"] = trace_parent(decode_phases(map_entity(layers, "streetlights", mapping)), out["sites"])
    if "PuestoProteccionDinamico" in layers:
        out["switching_devices"] = map_entity(layers, "switching_devices", mapping)
    if "TramoDistribucionAereo" in layers or "TramoBajaTensionAereo" in layers:
        out["segments"] = segments(layers, mapping=mapping)
    return out


def ingest_layers(lake, layers: Mapping[str, DataFrame], mapping: Mapping = MAPPING) -> list[str]:
    """Source layers to bronze entities in one call; returns the entities written.

    ``mapping`` gives each entity its source layers and fields, as MAPPING does.
    """
    found = build_canonical(layers, mapping)
    for entity, rows in found.items():
        lake.write_partitions("bronze", entity, schemas.conform(rows, entity))
    return list(found)


def hierarchy_summary(relations: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Children per parent for each named relation (parents, children, child's parent key)."""

    def one(name: str, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
        per = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        stats = per.agg(
            F.sum("n").alias("children"), F.max("n").alias("max"), F.avg("n").alias("mean"),
            F.count(F.when(F.col("n") > 1, 1)).alias("multi"),
        )
        return stats.select(
            F.lit(name).alias("relation"),
            parents.agg(F.count(F.lit(1))).scalar().alias("parents"),
            F.coalesce("children", F.lit(0)).alias("children"),
            F.coalesce("max", F.lit(0)).alias("children_per_parent_max"),
            F.coalesce(rnd("mean", 2), F.lit(0.0)).alias("children_per_parent_mean"),
            F.col("multi").alias("parents_multi"),
        )

    return reduce(DataFrame.unionByName, [one(n, *r) for n, r in relations.items()])


# --- billing tables -----------------------------------------------------------


def link_consumption(rows: DataFrame, customers: DataFrame, key: str = "cuenta_contrato") -> DataFrame:
    """Billing rows with their meter id and whether that meter is known.

    The account side is one row per account, so a hot account only skews the
    streamed side, which AQE splits.
    """
    accounts = (
        customers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("customer_unit_id").alias("linked_id"))
    )
    own = F.col("customer_unit_id") if "customer_unit_id" in rows.columns else F.lit(None).cast("string")
    linked = rows.join(accounts, key, "left").withColumn("customer_unit_id", F.coalesce(own, "linked_id")).drop("linked_id")
    known = customers.select("customer_unit_id", F.lit(True).alias("matched")).distinct()
    return linked.join(known, "customer_unit_id", "left").na.fill(False, ["matched"])


def link_stats(linked: DataFrame) -> DataFrame:
    """Match rate; below 95 % the balance is not to be trusted.  Reduced per meter first."""
    per = linked.groupBy("customer_unit_id", "matched").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("matched"), F.col("n")).otherwise(0)
    sums = per.agg(
        F.sum("n").alias("records"), F.sum(hit).alias("matched"), F.count(F.when(F.col("matched"), 1)).alias("customers_matched")
    )
    rate = rnd(F.col("matched") / F.col("records"), 4)
    return sums.select(
        "records", "matched", (F.col("records") - F.col("matched")).alias("unmatched"), rate.alias("match_rate"),
        "customers_matched", (rate < 0.95).alias("low_match"),
    )


def _require(df: DataFrame, needed: tuple[str, ...]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def rename(df: DataFrame, field_map: dict[str, str] | None) -> DataFrame:
    """Canonical names for the mapped source fields, the rest kept."""
    inverse = {src: name for name, src in (field_map or {}).items()}
    return df.select(*[F.col(c).alias(inverse.get(c, c)) for c in df.columns])


def number(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def ingest_consumption(rows: DataFrame, customers: DataFrame, field_map: dict[str, str] | None = None) -> DataFrame:
    """Canonical consumption: linked, typed, bad energy as zero, feeder from the meter if absent."""
    df = rename(rows, field_map)
    if "customer_unit_id" not in df.columns or "cuenta_contrato" in df.columns:
        df = link_consumption(df, customers).drop("matched")
    if "feeder_id" not in df.columns:
        owner = customers.groupBy("customer_unit_id").agg(F.min("feeder_id").alias("feeder_id"))
        df = df.join(owner, "customer_unit_id", "left")
    _require(df, ("customer_unit_id", "feeder_id", "year_month", "kwh"))
    out = df.withColumn("year_month", D.year_month("year_month")).withColumn("kwh", F.coalesce(number("kwh"), F.lit(0.0)))
    out = out.withColumn("kvarh", number("kvarh") if "kvarh" in df.columns else F.lit(None).cast("double"))
    if "estimated" not in df.columns:
        out = out.withColumn("estimated", F.lit(False))
    return schemas.conform(out, "consumption").select(*[f.name for f in schemas.schema("consumption")])


def ingest_header(rows: DataFrame, field_map: dict[str, str] | None = None) -> DataFrame:
    df = rename(rows, field_map)
    _require(df, ("feeder_id", "year_month", "kwh"))
    out = df.withColumn("year_month", D.year_month("year_month")).withColumn("kwh", F.coalesce(number("kwh"), F.lit(0.0)))
    return schemas.conform(out, "header_meters").select(*[f.name for f in schemas.schema("header_meters")])


# --- checks -------------------------------------------------------------------


def validate_required(entities: dict[str, DataFrame]) -> DataFrame:
    """NULLs per required column: one aggregate per entity, unpivoted."""

    def one(entity: str, df: DataFrame) -> DataFrame:
        cols = schemas.required_columns(entity)
        have = set(df.columns)
        nulls = [
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.when(F.col(c).isNull(), 1) if c in have else F.lit(1)).alias("nulls"),
            )
            for c in cols
        ]
        sums = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*nulls).alias("c"))
        return sums.select(F.lit(entity).alias("entity"), "rows", F.explode("c").alias("c")).select(
            "entity", "c.column", "c.nulls", "rows"
        )

    return reduce(DataFrame.unionByName, [one(e, df) for e, df in entities.items()])


# entity, column -> allowed values
ENUMS = {
    ("customers", "tariff_class"): P.TARIFF_CLASSES,
    ("customers", "phase"): P.PHASES,
    ("sites", "bank_config"): P.BANK_CONFIGS,
    ("segments", "phase"): P.PHASES,
    ("switching_devices", "normal_state"): ("NA", "NC"),
    ("streetlights", "technology"): P.LAMP_TECHNOLOGIES,
    ("switching_events", "motivo"): P.SWITCHING_REASONS,
}


def validate_enums(entities: dict[str, DataFrame]) -> DataFrame:
    """Rows whose value is outside its declared domain (NULL counts as outside)."""

    def one(entity: str, column: str, allowed) -> DataFrame:
        bad = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
        return entities[entity].agg(F.count(F.when(bad, 1)).alias("violations")).select(
            F.lit(entity).alias("entity"), F.lit(column).alias("column"), "violations"
        )

    return reduce(
        DataFrame.unionByName, [one(e, c, allowed) for (e, c), allowed in ENUMS.items() if e in entities]
    )
