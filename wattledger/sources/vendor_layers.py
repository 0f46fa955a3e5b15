"""Source GIS layers in vendor form, derived from the benchmark tables.

Column names, domain texts and codes follow the vendor format, so the ingestion
operators run on realistic input: blank keys, coded phases, text ratings, duplicate
load points, dangling parents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import lookup
from wattledger.sources.bench_tables import BenchTables

# vendor texts in bank order, tariff texts per market segment (fixed values)
BANK_TEXT = ("Monofasico", "Estrella Cerrada", "DELTA", "Delta-Abierta", "Y abierta / Delta abierta", "delta 4 hilos", "???")
TARIFF_TEXT = {
    "HOUSEHOLD": "RESIDENCIAL-A",
    "FURNITURE": "Residencial temporal",
    "BUILDING": "Comercial / Otros B",
    "AUTOMOBILE": "Otros",
    "MACHINERY": "INDUSTRIAL ARTESANAL",
}


def _mod(column: str, values) -> Column:
    return lookup(dict(enumerate(values)), F.col(column) % len(values))


class _Layers(Mapping):
    """Layers by name, each built when first read."""

    def __init__(self, build: dict[str, Callable[[], DataFrame]]):
        self._build, self._made = build, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._build[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


class VendorLayers(BenchTables):
    @cached_property
    def layers(self) -> Mapping[str, DataFrame]:
        return _Layers(
            {
                "EstructuraSoporte": lambda: self._poles_layer,
                "PuestoTransfDistribucion": lambda: self._sites_layer,
                "UNIDADTRANSFDISTRIBUCION": lambda: self._units_layer,
                "PuntoCarga": lambda: self._load_points_layer,
                "CONEXIONCONSUMIDOR": lambda: self._meters_layer,
                "ATRIBUTOSCONSUMIDOR": lambda: self._attributes_layer,
                "Luminaria": lambda: self._lamps_layer,
                "TramoDistribucionAereo": lambda: self._segments_layer("primary"),
                "TramoBajaTensionAereo": lambda: self._segments_layer("secondary"),
                "PuestoProteccionDinamico": lambda: self._devices_layer,
            }
        )

    @property
    def _devices_layer(self) -> DataFrame:
        return self.switching_devices.select(
            F.col("device_id").alias("GLOBALID"), F.col("feeder_id").alias("ALIMENTADORID"),
            F.col("node_id").alias("CIRCUITSOURCEGUID"),
        )

    @property
    def _poles_layer(self) -> DataFrame:
        return self.poles.select(
            F.col("pole_id").alias("GLOBALID"), F.col("feeder_id").alias("ALIMENTADORID"),
            F.lit("POSTE HC").alias("TIPOESTRUCTURA"), F.col("x").alias("COORD_X"), F.col("y").alias("COORD_Y"),
        )

    @property
    def _sites_layer(self) -> DataFrame:
        s = self._site_keys.select("site_id", "b", "si").join(self.sites.drop("bank_config"), "site_id")
        return s.select(
            F.col("site_id").alias("GLOBALID"), F.col("feeder_id").alias("ALIMENTADORID"),
            F.col("pole_id").alias("ESTRUCTURASOPORTEGLOBALID"),
            lookup(dict(enumerate(BANK_TEXT)), F.col("b")).alias("CONFIGURACIONLADOBAJA"),
            (F.col("b") + 1).cast("string").alias("FASECONEXION"),
            F.concat((F.col("si") % 4 * 25 + 25).cast("string"), F.lit(",5 kVA")).alias("POTENCIAKVA"),
            F.col("node_id").alias("CIRCUITSOURCEGUID"),
        )

    @property
    def _units_layer(self) -> DataFrame:
        rating = F.regexp_replace(F.format_string("%.1f kVA", "sn_kva"), r"\.", ",")
        return self.transformer_units.select(
            F.col("unit_id").alias("GLOBALID"), F.col("feeder_id").alias("ALIMENTADORID"),
            F.col("site_id").alias("PUESTOTRANSFDISTGLOBALID"), rating.alias("POTENCIANOMINAL"),
            F.col("voltage_ln").alias("TENSIONLADOALTA"), F.lit("4").alias("FASECONEXION"),
        )

    @property
    def _load_points_layer(self) -> DataFrame:
        lp = self._meters.select("feeder_id", "f", "si", "lp", "node_k").distinct()
        copies = F.when(F.col("lp") % 3 == 0, 2).otherwise(1)
        rows = lp.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        return rows.select(
            F.concat("feeder_id", F.lit("-LP"), F.col("lp").cast("string")).alias("GLOBALID"),
            F.col("feeder_id").alias("ALIMENTADORID"),
            F.concat("feeder_id", F.lit("-S"), F.col("si").cast("string")).alias("PUESTOTRANSFDISTGLOBALID"),
            F.concat(F.lit("PO"), ((F.col("node_k") + F.col("copy")) * 25 + F.col("f")).cast("string")).alias("ESTRUCTURASOPORTEGLOBALID"),
            _mod("lp", ("7", "4", "AB")).alias("FASECONEXION"),
            F.format_string("R%d", F.col("copy")).alias("RUTALECTURA"),
        )

    @property
    def _meters_layer(self) -> DataFrame:
        ck = F.col("c_custkey")
        code = F.when(ck % 41 == 0, F.lit(None)).when(ck % 37 == 0, F.lit("  ")).otherwise(F.concat(F.lit("C"), ck.cast("string")))
        phase = F.when(ck % 5 == 0, F.lit(None)).when(ck % 7 == 0, F.lit(" a")).otherwise(_mod("c_custkey", ("1", "2", "4", "6", "9")))
        return self._meters.select(
            F.concat(F.lit("G"), ck.cast("string")).alias("GLOBALID"), F.col("feeder_id").alias("ALIMENTADORID"),
            F.concat("feeder_id", F.lit("-LP"), F.col("lp").cast("string")).alias("PUNTOCARGAGLOBALID"),
            code.alias("CODIGOUNICO"), phase.alias("SECUENCIAFASE"),
        )

    @property
    def _attributes_layer(self) -> DataFrame:
        ck = F.col("c_custkey")
        tariff = F.when(ck % 29 == 0, F.lit(None)).otherwise(lookup(TARIFF_TEXT, F.col("c_mktsegment")))
        return self._meters.where(ck % 11 != 0).select(
            F.concat(F.lit("C"), ck.cast("string")).alias("CODIGOUNICO"),
            F.concat(F.lit("CC"), ck.cast("string")).alias("CUENTACONTRATO"),
            tariff.alias("TIPOTARIFA"),
            (F.lit(1.0) + F.abs("c_acctbal") / 1000.0).alias("POTENCIAACTIVA"),
        )

    @property
    def _lamps_layer(self) -> DataFrame:
        p = self._parts.where(F.col("p_size") % 10 == 0)
        parent = F.concat("feeder_id", F.lit("-N"), F.expr("k div 20 * 20 + 7").cast("string"))
        return p.select(
            F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("GLOBALID"),
            F.col("feeder_id").alias("ALIMENTADORID"),
            F.when(F.col("p_size") == 50, F.lit("{NONE}")).otherwise(parent).alias("PARENTCIRCUITSOURCEGUID"),
            _mod("p_partkey", ("led", "sodium", "mercury")).alias("TECNOLOGIA"),
            _mod("k", (70.0, 100.0, 150.0)).alias("POTENCIA"),
        )

    def _segments_layer(self, section: str) -> DataFrame:
        return self.segments.where(F.col("section") == section).select(
            F.col("segment_id").alias("GLOBALID"), F.col("feeder_id").alias("ALIMENTADORID"),
            F.col("node_from").alias("NODOINICIAL"), F.col("node_to").alias("NODOFINAL"),
            F.col("conductor_code").alias("CALIBRE"), F.col("length_m").alias("LONGITUD"),
            F.col("phase").alias("FASECONEXION"), F.col("voltage_ll").alias("VOLTAJE"),
        )

    @cached_property
    def commercial(self) -> DataFrame:
        """Consumption as the billing system delivers it: by contract account, all text."""
        ck = F.col("c_custkey")
        period = F.when(ck % 97 == 0, F.lit("sin fecha")).otherwise(F.concat(self._ym(), F.lit("-01")))
        account = F.when(ck % 53 == 0, F.concat(F.lit("CX"), ck.cast("string"))).otherwise(F.concat(F.lit("CC"), ck.cast("string")))
        amount = F.when(ck % 89 == 0, F.lit("n/d")).otherwise(F.format_string("%.1f", "kwh"))
        return self.readings.select(account.alias("CTA"), period.alias("PERIODO"), amount.alias("CONSUMO"))
