"""Decoding of vendor domain values to canonical values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger import params as P
from wattledger.functions.numeric import col, lookup


def domain_key(value) -> Column:
    """Upper-case text with everything but letters and digits removed."""
    return F.regexp_replace(F.upper(F.trim(col(value).cast("string"))), "[^A-Z0-9]", "")


def decode_phase(value) -> Column:
    """Bit mask 1..7 (C=1, B=2, A=4) or letters already; anything else is NULL."""
    text = F.upper(F.trim(col(value).cast("string")))
    by_code = lookup(P.PHASE_DESIGNATION, F.expr("1") * text.try_cast("int"))
    return F.when(text.isin(*P.PHASES), text).otherwise(by_code)


def bank_by_count(n_units) -> Column:
    return lookup({1: "single", 2: "open_delta", 3: "wye_closed"}, col(n_units), "independent")


def decode_bank_config(value, n_units) -> Column:
    return F.coalesce(lookup(P.BANK_CONFIG_DOMAIN, domain_key(value)), bank_by_count(n_units))


def decode_tariff(value) -> Column:
    """Exact key, else the longest key the text starts with, else the default class."""
    key = domain_key(value)
    longest_first = sorted(P.TARIFF_DOMAIN, key=len, reverse=True)
    prefixes = F.coalesce(*[F.when(key.startswith(k), F.lit(P.TARIFF_DOMAIN[k])) for k in longest_first])
    return F.coalesce(lookup(P.TARIFF_DOMAIN, key), prefixes, F.lit(P.TARIFF_DEFAULT))


def parse_kva(value) -> Column:
    """First number in the text; a decimal comma is accepted."""
    number = F.regexp_extract(col(value).cast("string"), r"(\d+(?:[.,]\d+)?)", 1)
    return F.regexp_replace(number, ",", ".").try_cast("double")


def catalog_losses(sn_kva) -> tuple[Column, Column]:
    """(no-load kW, load kW): exact rating in the catalogue, else a fraction of it."""
    sn = col(sn_kva)
    p0 = lookup({k: v[0] for k, v in P.TRANSFORMER_CATALOG.items()}, sn)
    pk = lookup({k: v[1] for k, v in P.TRANSFORMER_CATALOG.items()}, sn)
    return (
        F.coalesce(p0, F.round(sn * P.CATALOG_P0_FRAC, 4)),
        F.coalesce(pk, F.round(sn * P.CATALOG_PK_FRAC, 4)),
    )


def year_month(value) -> Column:
    """'YYYY-MM'; text that is no date is kept as it is."""
    text = col(value).cast("string")
    parsed = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM"), text)
