"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Half-up rounding; the inner step drops summation noise so ties are stable."""
    if isinstance(c, str):
        return F.expr(f"round(round({c}, {digits + 5}), {digits})")
    return F.round(F.round(c, digits + 5), digits)


def ratio(num: Column | str, den: Column | str, otherwise: float = 0.0) -> Column:
    """``num / den`` where ``den`` > 0, else a constant."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(float(otherwise)))


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lookup(values: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a constant table (tables here have at most ~20 entries).

    One map literal, folded at planning time: building a CASE branch by branch costs
    a round trip to the JVM per branch.
    """
    entries = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in values.items())
    found = F.try_element_at(F.expr(f"map({entries})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def listed(*conditions: tuple[str, Column]) -> Column:
    """Comma-joined names of the conditions that hold ('' if none)."""
    return F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in conditions])
