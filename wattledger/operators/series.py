"""Per-meter consumption series and array arithmetic on it.

A series is bounded by the number of periods (tens), so one array per meter is
safe however many raw readings a meter has: readings are summed per meter and
period before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_KWH = 0.01


def series(consumption: DataFrame) -> DataFrame:
    """(customer_unit_id, feeder_id, months, kwh[], kvarh[], est[]) on the full calendar.

    A period without reading counts as zero.
    """
    calendar = consumption.agg(F.array_sort(F.collect_set("year_month")).alias("m")).scalar()
    monthly = consumption.groupBy("feeder_id", "customer_unit_id", "year_month").agg(
        F.sum("kwh").alias("kwh"),
        F.sum("kvarh").alias("kvarh"),
        F.avg(F.col("estimated").cast("double")).alias("est"),
    )
    packed = monthly.groupBy("feeder_id", "customer_unit_id").agg(
        F.sort_array(F.collect_list(F.struct("year_month", "kwh", "kvarh", "est"))).alias("v")
    )
    # a meter has a row per period or fewer, so as many as the calendar has are the calendar itself
    full = F.size("v") == F.size("months")
    at = F.map_from_entries(F.transform("v", lambda r: F.struct(r["year_month"], r)))

    def dense(field: str) -> Column:
        gaps = bind(at, lambda known: F.transform("months", lambda m: F.try_element_at(known, m)[field]))
        return F.transform(F.when(full, F.col(f"v.{field}")).otherwise(gaps), lambda x: F.coalesce(x, F.lit(0.0))).alias(field)

    return packed.withColumn("months", calendar).select(
        "customer_unit_id", "feeder_id", "months", dense("kwh"), dense("kvarh"), dense("est")
    )


def series_rows(frame: DataFrame) -> DataFrame:
    """Long form of the dense matrix."""
    zipped = F.arrays_zip("months", "kwh", "kvarh")
    return frame.select("customer_unit_id", F.posexplode(zipped).alias("t", "z")).select(
        "customer_unit_id", "t", F.col("z.months").alias("year_month"), "z.kwh", "z.kvarh"
    )


# --- array arithmetic -------------------------------------------------------


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    An expression placed inside a lambda is evaluated for every element; passing it
    in as a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def std_pop(a: Column) -> Column:
    def spread(mu: Column) -> Column:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mu) * (x - mu)) / F.size(a))

    return F.when(F.size(a) > 0, bind(mean(a), spread))


def std_running(a: Column) -> Column:
    """``std_pop`` by Welford's update in the order of the entries, as the SQL's deviation adds up."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        moved = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), moved.alias("mean"), (acc["squares"] + (x - moved) * (x - acc["mean"])).alias("squares"))

    return F.aggregate(a, start, step, lambda acc: F.when(acc["n"] > 0, F.sqrt(acc["squares"] / acc["n"])))


def median(a: Column) -> Column:
    """Middle of the non-null entries; NULL when there is none.

    The entries are sorted once per row, and in their natural order: ``array_sort`` calls
    its comparator, an interpreted lambda, for every pair that it compares.
    """

    def middle(s: Column) -> Column:
        n = F.size(s)
        low = F.get(s, F.floor((n - 1) / 2).cast("int"))
        high = F.get(s, F.floor(n / 2).cast("int"))
        return F.when(n > 0, low + (high - low) * 0.5)

    return bind(F.sort_array(F.array_compact(a)), middle)


def head(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), n)


def tail(a: Column, start: Column) -> Column:
    """Entries from 0-based ``start`` on."""
    return F.slice(a, (start + 1).cast("int"), F.greatest(F.size(a) - start, F.lit(0)).cast("int"))


def last(a: Column, n: int) -> Column:
    return tail(a, F.greatest(F.size(a) - n, F.lit(0)))


def half(a: Column) -> Column:
    return F.floor(F.size(a) / 2).cast("int")


def longest_zero_run(a: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x <= ZERO_KWH, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(a, start, step, lambda acc: acc["best"])
