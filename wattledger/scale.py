"""Order statistics that never put a whole group into one task.

A plain ``Window.partitionBy(feeder)`` or ``percentile`` holds one group in one
task.  A feeder (or a site, or a building) may hold a third of all rows, so ranks,
running sums, medians and quantiles go through one range-partitioned sort: every
task sees a slice of the order, the slices' totals are added up on a table with
one row per (group, slice), and each row adds its slice's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattledger.session import materialize, materialize_with

_SLICE = "_slice"
#: values of a group that one task may hold, and counts that a larger group is split into at a time
GROUP_ROWS, BUCKETS = 100_000, 4096
#: positions of one slice of ``along``
SLICE_ROWS = 1 << 17


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str] | None = None,
    position: str = "pos",
) -> DataFrame:
    """Exact 1-based position and inclusive running sums per group.

    ``order`` must end in a unique key: ties are kept together by the range
    partitioning, so the key is what lets a hot group be split.  ``sums`` maps an
    output column to the column that is accumulated.  Inputs of every size take this
    one path: the input is written once, so that sampling the range bounds does not
    run its plan a second time.
    """
    group, sums = list(group), dict(sums or {})
    keys = [F.col(g).asc() for g in group]
    ordered = materialize(df, "ordered").repartitionByRange(*keys, *order)
    sliced = materialize(ordered.withColumn(_SLICE, F.spark_partition_id()), "sliced")
    totals = sliced.groupBy(*group, _SLICE).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()]
    )
    # one row per (group, slice): at most slices + groups rows in all
    before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        _SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    inside = Window.partitionBy(*group, _SLICE).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.select(
        *df.columns,
        _SLICE,
        F.row_number().over(inside).alias("_p"),
        *[F.sum(src).over(upto).alias(f"_r_{out}") for out, src in sums.items()],
    )
    return local.join(offsets, [*group, _SLICE]).select(
        *df.columns,
        (F.col("_p") + F.col("_n0")).alias(position),
        *[(F.col(f"_r_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums],
    )


def along(
    df: DataFrame, group: Sequence[str], position: str, sums: dict[str, str], slice_rows: int = SLICE_ROWS, ties: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums per group in order of ``position``, whole numbers from 0 or 1 on without many gaps.

    The positions themselves say to which slice a row belongs, so one shuffle is enough:
    no sampling, no sort across slices, and nothing is written.  A position holds few rows
    at most, in order of ``ties``: reduce rows that share one before, or order them.
    """
    group = list(group)
    sliced = df.withColumn(_SLICE, F.floor(F.col(position) / slice_rows))
    totals = sliced.groupBy(*group, _SLICE).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    # one row per (group, slice)
    before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, _SLICE, *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums])
    inside = Window.partitionBy(*group, _SLICE).orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.select(*df.columns, _SLICE, *[F.sum(src).over(inside).alias(f"_r_{out}") for out, src in sums.items()])
    return local.join(offsets, [*group, _SLICE]).select(*df.columns, *[(F.col(f"_r_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums])


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``below`` (strictly smaller rows), ``upto`` and ``n``.

    Rows are reduced to (group, value, count) map-side first, so ties cost nothing.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    )
    ranked = running(counts, keys, [F.col(value).asc()], {"upto": "c"})
    if keys:
        sized = ranked.join(ranked.groupBy(*keys).agg(F.sum("c").alias("n")), keys)
    else:
        sized = ranked.withColumn("n", ranked.agg(F.sum("c").alias("n")).scalar())
    return sized.select(
        *keys, value, "c", (F.col("upto") - F.col("c")).alias("below"), "upto", "n"
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact grouped quantiles with linear interpolation, plus the group size ``n``.

    Groups of up to GROUP_ROWS values are handed to ``percentile``, which holds one group's
    values in a task.  In larger ones the two values that a quantile lies between are found by
    histogram refinement: per group BUCKETS mergeable counts, then again inside the bucket
    that holds the rank, until few rows or a single value are left.  Nothing is sorted over
    all rows, and a hot group is scanned like any other.  Null and NaN take no part.
    """
    keys, names = list(keys), list(probs)
    number = F.col(value).cast("double")
    rows = materialize(df.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_v"), F.lit(0).alias("_one")), "values")
    by = keys or ["_one"]
    sizes, seen = materialize_with(
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "group-sizes",
        large=F.count(F.when(F.col("n") > GROUP_ROWS, 1)),
    )
    large = sizes.where(F.col("n") > GROUP_ROWS)
    exact = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()]))
    small = rows if not seen["large"] else rows.join(large.select(*by), by, "left_anti")
    found = small.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), exact.alias("_q"))
    out = found.select(*keys, "n", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)])
    if not seen["large"]:
        return out
    at = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)]))
    wanted = large.select(*by, "n", "lo", "hi", F.explode(ranks).alias("rank"))
    values = _order_statistics(rows.join(large.select(*by), by, "left_semi"), by, wanted)
    known = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")).join(large.select(*by, "n"), by)

    def between(x: Column) -> Column:
        low, high = (F.element_at("_at", f(x).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (x - F.floor(x))

    return out.unionByName(known.select(*keys, "n", *[between(x).alias(name) for name, x in at.items()]))


def _order_statistics(rows: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, rank, value): the value at each 0-based rank of ``wanted`` (keys, n, lo, hi, rank)."""
    state = wanted.select(*by, "rank", F.col("rank").alias("left"), "lo", "hi", "n")
    done: list[DataFrame] = []
    while True:
        state, seen = materialize_with(state, "ranks", open=F.count(F.when((F.col("lo") < F.col("hi")) & (F.col("n") > GROUP_ROWS), 1)))
        done.append(state.where("lo = hi").select(*by, "rank", F.col("lo").alias("value")))
        few = state.where((F.col("lo") < F.col("hi")) & (F.col("n") <= GROUP_ROWS))
        near = rows.join(few, by).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        place = F.row_number().over(Window.partitionBy(*by, "rank").orderBy("_v")) - 1
        done.append(near.withColumn("_p", place).where(F.col("_p") == F.col("left")).select(*by, "rank", F.col("_v").alias("value")))
        if not seen["open"]:
            break
        open_ = state.where((F.col("lo") < F.col("hi")) & (F.col("n") > GROUP_ROWS))
        met = rows.join(open_, by).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves, so that the width of the widest range is a number too
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = met.groupBy(*by, "rank", "left", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        # at most BUCKETS rows per rank
        upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = counts.withColumn("_upto", upto).where((F.col("left") < F.col("_upto")) & (F.col("left") >= F.col("_upto") - F.col("n")))
        state = hit.select(*by, "rank", (F.col("left") - (F.col("_upto") - F.col("n"))).alias("left"), "lo", "hi", "n")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """First ``k`` rows per group.

    The rank filter is pushed below the shuffle (group-limit), so a task receives
    at most ``k`` rows per group and upstream task, however large the group is.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)
