"""Depth-first numbers of a forest, and what they make cheap.

Every node gets the number at which a walk down the tree enters it and the last number
below it, so "u is above v" is a comparison of numbers: subtree sums are one running sum
and one lookup, marks of whole subtrees are a sweep over openings and closings, and the
nodes below a start are a range.  All of that takes the same few shuffles at any depth;
only the numbering itself climbs the tree, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattledger.scale import along
from wattledger.session import materialize

KEY = ["feeder_id", "node"]
#: buckets into which the children of a node are dealt before they are put in order
SIBLING_BUCKETS = 1024
#: numbers of one block of the range join
BLOCK = 1 << 12


def ladder_sum(levels: list[DataFrame], values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum over each node and everything below it, climbing the ancestor tables.

    Round k hands every partial sum to the ancestor 2^k up; one pass per level
    covers all depths because each depth has one binary expansion.
    """
    acc = values.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in columns])
    for level in levels:
        up = level.select(*KEY, "anc")
        targets = F.explode(F.array_compact(F.array("node", "anc"))).alias("to")
        spread = acc.join(up, KEY, "left").select("feeder_id", targets, *columns)
        acc = spread.groupBy("feeder_id", F.col("to").alias("node")).agg(*[F.sum(c).alias(c) for c in columns])
    return acc


def ladder_reduce(levels: list[DataFrame], node: DataFrame, values: DataFrame, reduced: dict) -> DataFrame:
    """Aggregates over each node of ``node`` and all its ancestors; ``values`` has one row per node or none.

    ``reduced`` maps columns to an aggregate function that may be applied in parts.
    """
    acc = values.select(*KEY, *reduced)
    for level in levels:
        # every node reads its own partial result and the one 2^k above it
        reads = node.select(*KEY).join(level.select(*KEY, "anc"), KEY, "left")
        reads = reads.select(*KEY, F.explode(F.array_compact(F.array("node", "anc"))).alias("at"))
        give = acc.withColumnRenamed("node", "at")
        acc = reads.join(give, ["feeder_id", "at"]).groupBy(*KEY).agg(*[f(c).alias(c) for c, f in reduced.items()])
    return acc


def number(roots: DataFrame, levels: list[DataFrame], parent: DataFrame) -> DataFrame:
    """(feeder_id, node, entry, last, depth): numbers 1, 2, ... within each feeder, written once.

    A node's place is its parent's plus what stands before it among its siblings; those
    offsets, summed along the path to the root, are the numbers.  Siblings are put in
    order within buckets, so a node with any number of children is no single group.
    Nodes without a root (on or behind a cycle) get no number.
    """
    rooted = roots.where(F.col("root").isNotNull()).select(*KEY, F.col("hops").alias("depth"))
    sizes = ladder_sum(levels, rooted.select(*KEY, F.lit(1).cast("long").alias("size")), ["size"])
    placed = sizes.join(parent.select(*KEY, "parent"), KEY, "left").withColumn("parent", F.coalesce("parent", F.lit("")))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)))
    family = ["feeder_id", "parent"]
    earlier = Window.partitionBy(*family, "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("inside", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    buckets = placed.groupBy(*family, "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy(*family).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.select(*family, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    offsets = inside.join(ahead, [*family, "bucket"]).select(*KEY, "size", (F.col("inside") + F.col("ahead") + 1).alias("entry"))
    offsets = materialize(offsets, "sibling-offsets")
    entries = ladder_reduce(levels, rooted, offsets, {"entry": F.sum})
    return materialize(
        entries.join(offsets.select(*KEY, "size"), KEY).join(rooted, KEY).select(*KEY, "entry", (F.col("entry") + F.col("size") - 1).alias("last"), "depth"),
        "intervals",
    )


def subtree_sum(intervals: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum over each node and everything below it, for nodes with a value at or below them.

    The running sum in walking order, read at the last number below a node, less what was
    there before the node.
    """
    mine = values.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_has"))
    names = [*columns, "_has"]
    own = intervals.select(*KEY, "entry", "last").join(mine, KEY, "left").select(*KEY, "entry", "last", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    upto = along(own, ["feeder_id"], "entry", {f"_upto_{c}": c for c in names})
    ends = upto.select("feeder_id", F.col("entry").alias("last"), *[F.col(f"_upto_{c}").alias(f"_end_{c}") for c in names])
    sums = upto.join(ends, ["feeder_id", "last"]).select(*KEY, *[(F.col(f"_end_{c}") - F.col(f"_upto_{c}") + F.col(c)).alias(c) for c in names])
    return sums.where(F.col("_has") > 0).drop("_has")


def inside(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``points`` (feeder_id, at, ...) whose number lies in any of ``ranges`` (feeder_id, first, last).

    One sweep: ranges open and close at numbers, and a running sum tells how many are open.
    However the ranges are nested, no range is paired with a point.
    """
    turns = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("d"))))
    turn = ranges.select("feeder_id", turns.alias("t")).select("feeder_id", "t.at", "t.d")
    asked = points.select("feeder_id", "at", F.lit(0).alias("d"))
    sums = turn.unionByName(asked).groupBy("feeder_id", "at").agg(F.sum("d").alias("d"))
    open_at = along(sums, ["feeder_id"], "at", {"open": "d"}).where("open > 0").select("feeder_id", "at")
    return points.join(open_at, ["feeder_id", "at"], "left_semi")


def holding(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``ranges`` (feeder_id, first, last, ...) that hold any of ``points`` (feeder_id, at), by counts up to both ends."""
    ends = ranges.select("feeder_id", F.explode(F.array(F.col("first") - 1, F.col("last"))).alias("at"), F.lit(0).alias("d"))
    sums = points.select("feeder_id", "at", F.lit(1).alias("d")).unionByName(ends).groupBy("feeder_id", "at").agg(F.sum("d").alias("d"))
    upto = along(sums, ["feeder_id"], "at", {"upto": "d"}).select("feeder_id", "at", "upto")
    low = upto.select("feeder_id", (F.col("at") + 1).alias("first"), F.col("upto").alias("_low"))
    high = upto.select("feeder_id", F.col("at").alias("last"), F.col("upto").alias("_high"))
    return ranges.join(low, ["feeder_id", "first"]).join(high, ["feeder_id", "last"]).where("_high > _low").select(*ranges.columns)


def below(intervals: DataFrame, starts: DataFrame) -> DataFrame:
    """(feeder_id, start, first, last, depth, n_below): what is below each start, as a range of numbers.

    One row per start, however much is below it and however the starts are nested.
    """
    at = intervals.select("feeder_id", F.col("node").alias("start"), "entry", "last", "depth")
    return starts.select("feeder_id", "start").join(at, ["feeder_id", "start"]).select(
        "feeder_id", "start", (F.col("entry") + 1).alias("first"), "last", "depth", (F.col("last") - F.col("entry")).alias("n_below")
    )


def members(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """(feeder_id, start, node, hops): the ranges of ``below`` written out, by a join on blocks of numbers.

    A range meets the blocks it touches, and inside a block only its own numbers; the rows
    that come out are the answer itself.
    """
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))
    touched = ranges.where("n_below > 0").select("feeder_id", "start", "first", "last", F.col("depth").alias("top"), F.explode(blocks).alias("block"))
    inside = intervals.select(*KEY, "entry", "depth", F.floor(F.col("entry") / BLOCK).alias("block"))
    met = touched.join(inside, ["feeder_id", "block"]).where(F.col("entry").between(F.col("first"), F.col("last")))
    return met.select("feeder_id", "start", "node", (F.col("depth") - F.col("top")).alias("hops"))
