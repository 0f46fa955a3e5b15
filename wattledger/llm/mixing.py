"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight; its target is its share of all words, cut at ``limit`` times
its own words, with the excess dealt to the others by weight (water filling).  A document
of a source with target / words = 2.3 is taken two times for certain, and once more with
inclusion probability 0.3: documents are ranked by their random odds divided by their
inclusion odds, and the first of them are taken as long as the source's words allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import WORD, own_columns
from wattledger.scale import running
from wattledger.session import materialize

#: weights of the sources in code-point order of their names, repeating
WEIGHTS = (5, 2, 1)
#: a source, and so a document, is taken this many times at most
LIMIT = 3
SEED = 20
#: a source that lacks less than this share of its target is not filled any further
CLOSE = 0.002


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``sources`` (source_key, source_size) with ``target``, in a constant number of passes.

    Sources are put in order of limit * size / weight; a source is cut exactly if the
    level that those before it leave is at or above its own ratio.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = running(sources, [], [F.col("source_key").asc()], position="nth").withColumn("weight", weight.cast("double"))
    ready = named.withColumn("most", F.col("source_size").cast("double") * limit)
    filled = running(ready.withColumn("ratio", F.col("most") / F.col("weight")), [], [F.col("ratio").asc(), F.col("source_key").asc()], {"most_upto": "most", "weight_upto": "weight"}, "at")
    filled = materialize(filled, "filled")
    whole = filled.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weights")).first()
    words, total = whole["words"] or 0.0, whole["weights"] or 0.0
    left_weight = F.lit(total) - (F.col("weight_upto") - F.col("weight"))
    left_words = F.lit(words) - (F.col("most_upto") - F.col("most"))
    cut = F.col("ratio") * left_weight <= left_words
    over = filled.where(cut).agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")).first()
    rest_words, rest_weight = words - (over["most"] or 0.0), total - (over["weight"] or 0.0)
    level = rest_words / rest_weight if rest_weight > 0 else 0.0
    return filled.select("source_key", "source_size", F.when(cut, F.col("most")).otherwise(F.least("most", F.col("weight") * level)).alias("target"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; small values are taken first.  Null where p is 0 or 1."""
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``copies`` is how often the mix takes the document (0 to ``limit``), ``taken`` its words
    with repeats.  A null text has size 0; a null source is a source of its own, last in
    order; documents without words take no part (copies 0).  Random numbers come from a
    hash of doc_id, so reruns agree; rows that repeat a doc_id are documents of their own
    that share one random number.  A source's words meet its target as nearly
    as its whole documents allow (see ``_extra_copies``).  An empty table gives an empty result; other columns are not read.
    """
    sizes = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            # "0" before "1": a null source stands last
            F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
            count_words(F.col("text").cast("string")).alias("size"),
        ),
        "sizes",
    )
    sources = targets(sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, limit)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    certain = F.least(F.floor(share), F.lit(limit))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    plan = sizes.join(sources, "source_key").withColumns({"certain": certain, "p": F.when(F.col("size") > 0, share - certain).otherwise(0.0)})
    # rows of one doc_id are told apart by their place, which matters to no result
    plan = materialize(plan.withColumns({"odds": pareto_rank(u, F.col("p")), "place": F.monotonically_increasing_id()}), "plan")
    extra = _extra_copies(plan)
    copies = F.when(F.col("size") > 0, F.least(F.col("certain") + F.coalesce(F.col("extra"), F.lit(0)), F.lit(limit))).otherwise(0)
    return plan.join(extra, "place", "left").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def _extra_copies(plan: DataFrame) -> DataFrame:
    """(place, extra = 1) of the documents that the sample takes once more.

    In Pareto order, as long as the words fit; where a long document ended the order early,
    the same again among those that still fit, until a source lacks less than CLOSE of its
    target or has none that fits; at last the one document nearest to what is lacking.
    """
    order = [F.col("odds").asc(), F.col("doc_id").asc(), F.col("place").asc()]
    gaps = plan.groupBy("source_key").agg(F.first("target").alias("target"), F.first(F.col("target") - F.col("certain") * F.col("source_size")).alias("gap"))
    left, taken = plan.where(F.col("odds").isNotNull()).select("source_key", "doc_id", "place", "size", "odds"), []
    gaps = materialize(gaps, "gaps")
    while True:
        fitting = left.join(gaps, "source_key").where((F.col("size") <= F.col("gap")) & ((F.col("gap") > CLOSE * F.col("target")) | F.lit(not taken)))
        ranked = materialize(running(fitting, ["source_key"], order, {"upto": "size"}, "rank"), "ranked")
        chosen = ranked.where(F.col("upto") <= F.col("gap"))
        sums = chosen.groupBy("source_key").agg(F.sum("size").alias("got"))
        taken.append(chosen.select("place"))
        gaps = materialize(gaps.join(sums, "source_key", "left").select("source_key", "target", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap")), "gaps")
        left = materialize(left.join(chosen.select("place"), "place", "left_anti"), "left")
        again = left.join(gaps, "source_key").where((F.col("size") <= F.col("gap")) & (F.col("gap") > CLOSE * F.col("target")))
        if again.isEmpty():
            break
    near = left.join(gaps, "source_key").where(F.col("size") < 2 * F.col("gap"))
    best = near.groupBy("source_key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "odds", "place")).alias("best")).select(F.col("best.place").alias("place"))
    out = best
    for part in taken:
        out = out.union(part)
    return out.withColumn("extra", F.lit(1))


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as they came.

    Rows without a doc_id or without words are in the mix zero times.
    """
    chosen = mix(docs).where((F.col("copies") > 0) & F.col("doc_id").isNotNull())
    plan = chosen.groupBy(F.col("doc_id").alias("__mix_id")).agg(F.min("copies").alias("__mix_copies"))
    times = F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_time")
    return docs.join(plan, F.col("doc_id") == F.col("__mix_id")).select(*own_columns(docs), times).drop("__mix_time")
