"""Near-duplicate groups by a chosen-path similarity join.

A document is the set of its five-word shingles, and stands for all documents with the
same set.  It is put down several trees: on the first SPLITS levels a node names two
coordinates of the minhash sketch and the document goes on to the children of its values
at both, on the next TAIL levels it names one.  Two sets whose sketches agree at a share s
go on together with probability s per named coordinate.  All trees read one sketch, so
what a pair is missed with is averaged over the agreements of its sketches; ``trees``
gives the fewest trees that miss a pair at the threshold with at most MISSED.

* Every leaf links its members to its smallest one (a star, linear in the leaf).
* Members of leaves that confirmed links have not connected are compared exhaustively,
  each with all that share one of its rarest shingles: of any two sets of 85 %, each has
  a shared shingle among its 15 % rarest and one more (of 80 %, its 20 % rarest), so no
  link is missed, and copies with many changes of their own meet nobody, however large
  their family.  Before that, holders of a shingle meet a few of them, so that a family
  that links connect is not compared pair by pair.
* Every link is confirmed on the full sets.
"""

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattledger.llm import common
from wattledger.llm.components import components
from wattledger.session import materialize, materialize_with

SHINGLE = 5
#: links need 100 * common >= percent * union; this is the percent of op2
PERCENT = 85
#: coordinates of the sketch
SKETCH = 96
SPLITS, TAIL = 3, 3
#: most that a pair at the threshold may be missed with, by the trees and by its number of agreeing coordinates
MISSED, MISAGREED = 1e-7, 2e-8
#: holders of a shingle that all its holders are compared with in one turn; share by which a turn must lower the rows for another to follow
PIVOTS, FALL = 4, 0.1
#: length of the parity signature
BITS = 1024
#: bytes of text in one pass; a worker holds the sets of that much
PASS_BYTES = 1 << 18
#: words that a worker remembers the hashes of, some 10 MB
CACHE_WORDS = 1 << 16

_A, _C = common.constants(SKETCH, 1), common.constants(SKETCH, 2)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _agreements(percent: int) -> list[float]:
    """Probabilities that 0 to SKETCH coordinates agree for sets of this similarity."""
    s = percent / 100
    return [comb(SKETCH, n) * s**n * (1 - s) ** (SKETCH - n) for n in range(SKETCH + 1)]


def miss_rate(percent: int, n_trees: int) -> float:
    """Probability that sets of this similarity meet in no leaf, averaged over the agreements of their sketches."""

    def meet(s: float) -> float:
        met = s**TAIL
        for _ in range(SPLITS):
            met = 1 - (1 - s * met) ** 2
        return met

    return sum(p * (1 - meet(n / SKETCH)) ** n_trees for n, p in enumerate(_agreements(percent)))


def trees(percent: int) -> int:
    """The fewest trees that miss at most MISSED of the pairs at the threshold: 11 at 85, 18 at 80."""
    return next(n for n in range(1, 10_000) if miss_rate(percent, n) <= MISSED)


def least_agreeing(percent: int) -> int:
    """Pairs that agree on fewer coordinates are not compared (60 at 85, 53 at 80)."""
    below = np.cumsum(_agreements(percent))
    return int(np.searchsorted(below, MISAGREED, side="right"))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a sequence of word hashes."""
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    acc = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        acc = acc * _STEP + words[i : len(words) - size + 1 + i]
    return np.unique(common.mix(acc + np.uint64(size)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash sketches (int32) of non-empty sets."""
    if not sets:
        return np.empty((0, SKETCH), np.int32)
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SKETCH), np.int32)
    for j in range(SKETCH):
        out[:, j] = (np.minimum.reduceat((flat ^ _C[j]) * _A[j], starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """BITS / 64 numbers whose bits say which classes of shingle hashes are odd in number.

    The bits in which two sets differ are at most the shingles in which they do.
    """
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches):
    hashes = common.WordHashes(CACHE_WORDS)
    for batch in common.passes(batches, "text", PASS_BYTES):
        sets = [shingle_set(hashes.of(t.lower().split())) for t in common.texts(batch, "text")]
        drawn = iter(sketches([s for s in sets if len(s)]))
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([next(drawn) if len(s) else None for s in sets], pa.list_(pa.int32())),
            ],
            ["doc_id", "n_shingles", "set_hash", "sketch"],
        )
        del sets, drawn, digests
        common.give_back()


def _full_sets(batches):
    hashes = common.WordHashes(CACHE_WORDS)
    for batch in common.passes(batches, "text", PASS_BYTES):
        sets = [shingle_set(hashes.of(t.lower().split())).view(np.int64) for t in common.texts(batch, "text")]
        bits = [parity(s.view(np.uint64)) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "shingles", "bits"])
        del sets, bits
        common.give_back()


def _value(key: Column, nth: int) -> list[Column]:
    """The nth coordinate that a node names, and the sketch's value there; coordinates of one node differ."""
    step = SKETCH // max(2, TAIL)
    at = F.pmod(F.pmod(F.xxhash64(key, F.lit(nth)), F.lit(step)) + nth * step, F.lit(SKETCH)).cast("int")
    return [at, F.element_at("sketch", at + 1)]


def _leaves(members: DataFrame, n_trees: int) -> DataFrame:
    """(key, id): every leaf that a member (id, sketch) reaches, in all trees."""
    nodes = members.select("id", "sketch", F.explode(F.array(*[F.xxhash64(F.lit(t), F.lit("tree")) for t in range(n_trees)])).alias("key"))
    for _ in range(SPLITS):
        nodes = nodes.select("id", "sketch", F.explode(F.array(*[F.xxhash64("key", *_value(F.col("key"), i)) for i in range(2)])).alias("key"))
    tail = [x for i in range(TAIL) for x in _value(F.col("key"), i)]
    return nodes.select(F.xxhash64("key", *tail).alias("key"), "id")


def _confirmed(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that are links, by agreement of the sketches and then the full sets."""
    left = members.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    right = members.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    agreeing = F.size(F.filter(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), lambda same: same))
    near = materialize(pairs.join(left, "a").join(right, "b").where(agreeing >= least_agreeing(percent)).select("a", "b"), "near")
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    full = full.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = F.size("set_a") + F.size("set_b")
    counted = full.select("a", "b", both.alias("both"), F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("common"))
    return materialize(counted.where(F.col("common") * 100 >= (F.col("both") - F.col("common")) * percent).select("a", "b"), "confirmed")


def _open_members(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the members of leaves whose members are not all connected yet."""
    labelled = leaves.join(labels.select("id", F.col("label").alias("known")), "id", "left").select("key", "id", F.coalesce("known", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("key")
    return materialize(labelled.join(mixed, "key").select("id", "label").distinct(), "open")


def _rare(open_members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(shingle, id, label, n, bits), and their number: the rarest (100 - percent) % + 1 shingles of each member that a member of another label holds as such too."""
    each = sets.join(open_members, "id").select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > 1)
    held = each.join(often, "shingle")
    mine = Window.partitionBy("id")
    # shingles of one document alone come first in its order and meet nobody
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - (F.col("n") - F.col("shared"))
    ranked = held.withColumns({"nth": F.row_number().over(mine.orderBy("often", "shingle")), "shared": F.count(F.lit(1)).over(mine)})
    rare = materialize(ranked.where(F.col("nth") <= first).select("shingle", "id", "label", "n"), "rare")
    shared, seen = materialize_with(_several(rare).join(sets.select("id", "bits"), "id"), "rare-shared", n=F.count(F.lit(1)))
    return shared.select("shingle", "id", "label", "n", "bits"), seen["n"]


def _several(rare: DataFrame) -> DataFrame:
    """The rows whose shingle has several labels."""
    several = rare.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("shingle")
    return rare.join(several, "shingle")


def _may_link(percent: int) -> Column:
    """Whether sides a and b have different labels, and sizes and parities that allow a link."""
    differing = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get("bits_a", F.lit(0)).bitwiseXOR(F.get("bits_b", F.lit(0)))))
    alike = differing * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    return (F.col("label_a") != F.col("label_b")) & sizes & alike


def _side(rare: DataFrame, name: str) -> DataFrame:
    return rare.select("shingle", F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("label", "n", "bits")])


def _to_pivots(rare: DataFrame, turn: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of the holders of each shingle with PIVOTS of them, drawn anew each turn: linear in the rows."""
    drawn = F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(turn * PIVOTS + i)).alias("draw"), F.col("id").alias("id"))) for i in range(PIVOTS)])
    pivots = rare.groupBy("shingle").agg(drawn.alias("p")).select("shingle", F.explode(F.array_distinct("p.id")).alias("id"))
    pairs = _side(rare.join(pivots, ["shingle", "id"]), "a").join(_side(rare, "b"), "shingle").where(_may_link(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _union(parts: list[DataFrame], out: DataFrame) -> DataFrame:
    for part in parts:
        out = out.unionByName(part)
    return out


def _across(open_members: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all open members of different labels that links connect.

    First, turn by turn, holders of a shingle meet a few of them, and those that links connect
    take one label, so that a large family of near copies is few labels, or one, before all
    pairs of different labels are compared; the turns decide on the work, not on the result.
    """
    rare, before = _rare(open_members, sets, percent)
    links: list[DataFrame] = []
    turn, falls = 0, before > 0
    while falls:
        found = _confirmed(_to_pivots(rare, turn, percent), members, sets, percent)
        if found.isEmpty():
            break
        links.append(found)
        known = rare.select("id", "label").distinct()
        by_label = found.join(known.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(known.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        merged = components(by_label.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("to"))
        rare = rare.join(merged, "label", "left").select("shingle", "id", F.coalesce("to", "label").alias("label"), "n", "bits")
        rare, seen = materialize_with(_several(materialize(rare, "rare-merged")), "rare-open", n=F.count(F.lit(1)))
        turn, falls, before = turn + 1, 0 < seen["n"] <= before * (1 - FALL), seen["n"]
    if not before:
        return _union(links, open_members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    rest = _side(rare, "a").join(_side(rare, "b"), "shingle").where((F.col("a") < F.col("b")) & _may_link(percent)).select("a", "b").distinct()
    return _union(links, _confirmed(rest, members, sets, percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are linked whose sets share at least ``percent`` (1 to 100) of their union.
    Words are cut at ASCII white space after lower-casing A-Z.  component_id is the
    smallest doc_id that links reach; ``kept`` marks that document.  A doc_id stands for one text.
    A text of one to four words is one shingle; a null or empty one has none and is linked
    with nothing.  Rows that repeat a doc_id share component and verdict if their texts do; a row without
    doc_id has no component and is kept.  An empty table gives an empty result; other
    columns are not read.
    """
    n_trees = trees(percent)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = materialize(own.mapInArrow(_sets, "doc_id long, n_shingles long, set_hash binary, sketch array<int>"), "sketches")
    classes = drawn.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_hash").agg(F.min("doc_id").alias("id"))
    classes = materialize(classes, "classes")
    members = drawn.join(classes.select(F.col("id").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"]).select(F.col("doc_id").alias("id"), "sketch").dropDuplicates(["id"])
    members = materialize(members, "members")

    leads = _leaves(members, n_trees).groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where(F.col("lead") < F.col("last"))
    leads = materialize(leads.select("key", "lead"), "leads")
    leaves = materialize(common.maybe_members(_leaves(members, n_trees), leads, "key").join(leads, "key"), "leaves")
    inside = leaves.select("id").distinct().select(F.col("id").alias("doc_id"))
    # repeated rows go before the sets are made, in the shuffle that looked up the doc_ids: sets are larger than texts
    texts = common.only_members(own, inside, "doc_id").dropDuplicates(["doc_id"])
    sets = materialize(texts.mapInArrow(_full_sets, "doc_id long, shingles array<long>, bits array<long>").withColumnRenamed("doc_id", "id"), "sets")

    stars = leaves.where(F.col("lead") < F.col("id")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(stars, members, sets, percent)
    open_members = _open_members(leaves.select("key", "id"), components(links))
    labels = components(links.union(_across(open_members, members, sets, percent)))

    rep = drawn.join(classes, "set_hash", "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("id")).alias("id"))
    named = rep.join(labels, "id", "left").select("doc_id", "n_shingles", F.coalesce("label", "id", "doc_id").alias("component_id"))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest doc_id of every group of near copies, all columns as they came.

    A doc_id that stands for several texts, or none, cannot name a row: such rows stay,
    and no other is dropped because of them.
    """
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    several = docs.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low < high").select("doc_id")
    several = materialize(several, "several-texts")
    clear = docs if several.isEmpty() else common.without_members(docs, several, "doc_id")
    verdicts = materialize(near_duplicates(clear, percent), "near")
    return common.without_members(docs, verdicts.where(~F.col("kept")).select("doc_id"), "doc_id")
