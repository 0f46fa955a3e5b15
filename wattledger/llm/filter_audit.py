"""How filters of a corpus overlap: what each removes in every order, and what it alone catches.

Five filters judge every text.  A row's failures become rows of (document, bit): those
that the text itself shows in one scan, and E (an earlier copy exists) from an existential
self-join on hash, exact text and smaller doc_id.  Their union is reduced to one bit
combination per document and to one count per part and combination; every order of the
filters is then read off those counts, so no order looks at a text again.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import WORD, marked, maybe_members

#: letters of the filters; a filter's bit is 1 << its position
FILTERS = "ABCDE"
#: limits of the filters
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
#: characters of which filter D allows none
MARKS = "[#$%&*|]"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the filters that a text fails by itself (``words``: its words)."""
    n = F.size(words)
    failing = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }
    return reduce(add, [F.when(test, bit(letter)).otherwise(0) for letter, test in failing.items()])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits, n: rows of ``docs`` (doc_id, text, lang) by the set of filters they fail.

    Null texts are empty, a null lang is the part ''.  E holds for a row whose text an
    other row with a smaller doc_id has; a null doc_id is neither smaller nor larger than
    any, so such rows never fail E nor make others fail it, and rows that repeat a doc_id
    do not fail E because of each other.  Other columns are not read; an empty table has
    no rows.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    ).withColumn("hash", F.md5(F.col("text").cast("binary")))
    shown = own.select("doc_id", "part", "hash", "text", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words")).select(
        "doc_id", "part", "hash", text_failures(F.col("text"), F.col("words")).alias("bits"), F.lit(1).cast("long").alias("n")
    )
    # only rows whose hash several doc_ids have are moved with their texts
    numbered = own.where("doc_id IS NOT NULL")
    sized = numbered.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = sized.where("least < most")
    # groups above the mean partition are dealt over as many salts as there are partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = shared.where(F.col("size") * parts > numbered.agg(F.count(F.lit(1))).scalar())
    suspects = marked(maybe_members(numbered, shared, "hash"), hot, "hash", "is_hot")
    salted = suspects.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(0))
    # one row for all copies of a text meets the join, once per salt
    earliest = suspects.groupBy("hash", "text", "is_hot").agg(F.min("doc_id").alias("earlier"))
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    later = earliest.select(F.col("hash").alias("h"), F.col("text").alias("t"), "earlier", F.explode(salts).alias("s"))
    same = (F.col("hash") == F.col("h")) & (F.col("text") == F.col("t")) & (F.col("salt") == F.col("s"))
    copies = salted.join(later, same & (F.col("earlier") < F.col("doc_id")), "left_semi")
    repeated = copies.select("doc_id", "part", "hash", F.lit(bit("E")).alias("bits"), F.lit(0).cast("long").alias("n"))
    # a document's rows meet by (doc_id, hash); what is alike is then one row per doc_id
    combined = shown.unionByName(repeated).groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return combined.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: documents, and those labelled good or toxic, by part and failed filters.

    Several labels of a document count if one of them says so.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    met = failed.join(known, F.col("doc_id") == F.col("labelled"), "left")

    def of(flag: str) -> Column:
        return F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0)))

    return met.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def orders() -> Column:
    """All steps of all orders: (filter_order, step, own bit, bits of the filters before)."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            steps.append((F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit(letter)).alias("own"), F.lit(before).alias("before")))
            before |= bit(letter)
    return F.array(*[F.struct(*s) for s in steps])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; zeros included.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley.  Of n filters that a document fails, each removes it in 1/n of the orders,
    so ``shapley`` needs no second look at the orders.
    """
    counts = combinations(failures(docs), labels)
    steps = counts.select("part", "bits", "n", "good", "toxic", F.explode(orders()).alias("s")).select("part", "bits", "n", "good", "toxic", "s.*")
    own = F.col("bits").bitwiseAND(F.col("own")) != 0
    clear = F.col("bits").bitwiseAND(F.col("before")) == 0
    removed = own & clear
    share = F.lit(factorial(len(FILTERS))).cast("long") * F.col("n") / F.bit_count("bits")

    def total(test: Column, value: Column | str = "n") -> Column:
        return F.sum(F.when(test, F.col(value) if isinstance(value, str) else value).otherwise(0))

    return steps.groupBy("part", "filter_order", "step").agg(
        total(~own & clear).alias("kept"),
        total(removed).alias("removed"),
        total(own & ~clear).alias("redundant"),
        total(F.col("bits") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(own, share.cast("long")).alias("shapley"),
    )


AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT d.doc_id, part,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS bits FROM d),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, bits),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l AS a, l AS b, l AS c, l AS d, l AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, CAST(1 << (ascii(filter_order[step]) - 65) AS BIGINT) AS own,
    coalesce(list_sum([1 << (ascii(y) - 65) for y in string_split(left(filter_order, step - 1), '') if y <> '']), 0)::BIGINT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN bits & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
