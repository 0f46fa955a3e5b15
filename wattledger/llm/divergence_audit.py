"""How the word use of sources differs: exact divergences of all pairs of a language's sources.

Terms get numbers, the commonest first.  For every group and every count, a bitmap over
the numbers tells which terms occur that often in the group; it is stored in words of 64
numbers, and only words that hold a term.  For two groups, AND and popcount of two words
say how many terms occur c times here and d times there: those cells carry the whole
divergence, since all terms of one cell add the same value.  Cells with a zero count are
the complement: what a level holds minus its cells with the other group's levels.

Neighbours in the numbering are about equally common, so a word of rare terms meets very
few levels, and a word of common ones 64 at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm import common
from wattledger.scale import running, top_rows
from wattledger.session import materialize

#: documents of its language that a term needs
LEAST_DOCS = 10
#: ranks of the part ``term``
TOP_TERMS = 10
#: probabilities are counted in units of 1 / SCALE
SCALE = 1_000_000_000
#: terms that a task adds up before it hands them on
HELD_TERMS = 200_000

#: A-Z lower-cased, every other ASCII byte but a-z a blank: what split() then leaves are the terms
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _schema() -> pa.Schema:
    return pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            totals = list(terms.values())
            columns = [pa.array([v] * len(terms), pa.string()) for v in (lang, source)]
            columns.append(pa.array(list(terms), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([t[i] for t in totals], pa.int64()) for i in (0, 1)]], schema=_schema())
        held.clear()

    size = 0
    for batch in common.passes(batches, "text"):
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for group, raw in zip(groups, common.texts(batch, "text")):
            terms = held.setdefault(group, {})
            before = len(terms)
            for term, n in Counter(raw.translate(_LETTERS).split()).items():
                total = terms.get(term)
                if total is None:
                    terms[term] = [n, 1]
                else:
                    total[0] += n
                    total[1] += 1
            size += len(terms) - before
        if size > HELD_TERMS:
            yield from flush()
            size = 0
    yield from flush()


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group and the documents that hold it."""
    counted = texts_of(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _odds(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals: exact for counts of any size."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 2)
    return (F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")) + 1).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for every pair of sources of a language and for each source's own terms.

    Null text, lang and source count as ''.  Repeated rows count as often as they stand;
    doc_id is not used, and other columns are not read.  A language without kept terms has
    pairs of value 0 and no terms; a source alone in its language has no pairs; an empty
    table has no rows.
    """
    counts = materialize(term_counts(docs), "term-counts")
    groups = materialize(texts_of(docs).select("lang", "source").distinct(), "groups")
    per_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    numbered = running(per_lang.select("lang", "term", "n"), ["lang"], [F.col("n").desc(), F.col("term")], position="number")
    kept = materialize(numbered.select("lang", "term", (F.col("number") - 1).alias("number"), F.col("n").alias("lang_n")), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "number", "lang_n"), "own-terms")
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = materialize(
        groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total", "total")])
        .withColumn("zero", F.when(F.col("terms") > 0, _odds(F.lit(0), F.col("total"), F.col("terms")))),
        "sized",
    )
    return _pairs(own, sized).unionByName(_terms(own, sized))


def levels(own: DataFrame, sized: DataFrame) -> DataFrame:
    """lang, source, word, n, bits, p, zero: the bitmaps, with the odds of their count and of a zero count."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))).alias("bits")
    maps = own.groupBy("lang", "source", F.floor(F.col("number") / 64).alias("word"), "n").agg(bits)
    return maps.join(sized.select("lang", "source", "terms", "total", "zero"), ["lang", "source"]).select(
        "lang", "source", "word", "bits", _odds(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "zero"
    )


def _pairs(own: DataFrame, sized: DataFrame) -> DataFrame:
    maps = materialize(levels(own, sized), "bitmaps")
    left = maps.select("lang", "word", F.col("source").alias("a"), F.col("bits").alias("bits_a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    right = maps.select("lang", "word", F.col("source").alias("b"), F.col("bits").alias("bits_b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    cell = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))
    # a term of cell (c, d) was counted as (c, 0), (0, d) and not as (0, 0) by the complement below
    correction = _gap(F.col("p_a"), F.col("p_b")) - _gap(F.col("p_a"), F.col("zero_b")) - _gap(F.col("zero_a"), F.col("p_b")) + _gap(F.col("zero_a"), F.col("zero_b"))
    both = left.join(right, ["lang", "word"]).where((F.col("a") < F.col("b")) & (cell > 0)).select("lang", "a", "b", (cell * correction).alias("value"))

    # every level against the other group's zero, as if no term were shared
    level = maps.groupBy("lang", "source", "p", "zero").agg(F.sum(F.bit_count("bits")).alias("held"))
    others = sized.where("terms > 0").select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other"))
    alone = level.join(others, "lang").where(F.col("source") != F.col("other"))
    one_sided = alone.select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        (F.col("held") * (_gap(F.col("p"), F.col("zero_other")) - _gap(F.col("zero"), F.col("zero_other")))).alias("value"),
    )
    first = sized.select("lang", F.col("source").alias("a"), "terms", F.col("zero").alias("zero_a"))
    second = sized.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    none = first.join(second, "lang").where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * _gap(F.col("zero_a"), F.col("zero_b"))).otherwise(0).alias("value")
    )
    total = both.unionByName(one_sided).unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = total.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    # one row per source of the language: the size of the answer itself
    return _ranked(rows, None)


def _terms(own: DataFrame, sized: DataFrame) -> DataFrame:
    p = _odds(F.col("n"), F.col("total"), F.col("terms"))
    q = _odds(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    met = own.join(sized, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return _ranked(met.where("p > q").select("lang", "source", "part", "item", _gap(F.col("p"), F.col("q")).alias("value")), TOP_TERMS)


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    order = [F.col("value").desc(), F.col("item")]
    keys = ["lang", "source"]
    if most is not None:
        ranked = top_rows(rows, keys, order, most, "rank")
    else:
        ranked = running(rows, keys, order, position="rank")
    return ranked.select(*keys, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 10"""
