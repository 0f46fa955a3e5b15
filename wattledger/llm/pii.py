"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

Base spans come from four fixed patterns with their checks.  They are the seeds: a mention
(anything that looks like an identifier) is labelled if a base span overlaps it.  Lexical
patterns are the words left and right of a mention.  Patterns and mentions' values form a
bipartite graph; a pattern's score for a kind is the share of its values that have the
kind, a value's score that of its best pattern, and the two are computed in turn.  Values
of a high score are identifiers that the base patterns did not know; their mentions are
added as spans.

Everything is built from column functions; the graph holds distinct (pattern, value)
pairs, so copies of a document count once, and joins have one side with unique keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Possessive forms and the start conditions (a run's first
# character, or where the last match ended) match the same text as the plain patterns
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+
#   \+[0-9][\x20().0-9-]+[0-9]
# but never read a long run again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what looks like an identifier: a run of seven digits or more with separators, or a word around an at sign
NUMBER_LIKE = r"[+(]?[0-9][0-9().\x20-]{5,}[0-9]"
MAIL_LIKE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?(?:@|\(at\)|\[at\])[^\x20\x09-\x0D]*+"
LEAST_DIGITS = 7
#: characters of context that are looked at on either side
CONTEXT = 40
#: rounds of scoring, values a pattern must share with seeds, what its count is smoothed by, and the least score of a new value
ROUNDS, LEAST_SEEDS, SMOOTHING, LEAST_SCORE = 3, 5, 0.5, 0.85

_SPAN = "array<struct<start:int,end:int,surface:string,left:string,right:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _card(match: Column) -> Column:
    digits = _digits(match)
    right_to_left = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(right_to_left, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") < 5, c.cast("int") * 2).otherwise(c.cast("int") * 2 - 9))
    sound = F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0
    return F.when(F.length(digits).between(13, 19), sound).otherwise(False)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


CHECKS: dict[str, Callable[[Column], Column]] = {"email": lambda m: F.lit(True), "ip": _ip, "card": _card, "phone": _phone}


def occurrences(text: Column, pattern: str, check: Callable[[Column], Column]) -> Column:
    """Matches that pass the check, with code-point positions and their surroundings.

    Positions are the running lengths of what lies between matches; texts without a good
    match are not split.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.zip_with(
        F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(m.alias("m"), b.alias("before"))),
        F.slice(between, 2, F.size(matches)),
        lambda x, after: F.struct(x["m"].alias("m"), x["before"].alias("before"), after.alias("after")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        found = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("surface"), F.substring(x["before"], -CONTEXT, CONTEXT).alias("left"), F.substring(x["after"], 1, CONTEXT).alias("right"))
        return F.struct(end.alias("at"), F.when(check(x["m"]), F.array_append(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    return F.when(F.exists(matches, check), F.aggregate(rows, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(_SPAN))


def _word(context: Column, last: bool) -> Column:
    """The context's word next to the mention, lower-case, without punctuation at its ends."""
    words = F.filter(F.split(context, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    word = F.get(words, F.size(words) - 1 if last else F.lit(0))
    return F.lower(F.regexp_replace(F.coalesce(word, F.lit("")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, the base spans by kind, mentions), one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    text = F.col("text")
    marks = {"email": text.contains("@"), "phone": text.contains("+")}
    nothing = F.array().cast(_SPAN)
    found = {}
    for kind in KINDS:
        hits = occurrences(text, PATTERNS[kind], CHECKS[kind])
        found[kind] = F.when(marks[kind], hits).otherwise(nothing) if kind in marks else hits
    numbers = occurrences(text, NUMBER_LIKE, lambda m: F.length(_digits(m)) >= LEAST_DIGITS)
    at = text.contains("@") | text.contains("(at)") | text.contains("[at]")
    mails = F.when(at, occurrences(text, MAIL_LIKE, lambda m: F.lit(True))).otherwise(nothing)
    scanned = own.select("doc_id", *[c.alias(k) for k, c in found.items()], F.concat(numbers, mails).alias("mentions"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return materialize(scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[bare(F.col(k)).alias(k) for k in KINDS], "mentions"), "scan")


def _mentions(scan: DataFrame) -> DataFrame:
    """(row, start, end, value, label, patterns): label is the kind of a base span that overlaps, or null."""
    each = scan.where(F.size("mentions") > 0).select("row", *KINDS, F.explode("mentions").alias("m"))
    label = F.lit(None).cast("int")
    for i, kind in reversed(list(enumerate(KINDS))):
        label = F.when(F.exists(kind, lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start"))), i).otherwise(label)
    digits = _digits(F.col("m.surface"))
    value = F.when(F.col("m.surface").rlike("@|[(\\[]at[)\\]]"), F.lower("m.surface")).otherwise(digits)
    left, right = _word(F.col("m.left"), True), _word(F.col("m.right"), False)
    patterns = F.array(F.concat(F.lit("l:"), left), F.concat(F.lit("r:"), right), F.concat(F.lit("b:"), left, F.lit(" "), right))
    return materialize(each.select("row", F.col("m.start").alias("start"), F.col("m.end").alias("end"), value.alias("value"), label.alias("label"), patterns.alias("patterns")), "mentions")


def discovered(mentions: DataFrame) -> DataFrame:
    """(value, kind) of unseen values that high-confidence patterns name."""
    seeds = mentions.groupBy("value").agg(F.max("label").alias("kind"))
    seeds = materialize(seeds, "values")
    graph = materialize(mentions.select("value", F.explode("patterns").alias("pattern")).distinct(), "graph")
    sizes = materialize(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "sizes")
    known = seeds.where(F.col("kind").isNotNull()).withColumn("score", F.lit(1.0))
    unseen = seeds.where(F.col("kind").isNull()).select("value")
    scores = known
    for _ in range(ROUNDS):
        mass = graph.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        share = F.col("mass") / (F.col("n") + SMOOTHING)
        good = mass.where(F.col("mass") >= LEAST_SEEDS).join(sizes, "pattern").select("pattern", "kind", share.alias("score")).where(share >= LEAST_SCORE)
        best = graph.join(unseen, "value", "left_semi").join(good, "pattern").groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("b"))
        scores = materialize(known.unionByName(best.select("value", (-F.col("b.kind")).alias("kind"), F.col("b.score").alias("score"))), "scores")
    return scores.where(F.col("score") < 1).select("value", "kind")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and found (arrays of kind, start, end).

    Positions are code points, the end exclusive; both arrays are ordered by kind as in
    KINDS, then start.  ``base`` holds the matches of the base patterns that pass their
    checks, ``found`` these and the discovered ones.  Null and empty texts have none.
    Rows may repeat and doc_ids be null: every row is judged by itself.  An empty table
    gives an empty result; other columns are not read.
    """
    scan = _scan(docs)
    mentions = _mentions(scan)
    named = mentions.where(F.col("label").isNull()).join(discovered(mentions), "value")
    extra = named.groupBy("row").agg(F.collect_set(F.struct(F.col("kind").alias("kind"), "start", "end")).alias("extra"))

    def tagged(i: int) -> Column:
        return F.transform(F.col(KINDS[i]), lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(*map(tagged, range(len(KINDS))))
    rows = scan.select("row", "doc_id", base.alias("base")).join(extra, "row", "left")
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("found"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    names = F.array(*map(F.lit, KINDS))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return find(docs).select("doc_id", *map(count, range(len(KINDS))), F.sha2(written("base"), 256).alias("base_sha256"), written("found").alias("spans"))
