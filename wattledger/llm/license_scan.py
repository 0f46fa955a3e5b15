"""License scan: lines of a text against licence templates by Dice coefficient of word bigrams.

A line and a template are compared as sets of adjacent word pairs, after lower-casing and
turning everything but letters and digits into blanks.  2 * common / (a + b) reaches
``percent`` only if the sizes are within percent / (200 - percent) of each other, so a line
meets only the templates whose size fits, and none unless it shares a bigram with any.
Everything is one projection over the row: no shuffle, and nothing outside the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short notices by which works name their licence (SPDX-style names).
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: least Dice coefficient, in percent
PERCENT = 80
#: templates are literals of the plan, so they are bounded
MOST_TEMPLATES, MOST_WORDS = 500, 500


def normal(text: Column) -> Column:
    """Lower-case text in which blanks part the words; only ASCII letters, digits and line ends stay."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9\\n]+", " "))


def words_of(line: Column) -> Column:
    """Words of a normalised line; one empty word if there is none."""
    return F.split(F.trim(line), " ")


def bigrams(words: Column) -> Column:
    """Distinct pairs of adjacent words; none for fewer than two words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def template_sets(spark: SparkSession, templates: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    """(license, bigrams) in code-point order of the names; bounded by MOST_TEMPLATES * MOST_WORDS."""
    if len(templates) > MOST_TEMPLATES or any(len(t.split()) > MOST_WORDS for t in templates.values()):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of {MOST_WORDS} words")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    return [(r["license"], r["bg"]) for r in rows.select("license", bigrams(words_of(normal(F.col("template")))).alias("bg")).orderBy("license").collect() if r["bg"]]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_lines, n_licensed, license, dice_permille, licenses.

    Every line is compared with every template.  A line names the template with the
    highest coefficient of at least ``percent`` (ties: the first name in code-point order);
    n_licensed counts such lines, ``license`` and dice_permille (rounded down) are those of
    the document's best line, ``licenses`` lists the distinct names, comma-joined in order.
    Null and empty texts have no lines; without a match license is null, the coefficient 0
    and the list empty.  Rows that repeat a doc_id, or have none, are reported row by row.
    An empty table gives an empty result; other columns are not read.
    """
    known = template_sets(docs.sparkSession, templates)
    sets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(len(bg)).alias("b"), F.array(*map(F.lit, bg)).alias("bg")) for i, (_, bg) in enumerate(known)])
    names = F.array(*[F.lit(name) for name, _ in known])
    every = F.array(*[F.lit(x) for x in sorted({x for _, bg in known for x in bg})])
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, bg in known for x in bg for w in x.split(" ")})])
    low, high = min(len(bg) for _, bg in known), max(len(bg) for _, bg in known)
    near = lambda a, b: (a * (200 - percent) >= b * percent) & (b * (200 - percent) >= a * percent)
    may_fit = lambda bg: (F.size(bg) * (200 - percent) >= low * percent) & (F.size(bg) * percent <= high * (200 - percent)) & F.arrays_overlap(bg, every)

    def worth_comparing(words: Column) -> Column:
        """False only for lines that no template can match, by their numbers of words alone.

        A match leaves at most (200 - 2 * percent) / (200 - percent) of a line's bigrams, and half as many
        as the largest template has, unshared; and every unknown word is in an unshared bigram, two
        words at most in one.
        """
        strange = F.size(F.array_except(words, vocabulary))
        most = F.size(words) - 1
        return (most * (200 - percent) >= low * percent) & (strange * (200 - percent) <= most * 2 * (200 - 2 * percent)) & (strange * percent <= high * 2 * (200 - 2 * percent))

    def best(bg: Column) -> Column:
        def score(t: Column) -> Column:
            common, sizes = F.size(F.array_intersect(bg, t["bg"])), F.size(bg) + t["b"]
            fits = near(F.size(bg), t["b"]) & (common * 200 >= sizes * percent)
            return F.when(fits, F.struct(F.floor(common * 2000 / sizes).cast("int").alias("permille"), (-t["i"]).alias("first")))

        return F.array_max(F.filter(F.transform(sets, score), lambda x: x.isNotNull()))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(F.split(text, "\n"), lambda line: line != "")).cast("long").alias("n_lines"), F.split(normal(text), "\n").alias("lines"))
    lines = own.select("doc_id", "n_lines", F.filter(F.transform("lines", words_of), worth_comparing).alias("lines"))
    compared = lines.select("doc_id", "n_lines", F.filter(F.transform("lines", bigrams), may_fit).alias("sets"))
    hits = compared.select("doc_id", "n_lines", F.filter(F.transform("sets", best), lambda x: x.isNotNull()).alias("hits"))
    name = lambda hit: F.element_at(names, (1 - hit["first"]).cast("int"))
    top = F.array_max("hits")
    return hits.select(
        "doc_id",
        "n_lines",
        F.size("hits").cast("long").alias("n_licensed"),
        F.when(F.size("hits") > 0, name(top)).alias("license"),
        F.coalesce(top["permille"], F.lit(0)).alias("dice_permille"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", name))), ",").alias("licenses"),
    )


def scan_sql(templates: Mapping[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in templates.items())
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    words = "list_filter(string_split(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    return f"""WITH t AS (SELECT license, {pairs} AS bg FROM (SELECT license, {words.format('template')} AS w FROM (VALUES {values}) AS v(license, template))),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  s AS (SELECT doc_id, row_number() OVER () AS nth, {pairs} AS bg FROM (SELECT doc_id, {words.format('line')} AS w FROM l WHERE line <> '')),
  c AS (SELECT doc_id, nth, license, len(list_intersect(s.bg, t.bg)) AS common, len(s.bg) + len(t.bg) AS sizes FROM s, t WHERE list_has_any(s.bg, t.bg)),
  h AS (SELECT doc_id, nth, license, common * 2000 // sizes AS permille FROM c WHERE common * 200 >= sizes * {percent}
    QUALIFY row_number() OVER (PARTITION BY nth ORDER BY common * 2000 // sizes DESC, license) = 1),
  d AS (SELECT doc_id, count(*) AS n_licensed, arg_min(license, (-permille, license)) AS license, max(permille) AS permille, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM h GROUP BY doc_id)
  SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_licensed, 0) AS n_licensed, license, CAST(coalesce(permille, 0) AS INTEGER) AS dice_permille, coalesce(licenses, '') AS licenses
  FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM l WHERE line <> '' GROUP BY doc_id) USING (doc_id) LEFT JOIN d USING (doc_id)"""
