"""Overlap of filters and divergences of sources against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from helpers import clashing, empty, prose

from wattledger.llm import divergence_audit, filter_audit

LABELS = "doc_id long, quality int, toxic int"
SCHEMA = "doc_id long, text string, lang string, source string"
WORD = r"[^\x20\x09-\x0D]+"


def fails(rows, n):
    doc_id, text, *_ = rows[n]
    text = text or ""
    words = re.findall(WORD, text)
    earlier = any((t or "") == text and d is not None and doc_id is not None and d < doc_id for d, t, *_ in rows)
    tests = {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search("[#$%&*|]", text) is not None, "E": earlier,
    }
    return {k for k, bad in tests.items() if bad}


def brute_filters(rows, labels):
    out = {}
    failed = [fails(rows, n) for n in range(len(rows))]
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        removed_in_all = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                removed_in_all[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = removed_in_all[row[-1]] if isinstance(row[-1], str) else row[-1]
    return out


def awkward(rng):
    plain = [prose(rng, rng.choice((0, 3, 90, 120, 160))) for _ in range(25)]
    distinct = [" ".join(f"w{n}-{i}" for i in range(rng.choice((99, 100, 130)))) for n in range(10)]
    texts = [*plain, *distinct, "", None, " \t", "ABCDEFGHIJ k", "a # b", distinct[0] + " |", "É" * 9 + "A", "x" * 30_000, "a\x1cb"]
    texts += [distinct[1], distinct[1], plain[0], None, "", distinct[1].upper()]
    rng.shuffle(texts)
    return texts


def audited(spark, rows, labels):
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    got = filter_audit.audit(docs, clashing(spark.createDataFrame(labels, LABELS))).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}, len(got)


def test_filter_orders(spark):
    rng = random.Random(5)
    rows = [(n * 3 % 71, t, rng.choice(("en", "de", None)), "s") for n, t in enumerate(awkward(rng))]
    labels = [(n, rng.choice((0, 1, None)), rng.choice((0, 1))) for n in range(0, 71, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    got, n = audited(spark, rows, labels)
    assert n == len(got) and got == brute_filters(rows, labels)


def test_filter_ids_null_and_repeated(spark):
    long = " ".join(f"v{i}" for i in range(100))
    rows = [(None, long, "en", "s"), (None, long, "en", "s"), (5, long, "en", "s"), (5, long, "de", "s"), (6, long, None, "s"), (5, "x", "en", "s")]
    got, _ = audited(spark, rows, [(5, 1, 0), (6, 1, 1)])
    assert got == brute_filters(rows, [(5, 1, 0), (6, 1, 1)])
    # a hot group of copies is dealt over salts
    many = [(n, long, "en", "s") for n in range(300)] + [(1000 + n, f"{long} {n}", "en", "s") for n in range(50)]
    got, _ = audited(spark, many, [(n, 1, n % 2) for n in range(0, 400, 7)])
    assert got == brute_filters(many, [(n, 1, n % 2) for n in range(0, 400, 7)])
    assert filter_audit.audit(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def brute_divergences(rows, least=10, top=10):
    terms = [[re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")] for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, _, lang, source), ts in zip(rows, terms):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(ts))
        counts[lang, source].update(ts)
    out = []

    def rank(lang, source, part, values, most=None):
        ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
        out.extend((lang, source, part, item, value, n) for n, (item, value) in enumerate(ordered, 1))

    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def odds(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: odds(counts[lang, s]) for s in sources}
        q = odds(whole)
        for s in sources:
            rank(lang, s, "pair", [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s])
            rank(lang, s, "term", [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]], top)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_divergences(spark, seed, monkeypatch):
    monkeypatch.setattr(divergence_audit, "HELD_TERMS", 15)
    rng = random.Random(seed)
    stock = [f"{a}{b}" for a in ("stone", "Éa", "日本", "x", "ß") for b in ("", "a", "Bc", "Z", "ü")] + ["rare1", "1", "#", " "]
    rows = []
    for n in range(260):
        lang, source = rng.choice(("en", "en", "de", None)), rng.choice(("a", "a", "a", "b", "c", None))
        text = None if n % 40 == 0 else rng.choice((" ", "-", "1")).join(rng.choice(stock[: rng.randrange(1, len(stock))]) for _ in range(rng.choice((0, 1, 8, 60))))
        rows.append((n, text, lang, source))
    rows += [(900 + n, "only few", "fr", f"s{n % 3}") for n in range(5)] + [(950, "word", "it", "s"), (951, None, "en", "empty"), (7, "stone", "en", "a"), (7, "stone", "en", "a")]
    rows += [(None, "zz " * 40_000, "en", "b")] + [(970 + n, "zz yy", "en", "b") for n in range(9)]
    got = divergence_audit.audit(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_divergences(rows))


def test_divergences_of_large_counts_and_empty_table(spark):
    n, total = 20_000_000_000, 90_000_000_001
    row = spark.createDataFrame([(n, total, 7)], "n long, total long, terms long")
    got = row.select(divergence_audit._odds(row.n, row.total, row.terms).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 14)
    assert divergence_audit.audit(empty(spark)).count() == 0
