"""Exact, near and substring dedup against brute force, with awkward rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from helpers import clashing, documents, empty, prose

from wattledger.llm import exact_dedup, near_dedup, substring_dedup
from wattledger.llm.components import components

SF = "/root/testdata/sf0.001"


def sf_documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


# --- exact ---------------------------------------------------------------------


def test_rice_code_round_trip():
    rng = np.random.default_rng(3)
    for n, span in ((0, 10), (1, 1 << 62), (5, 5), (1000, 1 << 60)):
        values = np.unique(rng.integers(0, span, n, dtype=np.uint64))
        k, unary, rest = exact_dedup.rice_encode(values, span)
        assert (exact_dedup.rice_decode(len(values), k, unary, rest) == values).all()


def test_exact_groups(spark):
    texts = ["A b", "a B", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "solo"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, texts).repartition(3)).collect()}
    keep = {0: 1, 1: 1, 2: 3, 3: 3, 4: 4, 5: 5, 6: 7, 7: 7, 8: 8}
    assert {i: r.keep_id for i, r in got.items()} == keep
    assert all(r.kept == (i == keep[i]) for i, r in got.items())
    assert got[0].group_size == 2 and got[8].group_size == 1
    assert got[0].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_exact_hot_group(spark):
    df = documents(spark, ["same text"] * 900 + [f"other {i}" for i in range(300)]).repartition(7)
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in got) == 301
    assert {r.group_size for r in got if r.doc_id < 900} == {900}
    assert {r.keep_id for r in got if r.doc_id < 900} == {899}


def test_exact_repeats_nulls_and_empty_table(spark):
    df = clashing(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id long, text string"))
    kept = sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(df).collect())
    assert kept == [("1", "a"), ("2", "c"), ("None", "a"), ("None", "b")]
    assert exact_dedup.drop_copies(df).columns == df.columns
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# --- near ----------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}


def test_near_matches_brute_force_on_documents(spark):
    rows = sf_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(df) == brute_components(rows)


def test_near_links_at_the_threshold_and_chains(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(25):  # a chain: each copy changes a little more, so its ends are far apart
        texts.append(" ".join(base))
        at = rng.randrange(len(base))
        base[at : at + 3] = [f"v{rng.randrange(10**6)}" for _ in range(3)]
    # 46 and 45 shared shingles of 54 and 53: just at and just below 85 %
    for cut in range(4, 12):
        words = [f"c{cut}_{i}" for i in range(54)]
        texts += [" ".join(words), " ".join(words[: 54 - cut] + [f"d{cut}_{i}" for i in range(cut)])]
    rows = list(enumerate(texts))
    assert near_rows(documents(spark, texts)) == brute_components(rows)


def test_near_many_copies_of_one_text(spark):
    """A family in which some copies are linked, some by way of others, and some not at all."""

    rng = random.Random(5)
    base = prose(rng, 300).split()
    texts = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(300)] = f"n{rng.randrange(50)}"
        texts.append(" ".join(copy))
    texts += [prose(rng, 60) for _ in range(40)]
    assert near_rows(documents(spark, texts)) == brute_components(list(enumerate(texts)))


def test_near_awkward_rows(spark):
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "long " * 50_000), (6, "long " * 50_000), (None, "one two"), (7, "long " * 40_000)], "doc_id long, text string"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6]
    assert got[1].n_shingles == 0 and got[4].n_shingles == 1 and got[6].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "6", "None"]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(3000, 3001), (3001, 3002), (3002, 3000)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and {got[i] for i in (3000, 3001, 3002)} == {3000}


# --- passages ------------------------------------------------------------------


def brute_passages(rows, window=50):
    first, out = {}, {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        own = []
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if first.get(run, doc) < doc:
                gone[i : i + window] = [True] * window
            own.append(run)
        for run in own:
            first.setdefault(run, doc)
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def passage_rows(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(df).collect()}


def test_grams_name_runs():
    words = np.arange(200, dtype=np.uint64) % 7
    for size in (1, 2, 3, 16, 50):
        names = {}
        for i, h in enumerate(substring_dedup.grams(words, size)):
            names.setdefault(tuple(words[i : i + size]), set()).add(int(h))
        assert all(len(h) == 1 for h in names.values()) and len(set.union(*names.values())) == len(names)


def test_passages_match_brute_force_on_documents(spark):
    rows = sf_documents()
    assert passage_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_passages(rows)


def test_passages_shared_by_many_and_repeated_within(spark):
    rng = random.Random(9)
    shared = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(80):
        words = [f"u{i}_{j}" for j in range(rng.randrange(0, 40))]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + shared[rng.randrange(3) : 60 - rng.randrange(12)] + words[at:]))
    texts += ["z " * 120, "z " * 70, " ".join(shared), " ".join(shared), " ".join(shared[:49]), " ".join(shared[:49]), None, "", "y " * 60]
    rows = list(enumerate(texts))
    assert passage_rows(documents(spark, texts).repartition(5)) == brute_passages(rows)


def test_passage_nodes_cut_between_groups(spark, monkeypatch):
    """One passage in most documents: its node is spread over several groups and completed."""
    monkeypatch.setattr(substring_dedup, "GROUP", 40)
    shared = " ".join(f"p{i}" for i in range(52))
    texts = [shared + f" tail{i}" for i in range(150)]
    assert passage_rows(documents(spark, texts)) == brute_passages(list(enumerate(texts)))


@pytest.mark.parametrize("rows", [[], [(None, "a " * 60), (1, "a " * 60), (1, "a " * 60)]])
def test_passages_without_order(spark, rows):
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in substring_dedup.digests(df).collect()] == [0] * len(rows)
