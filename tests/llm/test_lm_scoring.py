"""Language-model scores against a plain recursive model."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import clashing, documents, empty, prose

from wattledger.llm import lm_scoring


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute(rows, order, strength, added=0.1):
    """rows of (doc_id, text) -> (doc_id, held out, tokens, known, training tokens, base, score)."""
    counts = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            seq = ["<begin>", *tokens(text)]
            for m in range(1, order + 1):
                counts.update(tuple(seq[i - m + 1 : i + 1]) for i in range(1, len(seq)) if i - m + 1 >= 0)
    texts = sum(not held(d) for d, _ in rows)
    single = {k[0]: c for k, c in counts.items() if len(k) == 1}
    total, distinct = sum(single.values()), len(single)

    def p(history, word):
        if not history:
            return (single.get(word, 0) + added) / (total + added * (distinct + 1))
        context = texts if history == ("<begin>",) else counts[history]
        return (counts[(*history, word)] + strength * p(history[1:], word)) / (context + strength)

    out = []
    for doc_id, text in rows:
        seq = ["<begin>", *tokens(text)]
        own = seq[1:]
        base = sum(math.log10(p((), w)) for w in own)
        full = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        out.append((doc_id, held(doc_id), len(own), sum(single.get(w, 0) > 0 for w in own), total, base, full))
    return out


def rows_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order,block", [(3, 2_000_000), (3, 37), (2, 11), (1, 20), (4, 50)])
def test_scores_equal_the_recursive_model(spark, order, block):
    rng = random.Random(order * 100 + block)
    texts = [prose(rng, rng.choice((0, 1, 2, 5, 40))) for _ in range(60)] + ["A a A a a", "", None, " \t\n", "unseen" * 3, "a\x1cb É é"]
    texts += [texts[3]] * 5
    got = rows_of(lm_scoring.score(documents(spark, texts).repartition(3), order, 2.5, block_tokens=block))
    same(got, brute(list(enumerate(texts)), order, 2.5))


def test_several_owners_and_slices(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "OWNER_KEYS", 50)
    monkeypatch.setattr(lm_scoring, "SLICE_TOKENS", 30)
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(30)) for _ in range(80)]
    same(rows_of(lm_scoring.score(documents(spark, texts), 3, 3.0, block_tokens=200)), brute(list(enumerate(texts)), 3, 3.0))


def test_a_text_split_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SPLIT_BYTES", 16)
    whole = "one two  three\tfour " + "x" * 40 + " five\n"
    assert [w for part in lm_scoring.words_of(whole.encode()) for w in part] == whole.encode().split()
    texts = [whole * 5, whole, "x" * 50]
    same(rows_of(lm_scoring.score(documents(spark, texts, first=1), 3, 3.0, block_tokens=9)), brute(list(enumerate(texts, 1)), 3, 3.0))


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (7, "b"), (7, "a b")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    same(rows_of(lm_scoring.score(df)), brute(rows, 3, 3.0))


def test_nothing_to_learn_from(spark):
    out = [n for n in range(200) if held(n)][:2]
    rows = [(n, "a b") for n in out]
    got = rows_of(lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(r[1] and r[3:6] == (0, 0, 0.0) and r[6] == 0.0 for r in got) and len(got) == 2
    assert lm_scoring.score(empty(spark)).count() == 0
