"""The pipeline's near-dedup stage against brute force at its own threshold."""

import random

import corpus_pipeline
import numpy as np
from helpers import documents

from wattledger.llm import common, near_dedup


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_kept(texts, percent):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return sorted(set(label))


def test_stage_keeps_one_of_copies_at_80_percent(spark):
    rng = random.Random(17)
    texts = []
    for n in range(60):
        words = [f"t{n}_{i}" for i in range(104)]
        texts.append(" ".join(words))
        # shared shingles of 100: from 94 down to 87, similarities 0.89 to 0.77
        cut = rng.randrange(6, 14)
        texts.append(" ".join(words[: 104 - cut] + [f"u{n}_{i}" for i in range(cut)]))
    at_80, at_85 = brute_kept(texts, 80), brute_kept(texts, 85)
    assert len(at_80) < len(at_85) < len(texts)
    df = documents(spark, texts)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, df, "").select("doc_id").collect()) == at_80
    assert sorted(r.doc_id for r in near_dedup.near_duplicates(df).where("kept").select("doc_id").collect()) == at_85
    assert near_dedup.least_agreeing(85) == 60 and near_dedup.least_agreeing(80) == 53


def test_trees_miss_at_most_the_stated_share():
    assert 1e-5 < near_dedup.miss_rate(85, 6) < 1.2e-5
    for percent in (80, 85):
        assert near_dedup.miss_rate(percent, near_dedup.trees(percent)) <= 1e-7 < near_dedup.miss_rate(percent, near_dedup.trees(percent) - 1)
    assert (near_dedup.trees(85), near_dedup.trees(80)) == (11, 18)


def test_repeated_rows_go_before_the_sets_are_made(spark, monkeypatch):
    """Sets are larger than texts: no shuffle or sort of them, which took a stage beyond an executor's memory."""
    plans, write = {}, near_dedup.materialize

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(near_dedup, "materialize", noted)
    words = [f"w{i}" for i in range(60)]
    df = documents(spark, [" ".join(words), " ".join(words[:59]), "another text of just six words"])
    kept = near_dedup.near_duplicates(df.union(df)).where("kept").select("doc_id").distinct()
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    after, before = plans["sets"].split("MapInArrow")
    assert "Aggregate" not in after and "Aggregate" in before


def test_workers_remember_few_words(spark):
    """A cache of half a million words in every worker took the stage beyond an executor's memory."""
    hashes = common.WordHashes(near_dedup.CACHE_WORDS)
    assert near_dedup.CACHE_WORDS <= 1 << 16
    words = [f"w{i}".encode() for i in range(near_dedup.CACHE_WORDS + 1000)]
    first = hashes.of(words)
    assert len(hashes) <= near_dedup.CACHE_WORDS
    assert (hashes.of(words) == first).all()


def test_a_linked_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text around the threshold: the pairs that were compared grew with the family's square."""
    rng, base, texts = random.Random(3), [f"b{i}" for i in range(320)], []
    for n in range(600):
        words = list(base)
        for at in rng.sample(range(320), 4):
            words[at] = f"x{n}_{at}"
        texts.append(" ".join(words))
    compared, write = [], near_dedup.materialize

    def noted(df, label):
        out = write(df, label)
        if label == "near":
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", noted)
    kept = near_dedup.near_duplicates(documents(spark, texts), 80).where("kept")
    assert [r.doc_id for r in kept.collect()] == brute_kept(texts[:150], 80) == [0]
    # without the stars of the leaves: 1,737 before
    assert sum(compared[1:]) < len(texts) / 2


def test_freed_memory_goes_back():
    """What a worker freed between memory in use is not kept until the worker ends."""

    def anonymous() -> int:
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Anonymous:")) >> 10

    blocks = [np.ones(8_000) for _ in range(2_000)]  # 128 MB in pieces too small to be mapped on their own
    kept = blocks[::100]
    full = anonymous()
    del blocks
    common.give_back()
    assert len(kept) == 20 and anonymous() < full - 100
