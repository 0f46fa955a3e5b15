"""Repeated passages by prefix-partitioned suffix trees over words.

A passage of WINDOW words that starts in two documents is a node of depth WINDOW in the
tree of all suffixes.  Only such deep nodes matter, so:

1. Equal documents are represented by the one with the smallest doc_id; the others lose
   everything.
2. A suffix is a candidate only if the smallest ANCHOR-word hash within its first WINDOW
   words (its anchor) also occurs in another document.  Equal windows have equal anchors,
   so no repeat is missed, and one position in about eighteen is shuffled.
3. Candidate suffixes are put in the order of their path in the tree: hash of the first
   ANCHOR words, hash of all WINDOW words, then document.  Range partitioning cuts this
   order into memory-sized groups; the cuts are prefixes as long as they have to be, and
   a passage that a third of all documents share is simply cut between documents.
4. A task reads the deep nodes of its group off the sorted suffixes.  A node that began in
   an earlier group is completed from a table with one row per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm import common
from wattledger.session import materialize

WINDOW, ANCHOR = 50, 16
#: suffixes of one group, about 40 MB
GROUP = 1 << 20

_STEP = np.uint64(0xD1342543DE82EF95)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` words: runs of 1, 2, 4, ... words are put together."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, length, scale = words, 1, _STEP
    whole, covered = None, 0
    while True:
        if size & length:
            # hash of (covered + length) words: the covered ones first
            whole = run if whole is None else whole[: len(words) - covered - length + 1] * scale + run[covered:]
            covered += length
        if covered == size:
            return common.mix(whole)
        run = run[:-length] * scale + run[length:]
        length, scale = length * 2, np.uint64(int(scale) ** 2 & 0xFFFFFFFFFFFFFFFF)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(words: np.ndarray) -> np.ndarray:
    """Anchor of every window of the sequence."""
    if len(words) < WINDOW:
        return np.empty(0, np.uint64)
    return sliding_min(grams(words, ANCHOR), WINDOW - ANCHOR + 1)


def _profiles(batches):
    hashes = common.WordHashes()
    for batch in common.passes(batches, "text"):
        sequences = [hashes.of(t.split()) for t in common.texts(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(w) for w in sequences], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in sequences], pa.binary()),
                pa.array([np.unique(anchors(w)).view(np.int64) for w in sequences], pa.list_(pa.int64())),
            ],
            ["doc_id", "n_words", "sequence", "anchors"],
        )


def _suffixes(batches):
    hashes = common.WordHashes()
    for batch in common.passes(batches, "text"):
        parts = []
        for doc_id, text, shared in zip(batch.column("doc_id").to_pylist(), common.texts(batch, "text"), batch.column("shared")):
            words = hashes.of(text.split())
            at = np.flatnonzero(np.isin(anchors(words), shared.values.to_numpy().view(np.uint64)))
            parts.append((np.full(len(at), doc_id), at, grams(words, ANCHOR)[at], grams(words, WINDOW)[at]))
        doc, at, head, whole = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at.astype(np.int32)), pa.array(head.view(np.int64)), pa.array(whole.view(np.int64))], ["doc_id", "at", "head", "whole"])


_NODE = "kind int, part int, head long, whole long, doc_id long, at int"
REPEAT, OPEN, END = 0, 1, 2


def _deep_nodes(batches):
    """REPEAT: suffixes below a node that a smaller document reached; OPEN: suffixes of the smallest
    document in the group's first node, which may have begun in an earlier group; END: the last node
    and its smallest document."""
    parts = [[b.column(c).to_numpy() for c in ("head", "whole", "doc_id", "at")] for b in batches if b.num_rows]
    if not parts:
        return
    head, whole, doc, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, doc, whole, head))
    head, whole, doc, at = head[order], whole[order], doc[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (whole[1:] != whole[:-1])]))
    node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(head))))
    smallest = doc[starts][node]
    repeat = doc > smallest
    opened = np.flatnonzero((node == 0) & ~repeat)
    rows = np.concatenate([np.flatnonzero(repeat), opened, [starts[-1]]])
    kinds = np.concatenate([np.full(int(repeat.sum()), REPEAT), np.full(len(opened), OPEN), [END]]).astype(np.int32)
    part = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
    for i in range(0, len(rows), 1 << 17):
        s = slice(i, i + (1 << 17))
        own = rows[s]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds[s], part[s], head[own], whole[own], doc[own], at[own].astype(np.int32))], ["kind", "part", "head", "whole", "doc_id", "at"])


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, at) of every window, by its first word, that starts in a document with a smaller
    doc_id, for documents that represent their equals; doc_ids of the other equals)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    profiles = materialize(own.mapInArrow(_profiles, "doc_id long, n_words long, sequence binary, anchors array<long>").where(F.col("n_words") >= WINDOW), "profiles")
    firsts = materialize(profiles.groupBy("sequence").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "firsts")
    seconds = materialize(profiles.join(firsts, "sequence").where(F.col("doc_id") > F.col("first")).select("doc_id"), "seconds")
    marks = common.without_members(profiles.select("doc_id", "anchors"), seconds, "doc_id").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = marks.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(F.col("low") < F.col("high")).select("anchor")
    shared = materialize(shared, "shared")
    found = common.maybe_members(marks, shared, "anchor").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    found = materialize(found, "found")
    texts = common.maybe_members(own, found, "doc_id").join(found, "doc_id")
    suffixes = materialize(texts.mapInArrow(_suffixes, "doc_id long, at int, head long, whole long"), "suffixes")
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // GROUP))
    nodes = suffixes.repartitionByRange(groups, "head", "whole", "doc_id").mapInArrow(_deep_nodes, _NODE)
    nodes = materialize(nodes, "nodes")
    # the order is by document within a node, so its first group holds its smallest document
    ends = nodes.where(F.col("kind") == END).groupBy("head", "whole").agg(F.min("part").alias("begun"), F.min("doc_id").alias("smallest"))
    opened = nodes.where(F.col("kind") == OPEN)
    late = opened.join(ends, ["head", "whole"]).where((F.col("begun") < F.col("part")) & (F.col("smallest") < F.col("doc_id"))).select("doc_id", "at").distinct()
    return nodes.where(F.col("kind") == REPEAT).select("doc_id", "at").union(late), seconds


def _cut(batches):
    """Words that no removed window covers, joined by blanks."""
    for batch in common.passes(batches, "text"):
        rows = []
        for text, all_, at in zip(common.texts(batch, "text"), batch.column("whole").to_pylist(), batch.column("at")):
            words = text.split()
            if all_:
                rows.append((len(words), len(words), [(0, len(words))], b""))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            starts = at.values.to_numpy() if at.is_valid else np.empty(0, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.minimum(starts + WINDOW, len(words)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans = turns.reshape(-1, 2)
            kept, last = [], 0
            for a, b in spans.tolist():
                kept += words[last:a]
                last = b
            rows.append((len(words), int(gone.sum()), [tuple(x) for x in spans.tolist()], b" ".join(kept + words[last:])))
        span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in r[2]] for r in rows], span),
                pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans, kept_text.

    Words are cut at ASCII white space, unchanged.  Every word is removed that is covered
    by a run of WINDOW words which also starts in a document with a smaller doc_id; runs
    are judged on the input.  ``spans`` are the removed runs (first word, end exclusive),
    kept_text the rest joined by single blanks.  Null and empty texts have no words;
    documents below WINDOW words lose nothing.  A doc_id stands for one text, and rows that
    repeat it share its result; rows without doc_id neither lose words nor make others
    lose them.  An empty table gives an empty result; other columns are not read.
    """
    windows, seconds = repeated_windows(docs)
    cuts = windows.groupBy("doc_id").agg(F.collect_set("at").alias("at")).select("doc_id", "at", F.lit(False).alias("whole"))
    cuts = materialize(cuts.union(seconds.distinct().select("doc_id", F.lit(None).cast("array<int>").alias("at"), F.lit(True).alias("whole"))), "cuts")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nothing = [F.lit(None).cast("array<int>").alias("at"), F.lit(False).alias("whole")]
    untouched = common.without_members(own, cuts, "doc_id").select("doc_id", "text", *nothing)
    touched = common.maybe_members(own, cuts, "doc_id").join(cuts, "doc_id").select("doc_id", "text", "at", "whole")
    return untouched.union(touched).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, spans array<struct<first:int,end:int>>, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
