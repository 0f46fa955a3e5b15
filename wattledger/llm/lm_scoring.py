"""Language-model scores of documents by a weighted backoff automaton.

The model is n-grams with Dirichlet smoothing: p(w | h) = (c(hw) + s p(w | h')) / (c(h) + s)
with h' the history without its first word, and additive smoothing for single words.
As an automaton: a state for every history seen in training, an arc for every n-gram
seen, weighted log10 p, to the longest history that its end makes, and from every state
but the root a failure arc, weighted log10 (s / (c(h) + s)), to the history h'.

The model grows with the corpus, so no worker holds it.  Documents are packed into blocks
of BLOCK_TOKENS tokens.  A block asks the owners of n-gram fingerprints for the counts of
what occurs in it; the same message carries what it adds to those counts, so one exchange
both counts and looks up.  With the answers a task builds the part of the automaton that
its texts can reach and traverses each text once from left to right.

A text longer than a block is cut into pieces that carry the words before them.  Words are
known by 64-bit hashes; longer n-grams by fingerprints long enough that an unseen
n-gram is taken for a seen one with a probability below 2 ** -SPARE_BITS, at any size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm import common
from wattledger.session import materialize

#: words of an n-gram, and the weight s of the shorter history
ORDER, STRENGTH = 3, 3.0
#: what single words get on top of their count
ADDED = 0.1
#: tokens of a block, and of the part of it that is traversed at a time
BLOCK_TOKENS, SLICE_TOKENS = 2_000_000, 100_000
#: bits of a fingerprint beyond the logarithm of the number of n-grams
SPARE_BITS = 20
#: n-grams that one owner adds up at a time
OWNER_KEYS = 2_000_000
#: bytes of a text that are split at a time
SPLIT_BYTES = 4 << 20

#: A-Z lower-cased
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: no word is empty or blank, so these hash the end and the begin of a text
_END, _BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"", b" "))


def held_out(doc_id: Column) -> Column:
    """The tenth of the documents that the model does not learn from; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded part of it at a time."""
    at = 0
    while len(raw) - at > SPLIT_BYTES:
        gap = _GAP.search(raw, at + SPLIT_BYTES)
        to = gap.start() if gap else len(raw)
        yield raw[at:to].translate(_LOWER).split()
        at = to
    yield raw[at:].translate(_LOWER).split()


def _ended(lists: Iterator[list[bytes]]) -> Iterator[tuple[list[bytes], bool]]:
    """The lists, with the end token (no bytes) after the last; whether a list is the last."""
    held = next(lists)
    for words in lists:
        yield held, False
        held = words
    yield [*held, b""], True


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCK = "block long, text array<long>, doc_id array<long>, learn array<boolean>, lead array<int>, size array<int>, n_words int, words binary, tokens binary, own long, train long, train_texts long"
_BLOCK = pa.schema(
    [("block", pa.int64()), ("text", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("lead", pa.list_(pa.int32())), ("size", pa.list_(pa.int32()))]
    + [("n_words", pa.int32()), ("words", pa.binary()), ("tokens", pa.binary()), ("own", pa.int64()), ("train", pa.int64()), ("train_texts", pa.int64())]
)


def _squeeze(values: np.ndarray) -> bytes:
    """64-bit values as compressed byte planes: planes of zeros vanish, others take about their entropy."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _spread(squeezed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(squeezed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<u8").ravel()


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and where the run of each begins, and the end."""
    ordered = np.sort(values)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.append(starts, len(ordered))


class _Packer:
    """Collects pieces of texts (their words before, then their own) into block records."""

    def __init__(self, first: int, most: int):
        self.block, self.most = first, most
        self._new()

    def _new(self) -> None:
        self.numbers, self.pieces, self.parts, self.own = _Numbers(), [], [], 0

    def record(self) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        # the begin is no word of the list: it stands behind all of them
        tokens = np.concatenate(self.parts)
        tokens = np.where(tokens < 0, np.int32(len(order)), place[tokens])
        learned = [p for p in self.pieces if p[2]]
        row = {
            "block": self.block, "n_words": len(hashes), "words": _squeeze(_gaps(hashes[order])), "tokens": _squeeze(tokens),
            "own": self.own, "train": sum(p[4] - p[3] for p in learned), "train_texts": sum(p[5] for p in learned),
        }
        row.update(zip(("text", "doc_id", "learn", "lead", "size"), map(list, zip(*[p[:5] for p in self.pieces]))))
        self.block += 1
        self._new()
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    def text(self, text: int, doc_id: int | None, learn: bool, raw: bytes, order: int) -> Iterator[pa.RecordBatch]:
        # the words before what comes next; None is the begin
        before: list[bytes | None] = [None][: order - 1]
        for words, last in _ended(words_of(raw)):
            at = 0
            while at < len(words):
                some = words[at : at + self.most - self.own]
                at += len(some)
                ids = [-1 if w is None else self.numbers[w] for w in before]
                lead = len(ids)
                ids.extend(map(self.numbers.__getitem__, some))
                self.parts.append(np.array(ids, np.int32))
                self.pieces.append((text, doc_id, learn, lead, len(ids), last and at == len(words)))
                self.own += len(some)
                before = [*before, *some[-order:]][-(order - 1) :] if order > 1 else []
                if self.own >= self.most:
                    yield self.record()


def pack(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the texts of ``docs`` (doc_id, text), written to the shared folder."""

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        packer, text = _Packer(first, block_tokens), first
        for batch in common.passes(batches, "text"):
            for doc_id, learn, raw in zip(batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist(), common.texts(batch, "text")):
                yield from packer.text(text, doc_id, learn, raw, order)
                text += 1
        if packer.pieces:
            yield packer.record()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("learn", ~held_out(F.col("doc_id")))
    return materialize(own.mapInArrow(run, BLOCK), "blocks")


class Block:
    """A block record's arrays: one entry per position of the concatenated pieces."""

    def __init__(self, row: dict):
        self.lead, self.size = (np.array(row[c], np.int64) for c in ("lead", "size"))
        total = int(self.size.sum())
        self.hashes = np.cumsum(_spread(row["words"], row["n_words"]), dtype=np.uint64)
        self.tokens = _spread(row["tokens"], total).astype(np.int32)
        self.starts = np.cumsum(self.size) - self.size
        #: place in the piece, and whether the position is the piece's own and learned from
        self.depth = np.arange(total, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.size)
        self.is_own = self.depth >= np.repeat(self.lead.astype(np.int32), self.size)
        self.learns = self.is_own & np.repeat(np.array(row["learn"], bool), self.size)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the block's words, ascending, and how often the block adds them to the model."""
        return self.hashes, np.bincount(self.tokens[self.learns], minlength=len(self.hashes))[: len(self.hashes)]

    def prints(self, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every length from two on: fingerprints of the n-grams that end at each position, and where there is one."""
        hashes = np.append(self.hashes, _BEGIN)[self.tokens]
        fp = hashes
        for m in range(2, order + 1):
            longer = np.zeros_like(fp)
            longer[1:] = common.mix(fp[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + np.uint64(m))
            fp = longer
            yield fp >> np.uint64(64 - bits), self.depth >= m - 1

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the n-grams of two words and more, ascending, and how often the block adds them to the model."""
        keys, learned = [], []
        for fp, valid in self.prints(order, bits):
            keys.append(_distinct(fp[valid])[0])
            learned.append(fp[valid & self.learns])
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        distinct = _distinct(np.concatenate(keys))[0]
        added = np.zeros(len(distinct), np.int64)
        for fp in learned:
            known, starts = _distinct(fp)
            added[np.searchsorted(distinct, known)] += np.diff(starts)
        return distinct, added

    def numbers(self, order: int, bits: int, distinct: np.ndarray) -> list[np.ndarray]:
        """For every length from two on, the place in ``distinct`` of the n-gram that ends at each position, -1 for none."""
        out = []
        for fp, valid in self.prints(order, bits):
            # looked up in ascending order, which touches the table from left to right
            at, place = np.argsort(fp), np.empty(len(fp), np.int32)
            place[at] = np.searchsorted(distinct, fp[at])
            out.append(np.where(valid, place, np.int32(-1)))
        return out


def exchange(blocks: DataFrame, order: int, bits: int, owners_log2: int, words: bool) -> DataFrame:
    """block, owner, n, totals, seen: each block's counts over the whole corpus, in order of its keys.

    A key's owner is its first bits, so an owner's answers to a block follow each other.
    Messages are sorted and already added up within a block, so however common an n-gram
    is, its owner meets it once per block.  ``seen`` (on one row per owner) is how many
    keys have a count.
    """
    key_bits = 64 if words else bits

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                keys, added = block.words() if words else block.grams(order, bits)
                owner = (keys >> np.uint64(key_bits - owners_log2)).astype(np.int64) if owners_log2 else np.zeros(len(keys), np.int64)
                cuts = np.searchsorted(owner, np.arange((1 << owners_log2) + 1))
                for k in range(1 << owners_log2):
                    a, b = int(cuts[k]), int(cuts[k + 1])
                    if a < b:
                        yield pa.RecordBatch.from_pylist([{"owner": k, "block": row["block"], "n": b - a, "keys": _squeeze(_gaps(keys[a:b])), "counts": _squeeze(added[a:b])}], schema=asked)

    asked = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("totals", pa.binary()), ("seen", pa.int64())])

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.cumsum(_spread(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([_spread(r["counts"], r["n"]).astype(np.float64) for r in rows])
        distinct, place = np.unique(keys, return_inverse=True)
        # sums of whole numbers are exact in doubles up to 2 ** 53
        totals = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        out, at = [], 0
        for i, r in enumerate(rows):
            seen = int((totals > 0).sum()) if i == 0 else 0
            out.append({"block": r["block"], "owner": r["owner"], "n": r["n"], "totals": _squeeze(totals[place[at : at + r["n"]]]), "seen": seen})
            at += r["n"]
        return pa.Table.from_pylist(out, schema=answered)

    messages = blocks.mapInArrow(ask, "owner long, block long, n long, keys binary, counts binary")
    return messages.groupBy("owner").applyInArrow(add_up, "block long, owner long, n long, totals binary, seen long")


class Automaton:
    """The states and arcs that some texts can reach, as they lie along the texts.

    A state is a history of 0 to order - 1 words; the state of k words at a position is the
    one that the k words up to there make.  Its arc for the next word is the n-gram that
    those k words and the next one make, and exists if training has seen that; its
    failure arc leads to the state of k - 1 words at the same position.
    """

    #: stands for the weight of an arc that does not exist; weights are 0 at most
    NO_ARC = 1.0

    def __init__(self, counts: list[np.ndarray], is_begin: np.ndarray, total: int, distinct: int, texts: int, strength: float, added: float):
        """``counts[m]``: how often training has seen the (m + 1)-gram that ends at each position."""
        size = total + added * (distinct + 1)
        p = (counts[0] + added) / size
        #: log10 p of each single word, and of a word that training has not seen
        self.base, self.unknown = np.log10(p), math.log10(added / size)
        self.arcs, self.costs = [np.where((counts[0] > 0) & ~is_begin, self.base, self.NO_ARC)], []
        context = np.where(is_begin, texts, counts[0])
        for count in counts[1:]:
            shorter, p = p, np.ones(len(count))
            p[1:] = (count[1:] + strength * shorter[1:]) / (context[:-1] + strength)
            self.arcs.append(np.where(count > 0, np.log10(p), self.NO_ARC))
            self.costs.append(np.log10(strength / (context + strength)))
            context = count

    def scores(self, starts: np.ndarray, leads: np.ndarray, ends: np.ndarray, is_begin: np.ndarray) -> list[float]:
        """log10 probability of each piece after its lead, by one traversal; the pieces follow each other."""
        longest, unknown = len(self.costs), self.unknown
        arcs, costs, begins = [a.tolist() for a in self.arcs], [c.tolist() for c in self.costs], is_begin.tolist()
        out = []
        for start, lead, end in zip(starts.tolist(), leads.tolist(), ends.tolist()):
            # words: how many words the state holds
            words, total = 0, 0.0
            for i in range(start, end):
                if i == start + lead:
                    total = 0.0
                if begins[i]:
                    words = min(1, longest)
                    continue
                weight = arcs[words][i]
                while weight > 0.0:
                    if not words:
                        weight = unknown
                        break
                    words -= 1
                    total += costs[words][i - 1]
                    weight = arcs[words][i]
                else:
                    if words < longest:
                        words += 1
                total += weight
            out.append(total)
        return out


SCORED = "text long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_block(row: dict, words: list[dict], grams: list[dict], order: int, bits: int, total: int, distinct: int, texts: int, strength: float, added: float) -> pa.RecordBatch:
    def joined(answers: list[dict]) -> np.ndarray:
        parts = [_spread(a["totals"], a["n"]).astype(np.float64) for a in sorted(answers, key=lambda a: a["owner"])]
        return np.concatenate([*parts, [0.0]])

    block = Block(row)
    numbers = block.numbers(order, bits, block.grams(order, bits)[0])
    word_count, gram_count = joined(words), joined(grams)
    starts, sizes, ends = block.starts, block.size, block.starts + block.size
    known, base, scores, first = [], [], [], 0
    while first < len(sizes):
        # pieces of about SLICE_TOKENS together, one at least
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_TOKENS, "right")))
        part = slice(int(starts[first]), int(ends[last - 1]))
        tokens, own, cuts = block.tokens[part], block.is_own[part], starts[first:last] - starts[first]
        counts, is_begin = [word_count[tokens], *[gram_count[n[part]] for n in numbers]], tokens == len(block.hashes)
        automaton = Automaton(counts, is_begin, total, distinct, texts, strength, added)
        known.append(np.add.reduceat((own & (counts[0] > 0)).astype(np.int64), cuts))
        base.append(np.add.reduceat(np.where(own, automaton.base, 0.0), cuts))
        scores += automaton.scores(cuts, block.lead[first:last], cuts + sizes[first:last], is_begin)
        first = last
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["text"], pa.int64()), pa.array(row["doc_id"], pa.int64()), pa.array([not x for x in row["learn"]], pa.bool_()),
            pa.array(sizes - block.lead, pa.int64()), pa.array(np.concatenate(known), pa.int64()),
            pa.array(np.concatenate(base), pa.float64()), pa.array(scores, pa.float64()),
        ],
        ["text", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, added: float = ADDED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Null and empty texts have the end token alone.  A null doc_id is held out (the checksum
    of the empty text is 0); rows that repeat a doc_id are rows of their own.  Texts of any
    length are scored whole.  Other columns are not read.  Where no row is learned from,
    every token is unknown; an empty table has no rows.
    """
    spark = docs.sparkSession
    blocks = pack(docs, order, block_tokens)
    facts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("own", "train", "train_texts", "n_words")]).first()
    entries = max(2, facts.own * max(1, order - 1))
    bits = min(64, math.ceil(math.log2(entries)) + SPARE_BITS)

    def owners(keys: int) -> int:
        return max(0, math.ceil(math.log2(max(1, keys / OWNER_KEYS))))

    words = materialize(exchange(blocks, order, bits, owners(facts.n_words), True), "word-totals")
    distinct = words.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first().v
    grams = exchange(blocks, order, bits, owners(entries), False) if order > 1 else words.limit(0)
    total, texts = facts.train, facts.train_texts

    def scored(records: pa.Table, answers: pa.Table) -> pa.Table:
        rows = answers.to_pylist()
        parts = [[r for r in rows if r["words"] == kind] for kind in (True, False)]
        out = [_score_block(r, *parts, order, bits, total, distinct, texts, strength, added) for r in records.to_pylist()]
        return pa.Table.from_batches(out)

    answers = words.withColumn("words", F.lit(True)).unionByName(grams.withColumn("words", F.lit(False))).drop("seen")
    pieces = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, SCORED)
    # most texts are one piece; those cut between blocks are added up
    whole = pieces.groupBy("text").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
