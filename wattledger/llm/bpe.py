"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a text's prefix has a unique last token, and a token t may follow it
exactly if BPE would leave the pair (last token before t, t) as it is.  So one pass over
the matches of the vocabulary that end at each position (an automaton finds them) stores
the last token of every prefix, and following the tokens backwards gives the ids, without
ever replaying merges.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm import common
from wattledger.llm.units import PASS_BYTES, UnitEncoder, joined

#: tested pairs and words that a worker remembers, about 80 MB together; beyond them it starts anew
CACHE_PAIRS, CACHE_WORDS = 500_000, 200_000
#: white space of Unicode, which Python's own class exceeds; fixed values
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: the word pattern of this family of vocabularies; fixed values
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: itself if printable, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class TokenTable:
    """The bytes of every id of one vocabulary file of the tokenizers library (kind BPE, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self._read(json.load(file))

    def _read(self, spec: dict) -> dict[bytes, int]:
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = token
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        return vocab

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class PrefixEncoder(TokenTable):
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = self._read(spec), byte_letters()
        size = len(self.tokens)
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.packed = [np.array([i], self.width).tobytes() for i in range(size)]
        # (left, right) -> (rank, merged); parts[i] is how i was first made, -1 for a single byte
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((a, b), (rank, whole))
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
        # left * size + right -> BPE leaves the pair as it is
        self.pairs: dict[int, bool] = {}
        self.size = size
        # a token that BPE would not make from its own bytes ends no prefix
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(vocab.items()):
            if self._stands(i):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.words = regex.compile(_PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _stands(self, i: int) -> bool:
        """BPE makes token i from its bytes: its parts do, and nothing happens across them first."""
        if self.rank[i] < 0:
            return len(self.tokens[i]) == 1
        a, b = self.left[i], self.right[i]
        return self._apart(a, b, self.rank[i]) and self._stands(a) and self._stands(b)

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge of rank < ``before`` joins what ends a with what begins b.

        Undo the merges next to the border, latest first; each pair of neighbours seen on
        the way existed until the earlier of the two merges that consume it, so it must
        have no merge of a lower rank than that.
        """
        until_a = until_b = before
        while True:
            made = self.merges.get((a, b))
            # the pair stood side by side until a or b was taken up by a larger token; of
            # merges of equal rank the leftmost is done first
            if made and made[0] < until_a and made[0] <= until_b:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            else:
                until_b, b = self.rank[b], self.left[b]

    def fits(self, pair: int) -> bool:
        """BPE leaves the pair of neighbours as it is."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self._apart(*divmod(pair, self.size), 1 << 60)
        return found

    def word(self, word: str) -> bytes:
        """Packed ids of one word of the pattern."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        last, start, known, size = [-1] * n, [0] * n, self.pairs.get, self.size
        for end, (token, length) in self.automaton.iter(raw):
            if last[end] < 0:
                before = end - length
                if before >= 0:
                    pair = last[before] * size + token
                    fits = known(pair)
                    if fits is None:
                        fits = self.fits(pair)
                    if not fits:
                        continue
                last[end], start[end] = token, before
        ids, end = [], n - 1
        while end >= 0:
            ids.append(self.packed[last[end]])
            end = start[end]
        return b"".join(ids[::-1])

    def _text(self, text: str) -> bytes:
        out = []
        special = self.specials and self.specials.search(text)
        for part in self.specials.split(text) if special else [text]:
            if part in self.special:
                out.append(self.packed[self.special[part]])
                continue
            for word in self.words.findall(part):
                ids = self.known.get(word)
                if ids is None:
                    ids = self.known[word] = self.word(word)
                out.append(ids)
        return b"".join(out)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return [self._text(t) for t in texts]


_LOADED: dict[str, tuple[PrefixEncoder, UnitEncoder]] = {}
_TABLES: dict[str, TokenTable] = {}


def loaded(path: str) -> tuple[PrefixEncoder, UnitEncoder]:
    """One encoder per worker and file."""
    if path not in _LOADED:
        bpe = PrefixEncoder(path)
        _LOADED[path] = bpe, UnitEncoder(lambda texts: joined(bpe.encode_many(texts), bpe.width), bpe.width)
    return _LOADED[path]


def table(path: str) -> TokenTable:
    """What decoding needs; one per worker and file."""
    if path not in _TABLES:
        _TABLES[path] = TokenTable(path)
    return _TABLES[path]


def _texts(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit): one row per row of ``docs``.

    ``tokenizer`` is a vocabulary file that driver and executors can read.  Null and empty
    texts have no ids.  Rows may repeat and doc_ids may be null; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches):
        units = loaded(tokenizer)[1]
        for batch in common.passes(batches, "text", PASS_BYTES):
            ids = [x.astype("<u4").tobytes() for x in units(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _texts(docs, id_column).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the text of the ids, special tokens included."""

    def run(batches):
        known = table(tokenizer)
        for batch in common.passes(batches, "ids"):
            out = [known.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", release: bool = False) -> DataFrame:
    """doc_id, ids and decoded of every row, as ``decode(encode(docs))``, in one worker per task.

    ``release`` gives the encoder's memory back at each task's end, for jobs whose other
    stages use the same workers.
    """

    def run(batches):
        bpe, units = loaded(tokenizer)
        for batch in common.passes(batches, "text", PASS_BYTES):
            arrays = units(batch.column("text"))
            out = [bpe.decode(x).decode("utf-8", "replace") for x in arrays]
            ids = [x.astype("<u4").tobytes() for x in arrays]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])
            del arrays, out, ids
        if release:
            del bpe, units
            _LOADED.pop(tokenizer, None)
            common.give_back()

    return _texts(docs, id_column).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return round_trip(docs, tokenizer).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
