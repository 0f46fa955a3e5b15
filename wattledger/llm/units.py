"""Texts as space-led units, so that a tokeniser meets each distinct unit of a pass once.

In a byte-level BPE with the usual word pattern no token crosses a single blank between
two characters that are not white space, and the blank belongs to what follows it.  So
such a text is the concatenation of its units "word" and " word", and its ids those of
its units.  A text with any other blank is encoded whole.

Splitting, numbering the distinct units and putting the ids together is done on whole
columns; Python sees each distinct unit of a pass once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: units that a worker remembers (about 30 bytes each), and bytes of text that are encoded at a time
CACHE_UNITS, PASS_BYTES = 1_000_000, 6 << 20

#: texts -> all their ids after each other, and how many each text has
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def joined(packed: list[bytes], width: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``Encode`` returns, from packed ids of each text."""
    size = np.dtype(width).itemsize
    return np.frombuffer(b"".join(packed), width), np.array([len(p) // size for p in packed], np.int64)


class _Pool:
    """Ids of the units met so far, in one array; a unit's code says where its run is."""

    def __init__(self, encode: Encode, width: str, most: int):
        self.encode, self.width, self.most = encode, width, most
        self._clear()

    def _clear(self) -> None:
        self.units = pa.array([], pa.string())
        self.ids, self.start, self.length, self.passes = np.zeros(0, self.width), *(np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Units met in one pass only since the last time go; all of them, if that leaves too many."""
        kept = np.flatnonzero(self.passes > 1)
        units, ids, start, length = self.units, self.ids, self.start, self.length
        self._clear()
        if len(kept) <= self.most // 2:
            self._add(units.take(pa.array(kept)), *runs(ids, start[kept], length[kept]))

    def _add(self, units: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        used = np.maximum(lengths, 0)
        self.units = pa.concat_arrays([self.units, units])
        self.start = np.append(self.start, len(self.ids) + np.cumsum(used) - used)
        self.length, self.passes = np.append(self.length, lengths), np.append(self.passes, np.zeros(len(lengths), np.int64))
        self.ids = np.append(self.ids, ids)

    def _find(self, units: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)

    def of(self, units: pa.Array) -> np.ndarray:
        """Codes of distinct units; the length of a unit that has no ids of its own next to other white space is -1."""
        code = self._find(units)
        if len(self.units) + int((code < 0).sum()) > self.most:
            self._forget()
            code = self._find(units)
        new = units.filter(pa.array(code < 0))
        if len(new):
            names = new.to_pylist()
            regular = np.fromiter((bool(u) and not u[-1].isspace() and not u[0].isspace() for u in names), bool, len(names))
            lengths = np.full(len(names), -1, np.int64)
            ids, lengths[regular] = self.encode(names if regular.all() else [u for u, r in zip(names, regular.tolist()) if r])
            first = len(self.length)
            self._add(new, ids, lengths)
            code[code < 0] = np.arange(first, first + len(names))
        self.passes[code] += 1
        return code


def runs(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` after each other (a negative length is an empty run), and the lengths as they came."""
    n = np.maximum(length, 0)
    ends = np.cumsum(n)
    return ids[np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)], length


class UnitEncoder:
    """texts -> ids, one array per text.

    ``encode`` encodes whole texts, ``encode_led`` words with a blank before each (by
    default, ``encode`` of just that).
    """

    def __init__(self, encode: Encode, width: str, encode_led: Encode | None = None, most: int = CACHE_UNITS):
        self.encode, self.width = encode, width
        self.inner = _Pool(encode_led or (lambda words: encode([" " + w for w in words])), width, most)
        self.first = _Pool(encode, width, most // 8)

    def __call__(self, texts: pa.Array | Iterable[str | None]) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = split.flatten().dictionary_encode()
        units, code = coded.dictionary, coded.indices.to_numpy()
        heads = code[bounds[:-1]]
        leads = np.zeros(len(code), bool)
        leads[bounds[:-1]] = True
        inside = np.flatnonzero(np.bincount(code[~leads], minlength=len(units)))
        place = np.zeros(len(units), np.int64)
        place[inside] = self.inner.of(units.take(pa.array(inside)))
        start, length = np.append(self.inner.start, 0)[place][code], np.append(self.inner.length, 0)[place][code]
        # a text that begins with a blank has an empty first unit, which has no ids
        opening = np.unique(heads)
        opening = opening[pc.not_equal(units.take(pa.array(opening)), "").to_numpy(zero_copy_only=False)]
        place = np.full(len(units), -1, np.int64)
        place[opening] = self.first.of(units.take(pa.array(opening)))
        at = place[heads]
        length[bounds[:-1]] = np.append(self.first.length, 0)[at]
        start[bounds[:-1]] = np.append(self.first.start, 0)[at] + len(self.inner.ids)
        flat, _ = runs(np.append(self.inner.ids, self.first.ids), start, length)
        cuts = np.append(0, np.cumsum(np.maximum(length, 0)))[bounds].tolist()
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        whole = np.flatnonzero(np.minimum.reduceat(length, bounds[:-1]) < 0).tolist()
        if whole:
            ids, sizes = self.encode([texts[i].as_py() for i in whole])
            for i, own in zip(whole, np.split(ids, np.cumsum(sizes)[:-1])):
                out[i] = own
        return out
