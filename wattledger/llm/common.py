"""Helpers shared by the operators: text normalisation, word hashes, membership filters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word, in both Java's and Python's syntax: bytes.split() without arguments cuts at exactly the same characters
WORD = r"[^\x20\x09-\x0D]+"
#: bytes of text that one numpy pass over a batch may take (one longer text is a pass of its own)
PASS_BYTES = 4 << 20
#: entries of a worker's word cache; beyond them it starts anew
CACHE_WORDS = 500_000
#: bits of a membership filter: 1 MiB, whatever the size of the data
FILTER_BITS = 1 << 23


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def passes(batches: Iterator[pa.RecordBatch], column: str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, so that memory does not follow the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i in range(batch.num_rows):
            if total and total + sizes[i] > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += sizes[i]
        if batch.num_rows > start:
            yield batch.slice(start)


def give_back() -> None:
    """Hands freed memory back to the system, Arrow's and the C library's: a worker would keep it, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [v or b"" for v in batch.column(column).cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash as int64, remembered up to ``most`` words."""

    def __init__(self, most: int = CACHE_WORDS):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        value -= (value >> 63) << 64
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def own_columns(frame: DataFrame) -> list[Column]:
    """The frame's columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in frame.columns]


def _place(column: str) -> tuple[Column, Column]:
    """Slot and bit of a key in the membership filter; null for a null key."""
    h = F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))
    slot = F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_BITS // 64)).cast("int")
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    return slot, F.element_at(bits, (h.bitwiseAND(F.lit(63)) + 1).cast("int"))


def membership(keys: DataFrame, column: str) -> DataFrame:
    """One-hash Bloom filter of a key column as a table of at most FILTER_BITS / 64 rows (slot, bits)."""
    slot, bit = _place(column)
    known = keys.where(F.col(column).isNotNull()).select(slot.alias("__members_slot"), bit.alias("__members_bit"))
    return known.groupBy("__members_slot").agg(F.bit_or("__members_bit").alias("__members_bits"))


def _against(rows: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    slot, bit = _place(column)
    hit = (slot == F.col("__members_slot")) & (bit.bitwiseAND(F.col("__members_bits")) != 0)
    return rows.join(F.broadcast(membership(keys, column)), hit, how)


def _exactly(rows: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    known = keys.select(F.col(column).alias("__members_key")).distinct()
    return rows.join(known, F.col(column) == F.col("__members_key"), how)


def maybe_members(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key may be among ``keys``: a superset, found without moving a row.

    The broadcast filter has at most FILTER_BITS / 64 rows of 12 bytes.  Once it is
    full it lets everything pass, so an exact join has to follow.
    """
    return _against(rows, keys, column, "left_semi")


def marked(rows: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true for every row whose key is among ``keys``, and for few others.

    It depends on the key alone, so two tables that share a key agree on it.
    """
    slot, bit = _place(column)
    hit = F.coalesce(bit.bitwiseAND(F.col("__members_bits")) != 0, F.lit(False))
    return rows.join(F.broadcast(membership(keys, column)), slot == F.col("__members_slot"), "left").withColumn(name, hit).drop("__members_slot", "__members_bits")


def only_members(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is among ``keys``; only candidates are shuffled."""
    return _exactly(maybe_members(rows, keys, column), keys, column, "left_semi")


def without_members(rows: DataFrame, keys: DataFrame, column: str, **further: Column) -> DataFrame:
    """Rows whose key is not among ``keys`` (null keys stay).

    Rows that the filter rules out pass as they are; only the others are shuffled for the exact anti join.
    ``further`` columns of ``keys`` have to agree too with what is given for them, which is computed for those others alone.
    """
    close = maybe_members(rows, keys, column)
    known = keys.select(F.col(column).alias("__members_key"), *[F.col(c).alias(f"__members_{c}") for c in further]).distinct()
    match = F.col(column) == F.col("__members_key")
    for c, own in further.items():
        match &= own == F.col(f"__members_{c}")
    return _against(rows, keys, column, "left_anti").union(close.join(known, match, "left_anti"))
