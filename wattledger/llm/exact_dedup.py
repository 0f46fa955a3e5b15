"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Every partition hashes its normalised texts, sorts the distinct hashes, cuts them by
   owner (the hash range) and sends each owner one Golomb-Rice coded message.
2. An owner decodes its messages and answers each with a bitmap: which hashes also came
   from another partition.
3. Partitions read off the bitmaps (and their own repeats) which hashes are suspect; only
   documents with a suspect hash are shuffled, and grouped by their bytes.

A group of copies costs one bit or so per partition in the exchange, and its bytes are
reduced map-side, so a group with a third of all rows is no hot task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm import common
from wattledger.session import materialize

#: hashes that one owner decodes at a time: 16 MB
OWNER_HASHES = 1 << 21


def rice_encode(sorted_values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of sorted distinct values below ``span``: (bits of the remainder, unary part, remainders)."""
    n = len(sorted_values)
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    k = max(0, (span // max(n, 1)).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = np.empty((n, k), np.uint8)
    for bit in range(k):
        rest[:, bit] = (gaps >> np.uint64(k - 1 - bit)).astype(np.uint8) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ones, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
    low = np.zeros(n, np.uint64)
    for bit in range(k):
        low = (low << np.uint64(1)) | bits[:, bit]
    return np.cumsum((quotients << np.uint64(k)) | low, dtype=np.uint64)


def _fingerprints(batches):
    for batch in common.passes(batches, "text"):
        norm = [t.lower() for t in common.texts(batch, "text")]  # bytes.lower() touches A-Z alone
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in norm], np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in norm]),
            ],
            ["doc_id", "fp", "text_sha256"],
        )


def _messages(owners: int):
    width = -(-(1 << 64) // owners)

    def pack(batches):
        parts = [b.column("fp").to_numpy().view(np.uint64) for b in batches]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.searchsorted(values, np.array([i * width for i in range(1, owners)], np.uint64))
        chunk = TaskContext.get().partitionId()
        rows = []
        for owner, (own, repeated) in enumerate(zip(np.split(values, cuts), np.split(counts > 1, cuts))):
            if len(own):
                k, unary, rest = rice_encode(own - np.uint64(owner * width), width)
                rows.append((chunk, owner, len(own), k, unary, rest, np.packbits(repeated).tobytes()))
        names = ["chunk", "owner", "n", "k", "unary", "rest", "repeated"]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=_MESSAGE, preserve_index=False)

    return pack


_MESSAGE = pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("repeated", pa.binary())])
_MESSAGE_DDL = "chunk int, owner int, n int, k int, unary binary, rest binary, repeated binary"


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    hashes = [rice_decode(m.n, m.k, m.unary, m.rest) for m in messages.itertuples()]
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(h, shared, assume_unique=True)).tobytes() for h in hashes]
    return pd.DataFrame({"chunk": messages["chunk"], "owner": messages["owner"], "bitmap": bitmaps})


def _suspects(owners: int):
    width = -(-(1 << 64) // owners)

    def read(batches):
        for batch in batches:
            for m in batch.to_pylist():
                marks = np.frombuffer(m["bitmap"], np.uint8) | np.frombuffer(m["repeated"], np.uint8)
                marks = np.unpackbits(marks, count=m["n"]).astype(bool)
                values = rice_decode(m["n"], m["k"], m["unary"], m["rest"])[marks] + np.uint64(m["owner"] * width)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["fp"])

    return read


def _normalised(slots: np.ndarray):
    """Rows with a suspect hash, by the filter alone: a superset, grouped by bytes afterwards."""

    def read(batches):
        for batch in common.passes(batches, "text"):
            norm = [t.lower() for t in common.texts(batch, "text")]
            fp = np.array([xxhash.xxh3_64_intdigest(t) for t in norm], np.uint64)
            at = fp & np.uint64(common.FILTER_BITS - 1)
            hit = np.flatnonzero((slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
            kept = [norm[i] for i in hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(hit)), pa.array(fp[hit].view(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "fp", "text_sha256", "norm"],
            )

    return read


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, repeats.

    Texts are equal when they are the same after lower-casing A-Z; a null text is empty.
    keep_id is the largest doc_id of the group.  Rows that repeat a doc_id with its text
    count in group_size and share its verdict; ``repeats`` says how many rows carry
    keep_id.  A null doc_id is below every other; a group without any other has a null
    keep_id and keeps its rows.  An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(own.mapInArrow(_fingerprints, "doc_id long, fp long, text_sha256 string"), "fingerprints")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // OWNER_HASHES))
    messages = materialize(prints.select("fp").mapInArrow(_messages(owners), _MESSAGE_DDL), "messages")
    answers = messages.select("chunk", "owner", "n", "k", "unary", "rest").groupBy("owner").applyInPandas(_answer, "chunk int, owner int, bitmap binary")
    suspects = materialize(messages.join(answers, ["chunk", "owner"]).mapInArrow(_suspects(owners), "fp long").distinct(), "suspects")
    # the filter has at most FILTER_BITS / 64 words, 1 MiB, whatever the number of suspects
    low = F.col("fp").bitwiseAND(F.lit(common.FILTER_BITS - 1))
    one_bit = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]), (low.bitwiseAND(F.lit(63)) + 1).cast("int"))
    words = suspects.groupBy(F.shiftright(low, 6).cast("int").alias("slot")).agg(F.bit_or(one_bit).alias("bits")).toPandas()
    slots = np.zeros(common.FILTER_BITS // 64, np.uint64)
    slots[words["slot"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    rows = own.mapInArrow(_normalised(slots), "doc_id long, fp long, text_sha256 string, norm binary")
    copies = (
        rows.groupBy("fp", "text_sha256", "norm", "doc_id").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("fp", "text_sha256", "norm").agg(F.max(F.struct("doc_id", "c")).alias("top"), F.sum("c").alias("size"))
        .where(F.col("size") > 1)
        .select("fp", "text_sha256", F.col("top.doc_id").alias("keep"), F.col("top.c").alias("repeats"), "size")
    )
    own_id = F.col("doc_id")
    return prints.join(copies, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), own_id).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | own_id.eqNullSafe(F.col("keep"))).alias("kept"),
        "text_sha256",
        F.coalesce("repeats", F.lit(1)).cast("long").alias("repeats"),
    )


def _digest() -> Column:
    """text_sha256 of a row, by column functions."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, upper.lower()).cast("binary"), 256)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they came.

    Decisions hold for a doc_id with its text, so a row that shares its doc_id with
    another text is judged by its own.  Of rows that repeat both, one stays.  Rows without
    a doc_id always stay: no decision can be tied to them.
    """
    decisions = materialize(exact_dedup(docs), "exact")
    losers = decisions.where(~F.col("kept")).select("doc_id", "text_sha256")
    repeated = decisions.where(F.col("kept") & (F.col("repeats") > 1) & F.col("doc_id").isNotNull()).select("doc_id", "text_sha256")
    kept = common.without_members(docs, losers.union(repeated), "doc_id", text_sha256=_digest())
    again = common.only_members(docs, repeated, "doc_id").withColumn("__copy_digest", _digest())
    named = repeated.select(F.col("doc_id").alias("__copy_id"), F.col("text_sha256").alias("__copy_sha")).distinct()
    once = again.join(named, (F.col("doc_id") == F.col("__copy_id")) & (F.col("__copy_digest") == F.col("__copy_sha")), "left_semi")
    return kept.union(once.dropDuplicates(["doc_id", "__copy_digest"]).drop("__copy_digest"))
