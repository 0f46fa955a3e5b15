"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of shards in ascending doc_id order.  Shard N has
``N.bin`` (ids, the narrowest unsigned type that the vocabulary fits, little-endian),
``N.idx`` (n + 1 unsigned 64-bit offsets, counted in ids from the start of the data set)
and ``N.doc`` (n signed 64-bit doc_ids), all readable by memory map.  Shards are written
in parallel; the offsets follow in a second pass, from the prefix sum of the shards' sizes.

A task writes under a name of its own attempt, and only names in the manifest (a table
that Spark commits) belong to the data set, so a lost or repeated task leaves no trace.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattledger.llm import common
from wattledger.llm.units import PASS_BYTES, UnitEncoder
from wattledger.session import checkpoint_root, materialize

#: id appended to every document
END_ID = 2
#: how ``.doc`` writes a null doc_id
NO_ID = -(1 << 63)

#: unknown words that go to the library as one text
LED_WORDS = 1000

_ENCODERS: dict[str, tuple[UnitEncoder, str]] = {}


def _encoder(path: str) -> tuple[UnitEncoder, str]:
    """The library's encoder behind a unit cache, and the type of its ids; one per worker and file."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        width = "<u2" if library.get_vocab_size() <= 1 << 16 else "<u4"

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [np.array(e.ids, width) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, width), *found]), np.array([len(f) for f in found], np.int64)

        # a token with a blank in front opens a word: so many words can be encoded as one text
        opens = np.zeros(library.get_vocab_size(), bool)
        blank = library.encode(" ", add_special_tokens=False).tokens[0]
        opens[[i for token, i in library.get_vocab().items() if token.startswith(blank)]] = True

        def encode_led(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lines = [" " + " ".join(words[i : i + LED_WORDS]) for i in range(0, len(words), LED_WORDS)]
            ids = encode(lines)[0]
            return ids, np.diff(np.flatnonzero(opens[ids]), append=len(ids))

        _ENCODERS[path] = UnitEncoder(encode, width, encode_led), width
    return _ENCODERS[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    return pafs.FileSystem.from_uri(folder)


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    """A shard's file as an array; memory-mapped where the file system is local."""
    system, path = _open(folder)
    file = pa.memory_map(f"{path}/{name}") if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(f"{path}/{name}")
    with file:
        return np.frombuffer(file.read_buffer(), dtype)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the data set; returns its manifest.

    The manifest has one row per shard: part, folder, name, dtype, n_docs, n_tokens, base
    (ids in all shards before it).  Null and empty texts are documents with the end id
    alone.  Null doc_ids stand first; rows that repeat a doc_id are in order of their
    texts.  An empty table gives an empty manifest; other columns are not read.
    ``folder`` has to be new, and shared by driver and executors.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"

    def shard(batches):
        units, width = _encoder(tokenizer)
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        end = np.array([end_id], width)
        ids, ends, total = [], [], 0
        with system.open_output_stream(f"{path}/{name}.bin") as out:
            for batch in common.passes(batches, "text", PASS_BYTES):
                encoded = units(batch.column("text"))
                ends.append(total + np.cumsum(np.array([len(e) + 1 for e in encoded], np.int64)))
                total = int(ends[-1][-1])
                ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
                out.write(np.concatenate([part for e in encoded for part in (e, end)]))
        n = sum(map(len, ids))
        if not n:
            system.delete_file(f"{path}/{name}.bin")
            return
        for suffix, values in (("doc", np.concatenate(ids).astype("<i8")), ("end", np.concatenate(ends).astype("<u8"))):
            with system.open_output_stream(f"{path}/{name}.{suffix}") as out:
                out.write(values.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "name": name, "dtype": width, "n_docs": n, "n_tokens": total}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    shards = materialize(ordered.mapInArrow(shard, "part int, name string, dtype string, n_docs long, n_tokens long"), "shards")
    # one row per shard, so this order is as small as the list of tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))

    def offsets(batches):
        system, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                local = _map(folder, row["name"] + ".end", "<u8")
                values = np.concatenate([[0], local]).astype("<u8") + np.uint64(row["base"])
                part = f"{path}/{row['name']}.{TaskContext.get().taskAttemptId()}.tmp"
                with system.open_output_stream(part) as out:
                    out.write(values.tobytes())
                system.move(part, f"{path}/{row['name']}.idx")
            yield batch

    spread = based.repartitionByRange("part")
    written = materialize(spread.mapInArrow(offsets, spread.schema), "manifest")
    return written.withColumn("folder", F.lit(folder))


def read(manifest: DataFrame) -> DataFrame:
    """Documents of a data set from its files: doc_id, start (ids before it), ids (binary, little-endian unsigned 32-bit)."""

    def load(batches):
        for batch in batches:
            for row in batch.to_pylist():
                offsets = _map(row["folder"], row["name"] + ".idx", "<u8").astype(np.int64)
                docs = _map(row["folder"], row["name"] + ".doc", "<i8")
                ids = _map(row["folder"], row["name"] + ".bin", row["dtype"])
                at, base = 0, offsets[0]
                while at < len(docs):
                    # as many documents as fit one pass, one at least
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + common.PASS_BYTES // 4, "right")) - 1)
                    wide = ids[offsets[at] - base : offsets[to] - base].astype("<u4")
                    bounds = ((offsets[at : to + 1] - offsets[at]) * 4).astype(np.int64)
                    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(wide.tobytes())])
                    own = docs[at:to]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(offsets[at:to]), values.cast(pa.binary())], ["doc_id", "start", "ids"])
                    at = to

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "part").mapInArrow(load, "doc_id long, start long, ids binary")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that were written."""
    rows = read(write(docs, tokenizer))
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
