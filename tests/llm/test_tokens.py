"""Encoders and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import clashing, documents, empty
from tokenizers import Tokenizer

from wattledger.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", "'s", "'ll", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "1", "23", ".", "!!", "<|endoftext|>", " ", "　", "\x1c", "\x85", "​", "é", "x" * 50, "\r\n", "ſ", "½", "\x00", "᠎", "Ġ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def awkward(n):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    return texts + ["".join(rng.choice("ab ") for _ in range(60)) for _ in range(50)] + ["x" * 20_000, "ab" * 5_000, " " * 3_000, "", None]


def test_prefix_encoder_equals_library(library):
    encoder, units = bpe.loaded(PATH)
    texts = [t or "" for t in awkward(1500)]
    for packed, want in zip(units(texts), library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(packed, encoder.width)
        assert ids.tolist() == want.ids
        assert encoder.decode(ids).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_every_token_encodes_as_the_library_does(library):
    encoder, _ = bpe.loaded(PATH)
    texts = [t.decode() for t in encoder.tokens[::7] if t.decode("utf-8", "ignore").encode() == t]
    for packed, want in zip(encoder.encode_many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, encoder.width).tolist() == want.ids


def test_bpe_digests(spark, library):
    texts = awkward(100)
    got = {r.doc_id: r for r in bpe.digests(documents(spark, texts), PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty(spark), PATH).count() == 0


def test_token_files(spark, library):
    texts = awkward(150)
    df = documents(spark, texts, first=5).repartition(4)
    got = sorted(token_files.digests(df, PATH).collect(), key=lambda r: r.doc_id)
    start = 0
    for row, text in zip(got, texts, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_on_disk(spark, tmp_path):
    manifest = token_files.write(documents(spark, ["one two", None, "three"]).repartition(2), PATH, f"file://{tmp_path}/set").collect()
    docs, offsets, tokens = [], [], []
    for shard in sorted(manifest, key=lambda r: r.part):
        base = np.memmap(f"{tmp_path}/set/{shard.name}.idx", "<u8", "r")
        assert base[0] == shard.base == sum(map(len, tokens))
        tokens.append(np.memmap(f"{tmp_path}/set/{shard.name}.bin", shard.dtype, "r"))
        docs += np.memmap(f"{tmp_path}/set/{shard.name}.doc", "<i8", "r").tolist()
        offsets += base[:-1].tolist()
        assert shard.dtype == "<u2" and base[-1] - base[0] == len(tokens[-1])
    assert docs == [0, 1, 2] and offsets == sorted(offsets)


def test_token_files_nulls_repeats_and_empty_table(spark):
    df = clashing(spark.createDataFrame([(2, "b"), (None, "a"), (2, "a"), (2, "b")], "doc_id long, text string"))
    rows = token_files.digests(df, PATH).collect()
    assert sorted((r.start, r.doc_id) for r in rows) == [(0, None), (2, 2), (4, 2), (6, 2)]
    assert token_files.digests(empty(spark), PATH).count() == 0
