"""Byte-level BPE, against the library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectriage.llm import bpe
from vectriage.llm.queries import pattern, vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("whole", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


def wide(ids):
    return np.array(ids, "<u4").tobytes()


PARTS = ["the", "of", "größe", "日本", "'s", "don't", "\n", "\t", " ", "  ", " ", " ", "<|endoftext|>", "123", "4", "!!", "\r\n", "a.b", "é", "é", "☃", "‍", "😀", "\x00", "x" * 70]


def test_cutting_long_texts_changes_no_id(library, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 20)
    for _ in range(600):
        text = "".join(rnd.choice(PARTS) + rnd.choice(["", " ", "", " "]) for _ in range(rnd.randint(0, 40)))
        assert "".join(bpe.pieces(text, 20)) == text
        assert bpe.ids_of(library, text) == wide(library.encode_ordinary(text))


def test_long_texts_with_and_without_boundaries(spark, library):
    rnd = random.Random(7)
    prose = " ".join(rnd.choice(["the", "größe", "and", "über", "日本", "x9"]) for _ in range(60000))
    texts = [prose, "ab" * 3000, "é" * 2000, "日本" * 1500, "\n" * 4000, " " * 4000, "9" * 3000, "a  b" * 40000, "." * 2000 + prose]
    rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), SCHEMA), PATH, pattern())
    for r in bpe.decode(rows, PATH, pattern()).collect():
        assert bytes(r.ids) == wide(library.encode_ordinary(texts[r.doc_id])) and bytes(r.decoded).decode() == texts[r.doc_id]


def test_edges_and_clashing_columns(spark, library):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (3, "a <|endoftext|> b", None, 3), (3, "a <|endoftext|> b", None, 3), (None, "tie", "z", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", ids string, decoded int")
    out = bpe.decode(bpe.encode(df, PATH, pattern()), PATH, pattern())
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and dict(out.dtypes)["ids"] == dict(out.dtypes)["decoded"] == "binary"
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()), key=str)
    assert got == sorted(((i, wide(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _, _ in rows), key=str)
    both = bpe.round_trip(df, PATH, pattern())
    assert both.columns == out.columns and sorted(map(str, both.collect())) == sorted(map(str, out.collect()))
    assert bpe.decode(bpe.encode(df.limit(0), PATH, pattern()), PATH, pattern()).count() == bpe.round_trip(df.limit(0), PATH, pattern()).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, pattern(), text="missing")


def test_decoding_gives_raw_bytes(spark, library):
    part = library.encode_ordinary("日本")[:1]
    df = spark.createDataFrame([(1, bytearray(wide(part))), (2, None), (3, bytearray())], "doc_id long, ids binary")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, PATH, pattern()).collect()}
    assert got == {1: library.decode_bytes(part), 2: b"", 3: b""}


def test_query(spark, sf_dir, library):
    from vectriage.llm.queries import QUERIES

    got = {tuple(r) for r in QUERIES["op9_bpe_roundtrip"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = set()
    for r in docs:
        ids = library.encode_ordinary(r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(wide(ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert got == want
