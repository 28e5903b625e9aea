"""Removal of repeated passages, against a brute-force search over all windows."""

import hashlib
import random

import numpy as np
import pytest

from vectriage.llm import suffix

SCHEMA = "doc_id long, text string"


def brute(rows, window=50):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, kept)}"""
    least = {}
    for doc, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            if doc is not None:
                w = b[p : p + window]
                least[w] = min(least.get(w, doc), doc)
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if doc is not None and least[b[p : p + window]] < doc:
                gone[p : p + window] = True
        spans = int(np.sum(gone[:-1] & ~np.r_[False, gone[:-2]])) if len(b) else 0
        out[doc, text] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def check(spark, rows, **options):
    found = suffix.remove_repeated(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, r.text], r.doc_id
        assert len(r.removed_spans) == r.n_spans and sum(s.end - s.start for s in r.removed_spans) == r.n_removed


def words(rnd, n):
    return " ".join(rnd.choice(["the", "of", "größe", "and", "ation", "le", "日本", "thou"]) + rnd.choice(["", "s", "ing"]) for _ in range(n))


def test_planted_passages(spark):
    rnd = random.Random(5)
    passage, rows = [words(rnd, 30) for _ in range(4)], []
    for i in range(60):
        parts = [words(rnd, rnd.randint(0, 40)) for _ in range(3)]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passage)
            a = rnd.randint(0, 60)
            parts.insert(rnd.randint(0, 3), p[a : a + rnd.randint(30, 200)])
        rows.append((i * 7, rnd.choice(["", " "]).join(parts)))
    check(spark, rows)
    check(spark, rows, direct=8)  # by way of ranges of parts


def test_edges(spark):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(120))
    rows = [
        (None, base), (5, base), (5, base), (9, base), (7, None), (8, ""), (10, "x" * 49), (11, "x" * 49), (12, "a" * 3000), (13, "a" * 400 + base[:49]),
        (14, base[:50]), (15, base[1:51] + base[3:55]), (16, "ab" * 700), (17, "ba" * 300), (18, base[40:] + "b" + base[:60]), (-3, base[20:90]), (20, base[:60] + base[50:]),
    ]
    check(spark, rows)
    check(spark, rows, direct=8)


def test_very_long_texts_and_a_part_in_many_ranges(spark, monkeypatch):
    rnd = random.Random(8)
    shared = words(rnd, 3000)
    rows = [(1, words(rnd, 40000) + shared), (2, shared[100:] + words(rnd, 9000)), (3, "a" * 30000 + shared[:7000]), (4, "a" * 20000)]
    monkeypatch.setattr(suffix, "SUB_BYTES", 1 << 10)
    check(spark, rows)
    asked = [[np.array([b], np.int32), np.array([3]), np.array([5, 5, 9], np.uint64), np.array([b, b + 1, b]), np.array([60, 50, 70], np.uint32), rng_bytes(rnd, 180)] for b in (1, 2)]
    blobs = [suffix.pack(*m) for m in asked]
    import pyarrow as pa

    table = pa.table({"group": pa.array([1, 2], pa.int32()), "blob": pa.array(blobs, pa.binary())})
    small = [suffix.unpack(b)[-1].tolist() for _, b in suffix.answer_contexts(table, 50)]
    monkeypatch.setattr(suffix, "SUB_BYTES", 1 << 21)
    assert small == [suffix.unpack(b)[-1].tolist() for _, b in suffix.answer_contexts(table, 50)]


def rng_bytes(rnd, n):
    return np.frombuffer("".join(rnd.choice("ab") for _ in range(n)).encode(), np.uint8)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_bytes string, extra array<int>")
    out = suffix.remove_repeated(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "extra", "kept", "n_bytes", "n_removed", "n_spans", "removed_spans"]
    df = spark.createDataFrame([(1, "y" * 60, "q", [1]), (2, "y" * 60, None, None)], df.schema)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.extra) for r in suffix.remove_repeated(df).collect()) == [(1, 60, 0, [1]), (2, 60, 60, None)]


def test_refinement_against_sorting():
    rnd = random.Random(3)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(50, 90))) for _ in range(80)] + ["ab" * 40, "a" * 77]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    lengths = np.array([len(s) for s in strings])
    buckets = suffix.window_buckets(data, np.cumsum(lengths) - lengths, lengths, 50)
    found = {}
    windows = [s[p : p + 50] for s in strings for p in range(len(s) - 49)]
    for w, b in zip(windows, buckets):
        assert found.setdefault(b, w) == w
    assert len(found) == len(set(windows))


def test_query(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(docs)
    got = QUERIES["op3_suffix_dedup"](spark, sf_dir).collect()
    texts = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        n, gone, spans, kept = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_arguments(spark):
    with pytest.raises(ValueError):
        suffix.remove_repeated(spark.createDataFrame([], SCHEMA), window=4)
    with pytest.raises(ValueError):
        suffix.remove_repeated(spark.createDataFrame([], "a long"))
