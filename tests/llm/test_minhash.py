"""Near-duplicate detection, against all pairs."""

import random
import re

import numpy as np
import pytest

from vectriage.llm import minhash, shingles
from vectriage.llm.common import raw
from vectriage.llm.components import components

SCHEMA = "doc_id long, text string"


def sets_of(rows, width):
    out = []
    for _, text in rows:
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width=3, num=85, den=100):
    sets = sets_of(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * den >= num * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {(doc, text): (len(sets[i]), least[find(i)]) for i, (doc, text) in enumerate(rows)}


def check(spark, rows, width=3, share=(85, 100)):
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width, share=share).collect()
    want = brute(rows, width, *share)
    by_doc = {}
    for (doc, _), v in want.items():
        by_doc.setdefault(doc, []).append(v)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) in by_doc[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**6)}"
    return " ".join(out)


def test_families_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = []
    for base in range(12):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 8, 20, 60, 200]))]
        for _ in range(rnd.choice([1, 4, 15])):
            rows.append((len(rows) * 3 % 101, edited(rnd, words, rnd.randrange(1 + len(words) // 15))))
    check(spark, rows)
    check(spark, rows, 5, (4, 5))


def test_edges(spark):
    rows = [(4, None), (9, ""), (2, " \t\n "), (7, "one"), (3, "ONE"), (6, "one two"), (8, "one\x0btwo"), (5, "one two three"), (11, "Été là"), (12, "été là"), (1, "one two three four"), (13, "x " * 5000), (14, "X\n" * 5000)]
    check(spark, rows)


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "a b c d")], SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [((False, 3), 3, True), ((False, 5), 3, False), ((False, 5), 3, False), ((True, None), None, True)]
    assert sorted(str(r.doc_id) for r in minhash.drop_near_duplicates(df).collect()) == ["3", "None"]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_give_what_one_comparison_gives(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rnd, words, rnd.randrange(9))) for i in range(90)]
    monkeypatch.setattr(minhash, "TILE", 16)
    check(spark, rows)


def test_large_families_of_several_groups(spark, monkeypatch):
    """Pages of one template, some of them copies of each other: one family, in which only bands of several groups are compared."""
    rnd = random.Random(6)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(rnd.choice([20, 40, 60]))]
        for _ in range(rnd.choice([1, 3, 9])):
            rows.append((len(rows) * 7 % 211, edited(rnd, template + own, rnd.randrange(4))))
    rows += [(300 + k, rows[0][1]) for k in range(5)]
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "STAR", 3)
    check(spark, rows)
    check(spark, rows, 5, (4, 5))


def test_passed_columns_and_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    df = spark.createDataFrame([(1, long, "a", 1), (2, long + " end", "b", 2), (3, None, "c", 3)], SCHEMA + ", component_id string, near int")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [("a", 1), ("c", 3)]
    assert minhash.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_overlaps_by_lists_and_by_product():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200))).astype(np.uint64) for _ in range(60)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (minhash.overlaps(sets, None) == want).all()
    assert (minhash.overlaps(sets[:25], sets[25:]) == want[:25, 25:]).all()


def test_estimate_is_close():
    rng = np.random.default_rng(4)
    errors = []
    for shared in (0, 300, 600, 900):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2000 - shared, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
            sig = shingles.registers(np.concatenate([a, b]), np.array([1000, 1000]), 128)
            errors.append(shingles.estimate(sig[:1], sig[1:], np.array([1000]), np.array([1000]))[0][0] - shared / (2000 - shared))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 501), (500, 501), (700, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_components_with_hot_nodes_nulls_and_no_edges(spark):
    edges = [(50, i) for i in range(100, 160)] + [(i, 400) for i in range(155, 300)] + [(900, 901)] + [(None, 3), (3, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {50, 400, *range(100, 300)}
    assert got == {**dict.fromkeys(nodes, 50), 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_several_pieces_and_of_one(spark):
    """One piece is one pass without an exchange, more are rounds of stars; the results are the same."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for piece in (7, 100, 1 << 20):
        got = components(df, "a", "b", piece=piece)
        rows = got.collect()
        assert len(rows) == len(least) and {r.node: r.component for r in rows} == least
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (piece < len(edges))


def test_words_by_bytes():
    import pyarrow as pa

    texts = ["a b a b a", "", "É É", " x", "a b"]
    h, counts = shingles.words(*raw(pa.array(texts)))
    assert counts.tolist() == [5, 0, 2, 1, 2]
    assert h[0] == h[2] == h[4] == h[8] and h[1] == h[3] == h[9] and h[5] == h[6] and len(set(h.tolist())) == 4


def test_query(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {k[0]: v for k, v in brute(docs).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_near_duplicates"](spark, sf_dir).collect()}
    assert got == want


def test_arguments(spark):
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame([], SCHEMA), share=(1, 3))
