"""Nearest neighbours, against scoring everything."""

import numpy as np
import pytest

from vectriage.llm import vptree

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in sound:
        if q % every == 0:
            scores = sorted((-float((v * w).sum()), i) for i, w in sound if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert by.keys() == {q for q, x in want.items() if x}
    for q, found in by.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(want[q]) + 1))
        assert [x[1] for x in found] == [i for i, _ in want[q]]
        assert np.allclose([x[2] for x in found], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_ties_lengths_and_unsound_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] * (1 + i % 3)]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0] * 7 + [None]), (1004, [1.0] * 7 + [float("nan")]), (1005, [1.0] * 7 + [float("inf")]), (None, [1.0] * 8)]
    compare(vptree.nearest(spark.createDataFrame(rows, SCHEMA), every=20, k=20).collect(), brute(rows, 20, 20))


@pytest.mark.parametrize("kind", ["line", "integers", "signs"])
def test_ties_between_different_vectors(spark, kind):
    rng = np.random.default_rng(11)
    if kind == "line":  # all of one score, for the query (1, 0)
        rows = [(i, [1.0, i / 3000]) for i in range(3000)]
        rows[0] = (0, [1.0, 0.0])
    elif kind == "integers":
        rows = [(i, [float(x) for x in rng.integers(0, 2, 12)]) for i in range(3000)]
    else:
        rows = [(i, [float(x) for x in rng.choice([-1, 1], 16)]) for i in range(3000)]
    compare(vptree.nearest(spark.createDataFrame(rows, SCHEMA), every=60, k=20).collect(), brute(rows, 60, 20))


def test_repeated_ids_and_other_columns(spark):
    rows = [(i % 40, [1.0 + i % 7, float(i % 5)], "x") for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = vptree.nearest(df, every=20, k=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    vectors = [(i, np.array(v)) for i, v, _ in rows]
    for q in (0, 20):
        asked = min(tuple(v) for i, v in vectors if i == q)
        want = sorted((-float(v @ np.array(asked)), i) for i, v in vectors if i != q)[:3]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got.where(f"query_id = {q}").collect()) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_fewer_than_k_and_none(spark):
    rows = [(i, [1.0, float(i)]) for i in range(5)]
    compare(vptree.nearest(spark.createDataFrame(rows, SCHEMA), every=2, k=20).collect(), brute(rows, 2, 20))
    assert vptree.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vptree.nearest(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0


def test_query(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(QUERIES["op7_vantage_point_search"](spark, sf_dir).collect(), brute(rows, 20, 20))


def test_pruning_and_factor():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 6)) * 8
    v = (centers[rng.integers(0, 40, 20000)] + rng.normal(size=(20000, 6)) * 0.3)
    top = np.sqrt((v**2).sum(1)).max()
    tree = vptree.Tree(np.hstack([v, np.sqrt(np.maximum(top**2 - (v**2).sum(1), 0))[:, None]]))
    q = v[:100]
    want = np.sort(q @ v.T, axis=1)[:, -10:]
    best, made = vptree.search(tree, v, q, top, 10, 1.0)
    assert np.allclose(np.sort(best.scores, axis=1), want) and made < 0.8 * 100 * 20000
    found = {}
    for factor in (1.02, 1.05, 1.3):
        relaxed, fewer = vptree.search(tree, v, q, top, 10, factor)
        assert fewer <= made
        made, found[factor] = fewer, (relaxed.scores >= want[:, :1] - 1e-9).mean()
    assert found[1.02] > 0.9 and found[1.02] >= found[1.05] >= found[1.3]


def test_several_lengths_need_a_choice(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 30)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="2 to 3 components"):
        vptree.nearest(df)
    compare(vptree.nearest(df, every=4, k=3, dim=2).collect(), brute(rows[:29], 4, 3))


@pytest.mark.parametrize("kind", ["double", "int"])
def test_other_kinds_of_components_and_many_units(spark, kind):
    rng = np.random.default_rng(13)
    rows = [(i, [kind == "int" and int(x) or float(x) for x in rng.integers(1, 9, 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    compare(vptree.nearest(df, every=5, k=7, shard_bytes=100, query_block=20).collect(), brute(rows, 5, 7))


def test_recall_of_relaxed_pruning(spark):
    """A factor above 1 gives up little: nine in ten of the nearest are found."""
    rng = np.random.default_rng(14)
    centers = rng.normal(size=(30, 8)) * 4
    rows = [(i, [float(x) for x in centers[i % 30] + rng.normal(size=8) * 0.5]) for i in range(6000)]
    want = brute(rows, 60, 10)
    got = vptree.nearest(spark.createDataFrame(rows, SCHEMA), every=60, k=10, factor=1.1).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert np.mean([(q, i) in found for q, near in want.items() for i, _ in near]) >= 0.9


def test_arguments(spark):
    with pytest.raises(ValueError):
        vptree.nearest(spark.createDataFrame([], SCHEMA), k=0)
