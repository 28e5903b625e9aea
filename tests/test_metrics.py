"""Metrics on hand-made frames, against brute force and invariances."""

import itertools
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vectriage.operators import bootstrap, metrics

SCHEMA = "id long, label string, y int, score double"


def ap_brute(y, s):
    out, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(a for a, b in zip(y, s) if b >= t)
        r = tp / sum(y)
        out += (r - recall) * tp / sum(b >= t for b in s)
        recall = r
    return out


def auc_brute(y, s):
    pairs = [(a, b) for (p, a), (n, b) in itertools.product(zip(y, s), zip(y, s)) if p and not n]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


TIES = [(0, "t", 1, 0.8), (1, "t", 0, 0.8), (2, "t", 1, 0.4), (3, "t", 0, 0.4), (4, "t", 1, 0.4), (5, "t", 0, 0.0)]


def test_ties(spark):
    df = spark.createDataFrame(TIES, SCHEMA)
    r = metrics.ranking(df, []).first()
    y, s = [x[2] for x in TIES], [x[3] for x in TIES]
    assert math.isclose(r.ap, ap_brute(y, s)) and math.isclose(r.auroc, auc_brute(y, s))
    b = metrics.ranking(df, [], buckets=4).first()
    assert math.isclose(r.ap, b.ap) and math.isclose(r.auroc, b.auroc)
    ranked = metrics.average_precision_ranked(df, []).first().ap_rank
    order = sorted(TIES, key=lambda x: (-x[3], x[0]))
    assert math.isclose(ranked, sum(sum(q[2] for q in order[: i + 1]) / (i + 1) for i, x in enumerate(order) if x[2]) / 3)


def test_degenerate_labels_are_null(spark):
    rows = [(i, "none", 0, i / 9) for i in range(9)] + [(i, "all", 1, i / 9) for i in range(9)] + [(i, "one", int(i == 4), i / 9) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.label: r for r in metrics.ranking(df, []).collect()}
    assert got["none"].ap is None and got["none"].auroc is None and got["all"].ap == 1.0 and got["all"].auroc is None
    assert got["one"].auroc == 0.5
    assert [r.label for r in metrics.per_class(df, []).collect()] == ["one"]
    assert {r.label for r in metrics.enough(df, [], 9).select("label").distinct().collect()} == {"all"}
    s = df.select("label").distinct().withColumn("ap", metrics.F.lit(1.0)).withColumn("p", metrics.F.when(metrics.F.col("label") == "all", 1.0).otherwise(0.25))
    assert {r[0]: (r[1], r[2]) for r in s.select("label", metrics.skill(metrics.F.col("ap"), metrics.F.col("p")), metrics.skill(metrics.F.col("ap"), metrics.F.col("p"), False)).collect()}["all"] == (0.0, None)


def test_perfect_and_constant_scores(spark):
    rows = [(i, "perfect", int(i > 6), i * 1.0) for i in range(10)] + [(i, "constant", int(i > 6), 0.5) for i in range(10)]
    got = {r.label: r for r in metrics.per_class(spark.createDataFrame(rows, SCHEMA), []).collect()}
    assert got["perfect"].skill == 1 and got["perfect"].roc_auc == 1 and got["constant"].roc_auc == 0.5 and abs(got["constant"].skill) < 1e-12


def test_threshold_metrics(spark):
    rows = [(0, "a", 1, 0.9), (0, "b", 0, 0.1), (1, "a", 0, 0.6), (1, "b", 1, 0.7), (2, "a", 1, 0.2), (2, "b", 0, 0.3)]
    r = metrics.threshold_metrics(spark.createDataFrame(rows, SCHEMA), []).first()
    assert math.isclose(r.hamming_accuracy, 4 / 6) and math.isclose(r.subset_accuracy, 1 / 3)
    assert math.isclose(r.macro_f1, (0.5 + 1) / 2, rel_tol=1e-6) and math.isclose(r.micro_f1, 4 / 6, rel_tol=1e-6)


def test_weights_are_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a", int(rng.random() < 0.4), float(rng.integers(0, 5)), int(rng.integers(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", w int")
    repeated = spark.createDataFrame([r[:4] for r in rows for _ in range(r[4])], SCHEMA)
    a, b = metrics.ranking(df, [], "w").first(), metrics.ranking(repeated, []).first()
    assert math.isclose(a.ap, b.ap) and math.isclose(a.auroc, b.auroc) and math.isclose(a.prevalence, b.prevalence)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40).filter(lambda x: 0 < sum(a for a, _ in x) < len(x)))
def test_kernel_against_brute_force(rows):
    y, s = np.array([a for a, _ in rows], float), np.array([b for _, b in rows], float)
    ap, auc, prev = bootstrap._runs(y, s, np.ones((1, len(y)), int))
    assert math.isclose(ap[0], ap_brute(y, s)) and math.isclose(auc[0], auc_brute(y, s)) and math.isclose(prev[0], y.mean())
    again = bootstrap._runs(y[::-1], np.exp(s[::-1]), np.ones((1, len(y)), int))
    assert math.isclose(ap[0], again[0][0]) and math.isclose(auc[0], again[1][0])


def test_fast_runs_equal_the_relational_ones(spark):
    from vectriage.operators import folds

    rng = np.random.default_rng(5)
    rows = [(i, l, int(rng.random() < 0.3), float(rng.integers(0, 8)), i % 12) for i in range(80) for l in ("a", "b")]
    df = spark.createDataFrame(rows, SCHEMA + ", grp long")
    units = df.select("grp").distinct()
    slow = {(r.label, r.b): (r.ap, r.auroc, r.skill) for r in bootstrap.runs(df, folds.resamples(units, "grp", 7, 3), "grp", []).collect()}
    fast = {(r.label, r.b): (r.ap, r.auroc, r.skill) for r in bootstrap.fast_runs(df, units, "grp", [], 7, 3).collect()}
    assert slow.keys() == fast.keys()
    for k in slow:
        assert np.allclose([x if x is not None else -1 for x in slow[k]], [x if x is not None else -1 for x in fast[k]])


def test_paired_with_itself_is_a_tie(spark):
    rows = [(b, "a", b / 10) for b in range(30)]
    run = spark.createDataFrame(rows, "b long, label string, value double")
    r = bootstrap.paired(run, run, ["label"]).first()
    assert r.diff == 0 and r.sig == "ns"
    better = run.withColumn("value", metrics.F.col("value") + 1)
    assert bootstrap.paired(better, run, ["label"]).first().sig == "A" and bootstrap.paired(run, better, ["label"]).first().sig == "B"


def test_numpy_resamples_have_the_right_size():
    for mode in ("mix", "numpy"):
        m = bootstrap.multiplicities(40, 57, 42, mode)
        assert m.shape == (40, 57) and (m.sum(1) == 57).all() and 0.7 < m.var() < 1.3


def test_precision_by_rank_of_weighted_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "l", int(rng.random() < 0.4), float(rng.integers(0, 6)), int(rng.integers(0, 4))) for i in range(40)] + [(i, "none", 0, 0.5, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, label string, y int, score double, mult int")
    got = {r.label: r.ap_rank for r in metrics.average_precision_ranked(df, [], "mult").collect()}
    y = [r[2] for r in sorted(rows[:40], key=lambda r: (-r[3], r[0])) for _ in range(r[4])]
    want = sum(sum(y[: k + 1]) / (k + 1) for k in range(len(y)) if y[k]) / sum(y)
    assert abs(got["l"] - want) < 1e-12 and got["none"] is None
    assert abs(metrics.macro_pr_auc(df, [], "mult").first().macro_pr_auc - want) < 1e-12
