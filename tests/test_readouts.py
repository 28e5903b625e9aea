"""Neighbours, probes, zero-shot scores and rank statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectriage.operators import folds, knn, metrics, probe, report, stats, zeroshot
from vectriage.plans import catalog


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 90)
    v = rng.normal(size=(90, 6)) + 2.0 * y[:, None] * np.array([1, 1, 0, 0, 0, 0])
    v[7] = 0
    v[8] = v[9]
    scans = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)], "id long, v array<double>")
    labels = spark.createDataFrame([(i, "a", int(y[i])) for i in range(90)], "id long, label string, y int")
    return v, y, scans, labels, folds.kfold(scans.select("id"), folds=4)


def test_neighbours_against_brute_force(study, monkeypatch):
    v, _, scans, _, split = study
    fold = {r.id: r.fold for r in split.collect()}
    n = np.maximum(np.linalg.norm(v, axis=1), 1e-8)
    sim = v @ v.T / n[:, None] / n[None, :]
    want = {i: [t for _, t in sorted((-round(sim[i, t], 12), t) for t in range(90) if fold[t] != fold[i])[:5]] for i in range(90)}
    for rows in (4096, 20):
        monkeypatch.setattr(knn, "BLOCK_ROWS", rows)
        got = {}
        for r in knn.neighbours(scans, split, 5).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.train_id)
        assert sum(got[i] != want[i] for i in range(90)) <= 1  # the zero vector ties with everything
    assert knn.neighbours(scans, split, 500, impl="sql").groupBy("id").count().agg(F.max("count")).first()[0] < 90
    with pytest.raises(ValueError):
        knn.neighbours(scans, split, 0)


def test_votes(study):
    _, _, scans, labels, split = study
    for weighting in ("uniform", "distance"):
        r = metrics.per_class(knn.pool(scans, labels, split, 5, weighting), []).first()
        assert r.n_samples == 90 and r.roc_auc > 0.75
    with pytest.raises(ValueError):
        knn.pool(scans, labels, split, 5, "other")


def test_logistic_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 5)), (rng.random(80) < 0.2).astype(float)
    w, b = probe.fit_logistic(x, y)
    weight = np.where(y > 0, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))

    def loss(w, b):
        return 0.5 * w @ w + (weight * np.logaddexp(0, -(2 * y - 1) * (x @ w + b))).sum()

    best = loss(w, b)
    for _ in range(50):
        assert loss(w + rng.normal(size=5) * 1e-3, b + rng.normal() * 1e-3) >= best


def test_probe_against_spark_ml(study, spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    v, y, scans, labels, _ = study
    w, b = probe.fit_logistic(v, y.astype(float))
    n, n_pos = len(y), y.sum()
    df = scans.join(labels, "id").select(array_to_vector("v").alias("features"), F.col("y").cast("double").alias("label"), F.when(F.col("y") == 1, n / (2 * n_pos)).otherwise(n / (2 * (n - n_pos))).alias("w"))
    m = LogisticRegression(regParam=1 / n, elasticNetParam=0, standardization=False, weightCol="w", maxIter=500, tol=1e-12).fit(df)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-4) and abs(m.intercept - b) < 1e-4


def test_probe_scores_and_fallback(study, spark):
    _, _, scans, labels, split = study
    out = probe.probe_scores(scans, labels, split)
    assert out.count() == 90 and metrics.per_class(out, []).first().roc_auc > 0.8
    none = labels.withColumn("y", F.lit(0))
    assert {r.score for r in probe.probe_scores(scans, none, split).collect()} == {0.0}
    curve = probe.budget_curve(scans, labels, split, [10, 1000], min_pos=5).collect()
    assert len(curve) == 2 and sorted(r.budget for r in curve)[0] == 10


def test_zero_shot(spark):
    scorer = zeroshot.build_scorer("hash-64")
    prompts = zeroshot.prompt_table(spark, ["soft_tissue", "Lung nodule", "other_thing"], scorer)
    got = {r.label: (r.positive, r.negative) for r in prompts.collect()}
    assert got["other_thing"] == ("A chest CT scan showing other thing.", "A chest CT scan showing no other thing.")
    assert got["Lung nodule"][0] == "A chest CT scan showing a lung nodule."
    r = prompts.where("label = 'soft_tissue'").first()
    scans = spark.createDataFrame([(1, r.pos), (2, r.neg)], "id long, v array<double>")
    s = {x.id: x.score for x in zeroshot.score(scans, prompts.where("label = 'soft_tissue'")).collect()}
    cos = float(np.dot(r.pos, r.neg))
    assert math.isclose(s[1], 1 / (1 + math.exp(-(1 - cos)))) and math.isclose(s[2], 1 / (1 + math.exp(-(cos - 1))))
    with pytest.raises(ValueError):
        zeroshot.build_scorer("none")


def test_kendall_and_spearman(spark):
    rows = [(r, i, float(v)) for r, vs in {"a": [1, 2, 3, 4], "b": [1, 2, 3, 4], "c": [4, 3, 2, 1]}.items() for i, v in zip("wxyz", vs)] + [("a", "gap", 9.0)]
    df = spark.createDataFrame(rows, "rater string, item string, v double")
    k = stats.kendall_w(df, "rater", "item", "v").first()
    sums = [1 + 1 + 4, 2 + 2 + 3, 3 + 3 + 2, 4 + 4 + 1]
    assert (k.m, k.n) == (3, 4) and math.isclose(k.w, 12 * sum((s - 7.5) ** 2 for s in sums) / (9 * 60))
    assert {(r.rater_a, r.rater_b): round(r.rho, 9) for r in stats.spearman_pairs(df, "rater", "item", "v").collect()} == {("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0}


def test_bands_never_meet(spark):
    df = spark.createDataFrame([("c", f"l{i}", i / 10) for i in range(7)] + [("d", "only", 0.5)], "cohort string, label string, p double")
    out = report.bands(df, "cohort", "label", "p").collect()
    assert {r.label for r in out if r.band == "top"} == {"l4", "l5", "l6"} and {r.label for r in out if r.band == "bottom"} == {"l0", "l1", "l2"}


def test_report_tables(spark):
    df = spark.createDataFrame([("a", "m1", 0.5), ("a", "m2", None), ("b", "m1", 0.25)], "label string, model string, v double")
    wide = report.wide(df, "label", "model", ["m1", "m2", "m3"], ["v"])
    assert {tuple(r) for r in wide.collect()} == {("a", 0.5, None, None), ("b", 0.25, None, None)}
    assert {r.line for r in report.latex_rows(wide, "label", ["m1_v", "m2_v"]).collect()} == {r"a & 0.500 & -- \\", r"b & 0.250 & -- \\"}
    assert "a    0.500" in {r.line for r in report.fixed_width(wide, {"label": 3, "m1_v": 6}).collect()}
    assert report.best(df, ["label"], "model", "v").count() == 2


def test_projected_scorers_check_their_dimensions(spark):
    encode = lambda prompts: np.ones((len(prompts), 2))
    scorer = zeroshot.ProjectedScorer("p", encode, np.array([[1.0, 0, 2], [0, 1, 0]]), np.array([0.5, 0.0]))
    scans = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, v array<double>")
    assert zeroshot.project(scans, scorer).first().v == [7.5, 2.0]
    with pytest.raises(ValueError):
        zeroshot.ProjectedScorer("p", encode, np.ones((3, 4)))
    with pytest.raises(Exception, match="wants vectors of 3"):
        zeroshot.project(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), scorer).collect()


@pytest.mark.parametrize("rows", [1, 7, 2048])
def test_neighbours_by_pairs_of_blocks_are_those_of_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(knn, "PAIR_ROWS", rows)
    rng = np.random.default_rng(8)
    vs = [[float(x) for x in v] for v in rng.integers(-2, 3, (20, 3))]  # many ties, and zero vectors
    scans = spark.createDataFrame([(m, i, v) for m in ("a", None) for i, v in enumerate(vs)], "model string, id long, v array<double>")
    split = spark.createDataFrame([(i, r, i % 4 - 1) for i in range(20) for r in (0, 1)], "id long, repeat int, fold int")
    found = {impl: sorted(((str(r.model), r.repeat, r.id, r["rank"], r.train_id, round(r.sim, 9)) for r in knn.neighbours(scans, split, 5, impl, ["model"]).collect())) for impl in ("join", "block")}
    assert found["join"] == found["block"] and len(found["join"]) == 2 * 2 * 15 * 5


def test_the_join_of_neighbours_has_no_row_for_each_pair(spark, sf_dir):
    plan = catalog.QUERIES["cosine_knn_topk_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapGroupsInArrow" in plan
