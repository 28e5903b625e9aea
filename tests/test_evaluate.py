"""Evaluations from a configuration, and volume files."""

import gzip
import struct
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.group import GroupedData

from vectriage.operators import bootstrap, volumes
from vectriage.plans import evaluate
from vectriage.plans.evaluate import EvalConfig


def test_configuration():
    cfg = EvalConfig.of({"k": 3}, n_boot=10)
    assert (cfg.k, cfg.n_boot, cfg.weighting) == (3, 10, "distance") and EvalConfig(**cfg.as_dict()) == cfg
    for bad in ({"k": 0}, {"strategy": "x"}, {"weighting": "x"}, {"kk": 1}):
        with pytest.raises(ValueError):
            EvalConfig.of(bad)


def test_evaluation_and_comparison(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 60)
    signal = rng.normal(size=(60, 4)) + 2.0 * y[:, None]
    noise = rng.normal(size=(60, 4))
    rows = [(m, f"valid_{i // 2}_a_{i % 2}", [float(x) for x in v[i]]) for m, v in (("good", signal), ("bad", noise)) for i in range(60)]
    scans = spark.createDataFrame(rows, "model string, id string, v array<double>")
    labels = spark.createDataFrame([(f"valid_{i // 2}_a_{i % 2}", "l", int(y[i])) for i in range(60)], "id string, label string, y int")
    cfg = EvalConfig(folds=3, n_boot=25, min_pos=5)
    scores = evaluate.pooled(scans, labels, cfg, ["model"])
    assert scores.count() == 120 and scores.select("grp").distinct().count() == 30
    scores = scores.persist()
    results = evaluate.evaluate(scores, cfg, ["model"]).collect()
    for r in results:
        assert r.ci95_low <= r.ci95_high
    assert {r.metric for r in results if r.label is None} == {"macro_f1", "micro_f1", "subset_accuracy", "hamming_accuracy", "macro_pr_auc"}
    pairs = evaluate.compare(scores, cfg, ["good", "bad"])
    found = {r.label: r for r in pairs.collect()}
    assert found["l"].sig == "A" and found[None].sig == "A" and found["l"].point_diff > 0
    table = evaluate.pair_table(pairs.where("label is not null"), ["good vs bad"]).first()
    assert table["good vs bad_sig"] == "A"
    scores.unpersist()


def test_nifti():
    voxels = np.arange(24, dtype="<i2").reshape(2, 3, 4) - 5
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 2, 0, 0, 0, 0)
    struct.pack_into("<f", head, 108, 352)
    head[344:348] = b"n+1\0"
    data = bytes(head) + voxels.tobytes(order="F")
    for content in (data, gzip.compress(data)):
        v, affine = volumes.load_nifti(content, 2.0, 1.0)
        assert (v == voxels * 2.0 + 1).all() and affine.diagonal().tolist() == [-0.5, -0.5, 2, 1]
    with pytest.raises(ValueError):
        volumes.load_nifti(b"nothing")


def test_patches_and_windows():
    v = np.linspace(-1000, 1000, 6 * 6 * 6).reshape(6, 6, 6)
    assert volumes.ct_windows(v, [(0, 400), (-600, 1500)]).shape == (2, 6, 6, 6)
    assert volumes.adaptive_spacing((0.5, 0.6, 2)) == (0.75,) * 3 and volumes.adaptive_spacing((1.5, 1, 2)) == (1,) * 3
    assert volumes.patch_budget(v, (2, 2, 2), 18).size == 18 * 8
    assert volumes.pooled_projection(np.ones((3, 2, 2)), np.ones((1, 4)), np.zeros(1)).tolist() == [4.0]


def test_configurations_from_files(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text('{"k": 7, "strategy": "${STRATEGY:-kfold}", "unit": "${UNIT_OF}"}')
    with pytest.raises(KeyError):
        evaluate.EvalConfig.read(str(path))
    monkeypatch.setenv("UNIT_OF", "id")
    cfg = evaluate.EvalConfig.read(str(path), n_boot=3)
    assert (cfg.k, cfg.strategy, cfg.unit, cfg.n_boot) == (7, "kfold", "id", 3)


def test_pairs_are_done_again_when_a_cache_is_newer(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "model_a string, model_b string")
    done = spark.createDataFrame([("a", "b", 5), ("a", "c", 5)], "model_a string, model_b string, written int")
    caches = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "model string, written int")
    assert {tuple(r) for r in evaluate.stale_pairs(pairs, done, caches).collect()} == {("a", "c"), ("b", "c")}


def test_orders_and_unit_tables(spark):
    from vectriage.operators import bootstrap, report

    df = spark.createDataFrame([("m1", 0.1), ("m1", 0.9), ("m2", 0.5), ("m3", 0.9), ("m3", 0.8)], "model string, v double")
    assert [r.model for r in report.by_greatest(df, "model", "v").orderBy("place").collect()] == ["m1", "m3", "m2"]
    assert [r.model for r in report.by_difficulty(df, "model", "v").orderBy("place").collect()] == ["m3", "m1", "m2"]
    assert [r.model for r in report.by_median(df, "model", "v").orderBy("place").collect()] == ["m1", "m2", "m3"]
    run = spark.createDataFrame([("m", "x", 0, 0.2), ("m", "y", 0, 0.4), ("m", "z", 0, None)], "model string, label string, b long, skill double")
    types = spark.createDataFrame([("x", "focal"), ("y", "focal"), ("z", None)], "label string, finding_type string")
    out = {r.finding_type: round(r.value, 9) for r in bootstrap.units_table(run, ["model"], types).collect()}
    assert out == {None: 0.3, "focal": 0.3}


def test_scalar_pairs_as_one_row_each(spark):
    rng = np.random.default_rng(6)
    rows = [(m, str(i), i % 7, "l", int(i % 3 == 0), float(rng.random())) for m in ("a", "b") for i in range(40)]
    scores = spark.createDataFrame(rows, "model string, id string, grp int, label string, y int, score double")
    cfg = evaluate.EvalConfig(n_boot=4)
    wide = evaluate.macro_pair_table(evaluate.compare_scalars(scores, cfg, ["a", "b"]), ["macro_f1", "macro_pr_auc"])
    row = wide.first()
    assert wide.count() == 1 and row["pair"] == "a vs b" and row["macro_f1_sig"] in ("a", "b", "A", "B", "ns") and float(row["macro_pr_auc_low"]) <= float(row["macro_pr_auc_high"])


def test_resamples_in_blocks_are_the_same(spark):
    from vectriage.operators import bootstrap

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([("m", i, "l", int(rng.random() < 0.4), float(rng.integers(0, 9))) for i in range(30)], "model string, u int, label string, y int, score double")
    whole, cut = (bootstrap.fast_runs(df, df.select("u"), "u", ["model"], 20, 3, draws=d).orderBy("b").collect() for d in (1 << 24, 100))
    assert len(whole) == 20 and whole == cut


def test_evaluation_in_tasks_is_that_by_joins(spark):
    from vectriage.operators import bootstrap, folds

    rng = np.random.default_rng(15)
    rows = [(m, i, i % 9, l, int(rng.random() < p), float(rng.integers(0, 8)) / 8) for m in ("a", "b") for i in range(50) for l, p in (("x", 0.4), ("rare", 0.03), ("never", 0.0))]
    scores = spark.createDataFrame(rows, "model string, id int, grp int, label string, y int, score double")
    boot = folds.resamples(scores.select("grp").distinct(), "grp", 12, 5)
    want = {(r.model, r.metric, r.label): r for r in bootstrap.evaluate(scores, boot, "grp", ["model"]).collect()}
    for draws in (1 << 24, 20):
        got = {(r.model, r.metric, r.label): r for r in bootstrap.fast_evaluate(scores, scores.select("grp"), "grp", ["model"], 12, 5, draws=draws).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            for c in ("point", "ci95_low", "ci95_high"):
                assert (r[c] is None) == (got[k][c] is None) and (r[c] is None or abs(r[c] - got[k][c]) < 1e-9), (k, c, r[c], got[k][c])


@pytest.mark.parametrize("query", ["fast_runs", "fast_evaluate"])
def test_a_task_of_many_rows_and_few_units_holds_some_resamples_at_a_time(spark, monkeypatch, query):
    made, whole = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: made.append(f) or whole(self, f, schema))
    df = spark.createDataFrame([("m", "l", i, i % 2, float(i), i % 5) for i in range(10)], "model string, label string, id long, y int, score double, grp long")
    getattr(bootstrap, query)(df, df.select("grp"), "grp", ["model"], 300, 11)
    rng = np.random.default_rng(1)
    n = 40_000
    rows = pd.DataFrame({"model": "m", "label": "l", "id": np.arange(n), "y": rng.integers(0, 2, n), "score": rng.random(n), "__k": np.arange(n) % 5, "__first": 0})
    tracemalloc.start()
    out = made[0](rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 300 resamples of 40,000 rows are 96 MB an array
    assert most < 150e6 and out["b"].tolist() == list(range(300))
    w = bootstrap.multiplicities(300, 5, 11)[:, rows["__k"].to_numpy()]
    ap, _, prevalence = bootstrap._runs(rows["y"].to_numpy(float), rows["score"].to_numpy(), w)
    assert np.allclose(out["ap"].astype(float), ap) and np.allclose(out["prevalence"].astype(float), prevalence)
