"""Splitters, groups and resamples."""

import numpy as np
import pytest

from vectriage.functions.mixing import mix, mix_numpy
from vectriage.operators import folds


@pytest.fixture(scope="module")
def ids(spark):
    return spark.createDataFrame([(i * 3,) for i in range(23)], "id long")


def test_mix_is_the_same_in_numpy(spark):
    got = [r[0] for r in spark.range(500).select(mix(folds.F.lit(7), folds.F.col("id"), 42)).collect()]
    assert got == mix_numpy(7, np.arange(500), 42).tolist()


def test_kfold_sizes(ids):
    out = folds.kfold(ids, folds=5).collect()
    sizes = [sum(r.fold == f for r in out) for f in range(5)]
    assert len({r.id for r in out}) == 23 and sizes == [5, 5, 5, 4, 4]
    assert {(r.id, r.fold) for r in folds.kfold(ids.orderBy(folds.F.desc("id")), folds=5).collect()} == {(r.id, r.fold) for r in out}
    with pytest.raises(ValueError):
        folds.kfold(ids, folds=24)


def test_large_tables_are_numbered_alike(ids, monkeypatch):
    small = sorted(map(tuple, folds.numbered(ids, "id").collect()))
    monkeypatch.setattr(folds, "SMALL_BYTES", 0)
    assert sorted((r.id, r.k) for r in folds.numbered(ids, "id").collect()) == small


def test_groups_stay_together(spark):
    rows = [(i, f"g{i % 7}") for i in range(40)]
    out = folds.group_kfold(spark.createDataFrame(rows, "id long, grp string"), folds=3).collect()
    grp = dict(rows)
    by = {}
    for r in out:
        by.setdefault(grp[r.id], set()).add(r.fold)
    assert len(out) == 40 and all(len(f) == 1 for f in by.values())
    assert sorted(len([g for g, f in by.items() if f == {k}]) for k in range(3)) == [2, 2, 3]


def test_other_splits(ids):
    loo = folds.leave_one_out(ids).collect()
    assert len({r.fold for r in loo}) == 23
    hold = folds.holdout(ids, test_frac=0.1, repeats=3).collect()
    assert [sum(r.fold == 0 for r in hold if r.repeat == k) for k in range(3)] == [2, 2, 2]
    with pytest.raises(ValueError):
        folds.split(ids, "other")
    with pytest.raises(ValueError):
        folds.split(ids, "group_kfold")


def test_lowest_reconstruction(spark):
    names = ["valid_1_a_1.nii.gz", "valid_1_a_2.nii.gz", "valid_1_b_3.nii.gz", "valid_12_a_1.nii.gz", "odd_name", "valid_1_a_10"]
    df = spark.createDataFrame([(n,) for n in names], "id string")
    assert {r.id for r in folds.lowest_reconstruction(df).collect()} == {"valid_1_a_1.nii.gz", "valid_1_b_3.nii.gz", "valid_12_a_1.nii.gz", "odd_name"}
    assert {r.grp for r in folds.with_patient(df).collect()} == {"valid_1", "valid_12", "odd_name"}


def test_resamples(spark, ids):
    out = folds.resamples(ids, "id", 9, 5).collect()
    assert all(sum(r.mult for r in out if r.b == b) == 23 for b in range(9))
    assert folds.resamples(ids.limit(0), "id", 9, 5).count() == 0


def test_subsample(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, fold int")
    out = folds.subsample(df, "id", "fold", [4, 100], 1).collect()
    assert {(f, b): sum(r.fold == f and r.budget == b for r in out) for f in (0, 1) for b in (4, 15)} == {(0, 4): 4, (0, 15): 15, (1, 4): 4, (1, 15): 15}
    few = {r.id for r in out if r.budget == 4}
    assert few <= {r.id for r in out if r.budget == 15}
