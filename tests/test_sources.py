"""Readers, writers and volumes."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Observation

from vectriage.functions.tables import EXTRACTORS
from vectriage.operators import volumes
from vectriage.sources import readers, writers


def test_labels_of_json_and_csv(spark, tmp_path):
    rows = [{"NoteAcc_DEID": "b", "image": "x", "nodule": True, "mass": False}, {"NoteAcc_DEID": "a", "image": "y", "nodule": False}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    got = {(r.id, r.label): r.y for r in readers.read_label_json(spark, f"{tmp_path}/l.json").collect()}
    assert got == {("b", "nodule"): 1, ("b", "mass"): 0, ("a", "nodule"): 0, ("a", "mass"): 0}
    assert {r.id for r in readers.read_label_json(spark, f"{tmp_path}/l.json", max_samples=1).collect()} == {"a"}
    with pytest.raises(KeyError):
        readers.read_label_json(spark, f"{tmp_path}/l.json", labels=["other"])
    (tmp_path / "l.csv").write_text("VolumeName,A b,C\nv1,1,0\nv2,0,\n")
    got = {(r.id, r.label): r.y for r in readers.read_label_csv(spark, f"{tmp_path}/l.csv").collect()}
    assert got == {("v1", "A b"): 1, ("v1", "C"): 0, ("v2", "A b"): 0, ("v2", "C"): 0}


def test_tables_beside_the_labels(spark, tmp_path):
    (tmp_path / "s.csv").write_text("NoteAcc_DEID,final_spacing\na,0.7\nb,\nc,x\na,0.8\n")
    assert {tuple(r) for r in readers.read_spacing(spark, f"{tmp_path}/s.csv").collect()} == {("a", 0.8)}
    (tmp_path / "m.csv").write_text('VolumeName,RescaleSlope,RescaleIntercept,XYSpacing,ZSpacing\nv1,1,-1024,"[0.7, 0.7]",1.5\nv2,1,0,,1\n')
    assert {tuple(r) for r in readers.read_metadata(spark, f"{tmp_path}/m.csv").collect()} == {("v1", 1.0, -1024.0, 0.7, 1.5)}
    (tmp_path / "r.csv").write_text('VolumeName,Findings_EN,Impressions_EN\nv1,"two\nlines",\n')
    r = readers.read_reports(spark, f"{tmp_path}/r.csv").first()
    assert r.findings == "two\nlines" and r.impressions is None
    (tmp_path / "c.json").write_text(json.dumps({"diseases": ["x"], "findings": ["y", "z"]}))
    cats = readers.read_categories(spark, f"{tmp_path}/c.json")
    labels = spark.createDataFrame([("v", "x"), ("v", "z")], "id string, label string")
    assert [r.label for r in readers.in_category(labels, cats, "findings").collect()] == ["z"]


def test_volume_files(spark, tmp_path):
    ct = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    buffer = io.BytesIO()
    np.savez(buffer, ct=ct)
    (tmp_path / "a.npz").write_bytes(buffer.getvalue())
    (tmp_path / "b.npz").write_bytes(b"<html>")
    files = readers.read_files(spark, str(tmp_path), "*.npz")
    labels = spark.createDataFrame([("a",), ("b",)], "id string")
    spacing = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, spacing double")
    found = readers.volumes(files, labels, spacing)
    assert [r.id for r in found.collect()] == ["a"]
    out = volumes.extract(found, "moments").first()
    assert out.model == "moments" and len(out.embedding) == 16
    with pytest.raises(ValueError):
        volumes.load_npz(b"<html>")
    with pytest.raises(KeyError):
        volumes.load_npz(buffer.getvalue(), "mr")


def test_the_limit_counts_accepted_ids(spark):
    labels = spark.createDataFrame([(i, "x", 1) for i in "abcdef"], "id string, label string, y int")
    files = spark.createDataFrame([(i,) for i in "bcdf"], "id string")
    facts = spark.createDataFrame([(i,) for i in "acdf"], "id string")
    seen = Observation("skipped")
    out = readers.accepted(labels, {"file": files, "metadata": facts}, 2, seen)
    assert {r.id for r in out.collect()} == {"c", "d"}
    seen = Observation("skipped of all")
    assert {r.id for r in readers.accepted(labels, {"file": files, "metadata": facts}, 0, seen).collect()} == {"c", "d", "f"}
    assert seen.get == {"found": 3, "missing_file": 2, "missing_metadata": 1}


def test_limits_of_label_files_come_after_the_filters(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"NoteAcc_DEID": i, "nodule": True} for i in "abcd"]))
    (tmp_path / "l.csv").write_text("VolumeName,A\n" + "".join(f"{i},1\n" for i in "abcd"))
    files = {"file": spark.createDataFrame([("c",), ("d",)], "id string")}
    assert [r.id for r in readers.read_label_json(spark, f"{tmp_path}/l.json", max_samples=1, needs=files).collect()] == ["c"]
    assert [r.id for r in readers.read_label_csv(spark, f"{tmp_path}/l.csv", max_samples=1, needs=files).collect()] == ["c"]
    (tmp_path / "lines.json").write_text("".join(json.dumps({"NoteAcc_DEID": i, "nodule": True}) + "\n" for i in "ab"))
    assert readers.read_label_json(spark, f"{tmp_path}/lines.json", lines=True).count() == 2


def nifti(volume, affine, slope_code=1):
    """A NIfTI-1 file of 16-bit voxels."""
    import gzip
    import struct

    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 4, 16)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), 0, 0, 0, 0)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<h", head, 254, slope_code)
    struct.pack_into("<12f", head, 280, *affine[:3].reshape(-1))
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + volume.astype("<i2").tobytes(order="F"))


def test_nifti_volumes_are_extracted(spark, tmp_path):
    raw = np.arange(4 * 5 * 6).reshape(4, 5, 6)
    (tmp_path / "v1.nii.gz").write_bytes(nifti(raw, np.diag([2.0, 2.0, 3.0, 1.0])))
    (tmp_path / "v2.nii.gz").write_bytes(b"<html>not found</html>")
    (tmp_path / "v3.nii.gz").write_bytes(b"\x1f\x8bbroken")
    labels = spark.createDataFrame([("v1.nii.gz",), ("v2.nii.gz",), ("v3.nii.gz",)], "id string")
    facts = spark.createDataFrame([(f"v{i}.nii.gz", 2.0, -1024.0, 2.0, 3.0) for i in (1, 2, 3)], "id string, slope double, intercept double, xy double, z double")
    found = readers.volumes(readers.read_files(spark, str(tmp_path), "*.nii.gz"), labels, facts)
    assert sorted(r.id for r in found.collect()) == ["v1", "v3"]
    out = volumes.extract(found, "moments", skip_broken=True).collect()
    assert [r.id for r in out] == ["v1"]
    v, spacing, axes = volumes.load_volume((tmp_path / "v1.nii.gz").read_bytes(), slope=2.0, intercept=-1024.0)
    assert np.array_equal(v, raw * 2.0 - 1024) and spacing == (2.0, 2.0, 3.0) and axes == "RAS"
    assert np.allclose(out[0].embedding, volumes.MomentExtractor().embed(v), rtol=1e-5)
    one = volumes.extract(found.where("id = 'v1'"), "axial-864").first()
    prepared = volumes.prepare(v, spacing, axes, EXTRACTORS["axial-864"])
    assert prepared.shape == (9, 5, 4) and one.model == "axial-864"  # body axis first, resampled to the finest spacing
    with pytest.raises(Exception, match="broken|gzip|EOF|error"):
        volumes.extract(found.where("id = 'v3'"), "moments").collect()


def test_every_key_of_a_profile_counts():
    rng = np.random.default_rng(3)
    v = rng.normal(0, 500, (12, 10, 8))
    moments = volumes.MomentExtractor()
    slices = volumes.prepare(v, (1.0, 1.0, 1.0), "PLS", {"orient": "PLS", "slices": 6, "z_score": True})
    assert slices.shape == (8, 6, 6) and abs(slices.mean()) < 1e-9
    assert len(list(volumes.parts(slices, {"slices": 6}))) == 8
    wanted = np.mean([moments.embed(s) for s in slices], 0)
    assert np.allclose(volumes.embedded(moments, slices, {"slices": 6}), wanted, atol=1e-5)
    half = volumes.windows(v, (4, 10, 8), 0.0, 0.5)
    assert half.shape == (5, 4, 10, 8) and all(np.array_equal(half[i], v[2 * i : 2 * i + 4]) for i in range(5))
    assert len(list(volumes.parts(v, {"windows": (4, 5, 4)}))) == 3 * 2 * 2
    assert len(list(volumes.parts(v, {"grid": ((1, 2, 2), (4, 4, 4))}))) == 4
    air = np.full((9, 9, 9), -1000.0)
    air[2:6, 3:7, 4:8] = 50
    assert volumes.prepare(air, (1.0,) * 3, "SPL", {"foreground": 0.0}).shape == (4, 4, 4)
    assert volumes.prepare(v, (2.0, 1.0, 1.0), "SPL", {"adaptive": 0.75}).shape == (24, 10, 8)
    assert volumes.prepare(v, (1.0,) * 3, "SPL", {"patches": ((4, 4, 4), 8)}).size == 8 * 64
    with pytest.raises(ValueError):
        volumes.windows(v, (2, 2, 2), 0.0, 1.0)


def test_extractors_register():
    assert set(EXTRACTORS) < set(volumes.EXTRACTOR_BUILDERS)
    for name in EXTRACTORS:
        built = volumes.build_extractor(name)
        assert built.name == name and built.profile is EXTRACTORS[name]
    volumes.register_extractor("mine", lambda: volumes.ProfileExtractor("mine", {}, lambda v: np.ones(3), 3))
    try:
        assert volumes.build_extractor("mine").dim == 3
    finally:
        del volumes.EXTRACTOR_BUILDERS["mine"]


def test_missing_inputs_and_prediction_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "l", 1, 0.5)], "id string, label string, y int, score double")
    df.write.parquet(f"{tmp_path}/m1")
    with pytest.warns(UserWarning, match="m2 is left out"):
        there, gone = readers.existing(spark, {"m1": f"{tmp_path}/m1", "m2": f"{tmp_path}/m2"})
    assert list(there) == ["m1"] and gone == ["m2"]
    own = readers.read_predictions(spark, there["m1"], "c", "m1")
    writers.write_pools(own, f"{tmp_path}/pools")
    assert readers.read_pools(spark, f"{tmp_path}/pools", "zs").count() == 1 and readers.read_pools(spark, f"{tmp_path}/pools", "knn").count() == 0


def test_targets_are_compared(spark):
    rows = [("a", "1", "l", 1), ("a", "2", "l", 0), ("b", "1", "l", 1), ("b", "2", "l", 1), ("c", "1", "l", 1)]
    out = readers.same_targets(spark.createDataFrame(rows, "model string, id string, label string, y int"))
    assert {(r.model_a, r.model_b): (r.n_shared, r.n_only, r.n_differ) for r in out.collect()} == {("a", "b"): (2, 0, 1), ("a", "c"): (1, 1, 0), ("b", "c"): (1, 1, 0)}


def test_reports_as_text(spark):
    lines = spark.createDataFrame([("a 1",), ("b 2",)], "line string").coalesce(1)
    assert writers.text_report("Title", lines) == "Title\n=====\na 1\nb 2\n"
    with pytest.raises(ValueError):
        writers.text_report("Title", lines, most=1)


def test_pools_are_replaced_cell_by_cell(spark, tmp_path):
    path = f"{tmp_path}/pools"
    df = spark.createDataFrame([("c", "m", "knn", "1", "l", 1, 0.5), ("c", "n", "knn", "1", "l", 1, 0.25)], "cohort string, model string, readout string, id string, label string, y int, score double")
    writers.write_pools(df, path)
    writers.write_pools(df.where("model = 'm'").withColumn("score", F.lit(0.75)), path)
    got = readers.read_pools(spark, path)
    assert {(r.model, r.score) for r in got.collect()} == {("m", 0.75), ("n", 0.25)}
    wanted = spark.createDataFrame([("c", "m", "knn"), ("c", "o", "knn")], "cohort string, model string, readout string")
    assert [r.model for r in writers.open_cells(wanted, got, writers.CELL).collect()] == ["o"]
    assert all(r.complete for r in readers.same_ids(got, ["model"]).collect())


def test_results_and_counters(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456, None), ("b", None, 1)], "label string, x double, n int")
    writers.write_csv(df, f"{tmp_path}/out")
    assert "a,0.1235," in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    seen = Observation("seen")
    readers.counted(df, seen, missing=F.col("x").isNull()).collect()
    assert seen.get["missing"] == 1
    results = spark.createDataFrame([("m", "f1", None, 0.5, 0.4, 0.6), ("m", "ap", "l", 0.5, 0.4, 0.6)], "model string, metric string, label string, point double, ci95_low double, ci95_high double")
    got = json.loads(writers.nested_json(results, ["model"]).first().json)
    assert got["aggregate"]["f1"]["point"] == 0.5
    cache = spark.createDataFrame([("1", "ctx", [1.0]), ("1", "ctx-zs", [2.0])], "id string, model string, embedding array<double>")
    cache.write.parquet(f"{tmp_path}/cache")
    assert [r.embedding for r in readers.read_embeddings(spark, f"{tmp_path}/cache", {"ctx": "ctx-zs"}).collect()] == [[2.0]]
    with pytest.raises(KeyError):
        readers.labels_subset(df, ["a", "zz"])


def test_volume_arithmetic():
    v = np.arange(24.0).reshape(2, 3, 4)
    assert (volumes.reorient(volumes.reorient(v, "RAS", "SLP"), "SLP", "RAS") == v).all()
    assert volumes.reorient(v, "RAS", "LAS")[0, 0, 0] == v[1, 0, 0]
    with pytest.raises(ValueError):
        volumes.reorient(v, "RAS", "RRS")
    assert (volumes.resample(v, (1, 1, 1), (1, 1, 1)) == v).all() and volumes.resample(v, (1, 1, 1), (1, 1, 0.5)).shape == (2, 3, 8)
    assert volumes.pad_or_crop(v, (4, 1, 4), -1.0).shape == (4, 1, 4) and volumes.pad_or_crop(v, (4, 3, 4), -1.0)[0].max() == -1
    assert volumes.foreground(np.pad(np.ones((2, 2, 2)), 3), 0).shape == (2, 2, 2)
    w = volumes.windows(v, (1, 2, 2), 0.0)
    assert w.shape == (8, 1, 2, 2) and w.sum() == v.sum()
    assert volumes.slices(v, 5, 0.0).shape == (2, 5, 5) and volumes.grid_crops(v, (1, 1, 2), (4, 4, 4)).shape == (2, 4, 4, 4)
    assert volumes.adaptive_pool(np.arange(5.0)[:, None], 2).tolist() == [[1.0], [3.0]]
    small = EXTRACTORS["ras-2048"] | {"shape": (8, 8, 8)}
    out = volumes.prepare(np.random.default_rng(1).normal(0, 500, (6, 6, 6)), (1.0, 1.0, 1.0), "LPS", small)
    assert out.shape == (8, 8, 8) and 0 <= out.min() and out.max() <= 1


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "id string, v array<double>")
    assert {r.id: r.v for r in volumes.mean_pool(df, ["id"]).collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
