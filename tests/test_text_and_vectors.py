"""Column expressions: ids, taxonomy, prompts, volumes' arithmetic."""

import math

import duckdb
from pyspark.sql import functions as F

from vectriage.functions import tables, text, vectors
from vectriage.operators import report
from vectriage.plans import catalog


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_taxonomy_counts(spark):
    labels = [l for ls in tables.ORGANS.values() for l in ls]
    assert len(labels) == len(set(labels)) == 110
    df = spark.createDataFrame([("study", l, 0.1) for l in labels], "cohort string, label string, prevalence double")
    out = report.concept_features(df).collect()
    counts = {}
    for r in out:
        counts[r.finding_type] = counts.get(r.finding_type, 0) + 1
    assert counts == {"calcification": 9, "device_foreign": 19, "morphometric_fluid": 16, "texture_diffuse": 44, "focal_object": 18, "skeletal": 3, None: 1}
    assert next(r for r in out if r.label == "distention").finding_type == "morphometric_fluid"
    assert one(spark, text.organ(F.lit("unheard_of"))).c0 == "other"


def test_paths_and_numbers(spark):
    r = one(spark, text.nested_path(F.lit("valid_5_b_2")), text.nested_path(F.lit("valid_5_b_2.nii.gz"), "/data/"), text.nested_path(F.lit("valid_5")), text.first_number(F.lit("[0.7, 0.8]")), text.first_number(F.lit(" 1.5 ")), text.first_number(F.lit("n/a")), text.first_number(F.lit(None).cast("string")))
    assert tuple(r) == ("valid_5/valid_5_b/valid_5_b_2.nii.gz", "/data/valid_5/valid_5_b/valid_5_b_2.nii.gz", None, 0.7, 1.5, None, None)


def test_cells(spark):
    r = one(spark, text.percent(F.lit(0.53)), text.percent(F.lit(0.004)), text.interval(F.lit(0.5), F.lit(0.25), F.lit(0.75)), text.interval(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.2)))
    assert tuple(r) == ("53%", "0.4%", "0.500 [0.250, 0.750]", "--")


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    r = one(spark, vectors.normalise(array(3, 4)), vectors.normalise(array(0, 0)), vectors.cosine(array(1, 0), array(1, 1)), vectors.project([[1.0, 2.0], [0.0, 1.0]], [0.5, 0.0], array(1, 2)), vectors.last_token(F.array(array(1), array(2)), F.lit(1)), vectors.cls_and_mean(array(9), F.array(array(1), array(3))), vectors.masked_mean(F.array(array(1), array(5)), F.array(F.lit(0), F.lit(0))))
    assert r.c0 == [0.6, 0.8] and r.c1 == [0.0, 0.0] and math.isclose(r.c2, 0.5**0.5) and r.c3 == [5.5, 2.0] and r.c4 == [1.0] and r.c5 == [9.0, 2.0] and r.c6 is None


def small_vectors(spark, tmp_path):
    """A table of one row whose components are nearly zero, of either sign."""
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(2, [4e-7 * (-1) ** i for i in range(64)])], "vec_id long, embedding array<float>").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


def rows_with_signs(spark, con, tmp_path, name):
    """The query's rows and its SQL's, as text, where -0.0 differs from 0.0."""
    rel = con.sql(catalog.ORACLE[name])
    return [repr([r[c] for c in rel.columns]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()], [repr(list(r)) for r in rel.fetchall()]


def test_last_and_class_tokens_keep_the_sign_of_zero(spark, tmp_path):
    got, want = rows_with_signs(spark, small_vectors(spark, tmp_path), tmp_path, "last_and_class_tokens")
    assert got == want and "-0.0" in got[0]


def test_masked_and_pooled_means_keep_the_sign_of_zero(spark, tmp_path):
    con = small_vectors(spark, tmp_path)
    for name in ("masked_mean_tokens", "mean_pool_patches"):
        got, want = rows_with_signs(spark, con, tmp_path, name)
        assert got == want and "-0.0" in got[0]


def test_hounsfield_and_affines(spark):
    hu = [one(spark, vectors.calibrate_hu(array(a, 100), F.lit(2.0), F.lit(-1.0))).c0 for a in (-1024, 0, -800)]
    assert hu == [[-1024.0, 100.0], [-1.0, 199.0], [-800.0, 100.0]]
    a = F.array(array(0, 0, 3, 0), array(2, 0, 0, 0), array(0, 1, 0, 0), array(0, 0, 0, 1))
    r = one(spark, vectors.spacing_of(a), vectors.axial_axis(a), vectors.ras_to_lps(a), vectors.isotropic_lps(F.lit(2)))
    assert r.c0 == [2.0, 1.0, 3.0] and r.c1 == 1 and r.c2[1][0] == -2.0 and r.c2[2][1] == 1.0 and r.c3[2][2] == 2.0 and r.c3[0][0] == -2.0


def test_intensity(spark):
    r = one(spark, vectors.scale_clip(array(-2000, 0, 500), -1000, 1000, 0, 1), vectors.clamp(array(-5, 5), -1, 1), vectors.shift(array(1), -0.449), vectors.z_score(array(1, 3)), vectors.z_score(array(4), 1.0, 2.0))
    assert r.c0 == [0.0, 0.5, 0.75] and r.c1 == [-1.0, 1.0] and math.isclose(r.c2[0], 0.551) and r.c3 == [-1.0, 1.0] and r.c4 == [1.5]
