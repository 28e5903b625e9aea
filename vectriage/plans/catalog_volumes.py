"""Registered queries on volumes and vectors: each row of `embeddings` is a volume of 4 x 4 x 4 voxels [X, Y, Z], axes
running to L, P and S. A result is told by the sum of its values, each times its place from 1."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.tables import EXTRACTORS
from ..operators import volumes
from ..sources import readers
from .catalog import r6, register, table

V = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def told(a: np.ndarray) -> float:
    flat = np.asarray(a, np.float64).reshape(-1)
    return float((flat * np.arange(1, len(flat) + 1)).sum())


def of_volumes(spark, sf_dir: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(vec_id, n, told): how many values work gives of each volume, and what they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [work(np.asarray(v, np.float64).reshape(4, 4, 4)) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n": [np.asarray(f).size for f in found], "told": [told(f) for f in found]})

    out = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, n long, told double")
    return out.select("vec_id", "n", F.round("told", 4).alias("told"))


def told_sql(n: str, value: str, rows: str = V) -> str:
    """value is an expression of the place p from 0 of a result of n values, and of v (from 1)."""
    return f"SELECT vec_id, CAST({n} AS BIGINT) AS n, round(list_sum(list_transform(range({n}), lambda p: (p + 1) * CAST({value} AS DOUBLE))), 4) AS told FROM {rows}"


def at(x: str, y: str, z: str) -> str:
    return f"v[CAST(({x}) * 16 + ({y}) * 4 + ({z}) + 1 AS BIGINT)]"


X, Y, Z = "(p // 16)", "((p // 4) % 4)", "(p % 4)"


@register("reorient_ras", told_sql("64", at(f"3 - {X}", f"3 - {Y}", Z)))
def reorient_ras(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.reorient(v, "LPS", "RAS"))


@register("reorient_spl", told_sql("64", at(Z, Y, X)))
def reorient_spl(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.reorient(v, "LPS", "SPL"))


@register("resample_half", told_sql("128", f"{at('floor(least((p // 16) * 0.5, 3))', Y, Z)} * (1 - (least((p // 16) * 0.5, 3) - floor(least((p // 16) * 0.5, 3)))) + {at('least(floor(least((p // 16) * 0.5, 3)) + 1, 3)', Y, Z)} * (least((p // 16) * 0.5, 3) - floor(least((p // 16) * 0.5, 3)))"))
def resample_half(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.resample(v, (1.0, 1.0, 1.0), (0.5, 1.0, 1.0)))


@register("pad_or_crop", told_sql("48", f"CASE WHEN p // 8 BETWEEN 1 AND 4 THEN {at('p // 8 - 1', '(p // 4) % 2 + 1', Z)} ELSE -1 END"))
def pad_or_crop(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.pad_or_crop(v, (6, 2, 4), -1.0))


_BOX = f"(SELECT vec_id, v, list_filter(range(64), lambda i: v[i + 1] > 0.1) AS f FROM {V})"
_SPAN = ", ".join(f"CASE WHEN len(f) = 0 THEN {d} ELSE list_{m}(list_transform(f, lambda i: {e})) END AS {m}{k}" for k, e in (("x", "i // 16"), ("y", "(i // 4) % 4"), ("z", "i % 4")) for m, d in (("min", 0), ("max", 3)))


@register("foreground_box", f"SELECT vec_id, CAST((maxx - minx + 1) * (maxy - miny + 1) * (maxz - minz + 1) AS BIGINT) AS n, round(list_sum(list_transform(range(64), lambda i: CASE WHEN i // 16 BETWEEN minx AND maxx AND (i // 4) % 4 BETWEEN miny AND maxy AND i % 4 BETWEEN minz AND maxz THEN v[i + 1] ELSE 0 END)), 4) AS total FROM (SELECT vec_id, v, {_SPAN} FROM {_BOX})")
def foreground_box(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            found = [volumes.foreground(np.asarray(v, np.float64).reshape(4, 4, 4), 0.1) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n": [f.size for f in found], "total": [float(f.sum()) for f in found]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, n long, total double").withColumn("total", F.round("total", 4))


@register("window_means", told_sql("4", "list_avg(list_transform(range(16), lambda q: v[CAST(((p // 2) * 2 + q // 8) * 16 + ((p % 2) * 2 + (q // 4) % 2) * 4 + q % 4 + 1 AS BIGINT)]))"))
def window_means(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.windows(v, (2, 2, 4), 0.0).mean((1, 2, 3)))


@register("window_overlaps", told_sql("96", at("p // 32 + (p % 32) // 16", Y, Z)))
def window_overlaps(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.windows(v, (2, 4, 4), 0.0, 0.5))


@register("slices_pooled", told_sql("2", "CASE WHEN p = 0 THEN list_avg(list_transform(range(4), lambda x: list_max(v[x * 16 + 1 : x * 16 + 16]))) ELSE list_avg(v) END"))
def slices_pooled(spark, sf_dir):
    model = volumes.ProfileExtractor("max-and-mean", {}, lambda part: np.array([part.max(), part.mean()]), 2)
    return of_volumes(spark, sf_dir, lambda v: volumes.embedded(model, v, {"slices": 4}).astype(np.float64)).select("vec_id", "n", F.round("told", 4).alias("told"))


@register("grid_cells", told_sql("64", at(X, f"(({Y} // 2) * 2 + {Y} % 2)", Z)).replace("p + 1)", "((p // 8) % 2) * 32 + (p // 16) * 8 + p % 8 + 1)"))
def grid_cells(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.grid_crops(v, (1, 2, 1), (4, 2, 4)))


@register("adaptive_pooled", told_sql("24", "list_avg(list_transform(range([0, 2, 5][CAST(p // 8 + 1 AS BIGINT)], [3, 6, 8][CAST(p // 8 + 1 AS BIGINT)]), lambda r: v[CAST(r * 8 + p % 8 + 1 AS BIGINT)]))"))
def adaptive_pooled(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.adaptive_pool(v.reshape(8, 8), 3))


@register("projected_pool", told_sql("2", "list_sum(list_transform(range(8), lambda c: (CASE WHEN p = 0 THEN c ELSE 1 END) * list_avg(list_transform(range(8), lambda r: v[CAST(r * 8 + c + 1 AS BIGINT)])))) + p"))
def projected_pool(spark, sf_dir):
    weights, bias = np.stack([np.arange(8), np.ones(8)]), np.array([0.0, 1.0])
    return of_volumes(spark, sf_dir, lambda v: volumes.pooled_projection(v.reshape(8, 8), weights, bias))


@register("ct_windows", told_sql("128", "least(greatest((v[CAST(p % 64 + 1 AS BIGINT)] * 1000 - CASE WHEN p < 64 THEN -160 ELSE -1350 END) / CASE WHEN p < 64 THEN 400 ELSE 1500 END, 0), 1)"))
def ct_windows(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.ct_windows(v * 1000, [(40, 400), (-600, 1500)]))


@register("patch_budget", told_sql("32", at("p // 16 + 1", Y, Z)))
def patch_budget(spark, sf_dir):
    return of_volumes(spark, sf_dir, lambda v: volumes.patch_budget(v, (2, 2, 2), 4))


@register("profile_axial", told_sql("64", f"({at(Y, Z, X)} * 1000 - m) / (s + 1e-8)", f"(SELECT vec_id, v, list_avg(list_transform(v, lambda x: x * 1000)) AS m, list_stddev_pop(list_transform(v, lambda x: x * 1000)) AS s FROM {V})").replace(at(Y, Z, X), at(Z, Y, X)))
def profile_axial(spark, sf_dir):
    """A whole profile: the body axis first, the finest spacing, clipped and centred."""
    return of_volumes(spark, sf_dir, lambda v: volumes.prepare(v * 1000, (1.0, 1.0, 1.0), "LPS", EXTRACTORS["axial-864"]))


@register("affines", "SELECT vec_id, list_transform([-s, 0, 0, 0, 0, -s, 0, 0, 0, 0, s, 0, 0, 0, 0, 1], lambda x: round(CAST(x AS DOUBLE), 6) + 0.0) AS isotropic, list_transform(range(16), lambda i: round(CASE WHEN i < 8 THEN -v[i + 1] ELSE v[i + 1] END, 6) + 0.0) AS lps FROM (SELECT vec_id, v, abs(v[1]) + 0.5 AS s FROM " + V + ")")
def affines(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    rows = rows.withColumn("a", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 4 + 1, F.lit(4))))
    flat = lambda m: F.transform(F.flatten(m), lambda x: F.round(x, 6) + 0.0)
    return rows.select("vec_id", flat(vectors.isotropic_lps(F.abs(F.col("v")[0]) + 0.5)).alias("isotropic"), flat(vectors.ras_to_lps(F.col("a"))).alias("lps"))


@register("last_and_class_tokens", "SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN list_transform(v[(vec_id % 4 - 1) * 16 + 1 : (vec_id % 4) * 16], lambda x: round(x, 6)) END AS last, list_transform(range(32), lambda i: round(CASE WHEN i < 16 THEN v[i + 1] ELSE (v[i + 1] + v[i + 17] + v[i + 33]) / 3 END, 6)) AS pooled FROM " + V)
def last_and_class_tokens(spark, sf_dir):
    v = vectors.doubles(F.col("embedding"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 16 + 1, F.lit(16)))
    n = (F.col("vec_id") % 4).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.rounded(vectors.last_token(tokens, n)).alias("last"), vectors.rounded(vectors.cls_and_mean(tokens[0], F.slice(tokens, 2, 3))).alias("pooled"))


@register("interval_cells", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '--' ELSE printf('%.3f [%.3f, %.3f]', floor(value * 10) / 8, floor(value * 10) / 8 - 0.125, floor(value * 10) / 8 + 0.25) END AS cell FROM events")
def interval_cells(spark, sf_dir):
    x = F.floor(F.col("value") * 10) / 8
    return table(spark, sf_dir, "events").select("event_id", text.interval(F.when(F.col("event_id") % 5 != 0, x), x - 0.125, x + 0.25).alias("cell"))


# ---- files of volumes


def npz(v: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, ct=v.astype(np.float32))
    return buffer.getvalue()


def nifti(v: np.ndarray, spacing: tuple) -> bytes:
    """A NIfTI-1 file of 32-bit floats."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *v.shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<f", head, 108, 352.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + v.astype("<f4").tobytes(order="F")


def files(spark, sf_dir: str, write: Callable[[np.ndarray], bytes], ending: str) -> DataFrame:
    """(path, content) of a volume file for each row; every fifth is an error page."""

    def run(batches):
        for pdf in batches:
            content = [b"<html>not found</html>" if i % 5 == 0 else write(np.asarray(v, np.float64).reshape(4, 4, 4)) for i, v in zip(pdf["vec_id"], pdf["embedding"])]
            yield pd.DataFrame({"path": [f"/volumes/{i}{ending}" for i in pdf["vec_id"]], "content": content})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "path string, content binary")




def _moments(value: str) -> str:
    """Means and deviations of the eight cells of a volume, of values that are an expression of i (from 1)."""
    cells = "list_transform(range(8), lambda c: list_transform(range(8), lambda q: " + value.replace("(i)", "(CAST((c // 4) * 2 + q // 4 AS BIGINT) * 16 + CAST(((c // 2) % 2) * 2 + (q // 2) % 2 AS BIGINT) * 4 + CAST((c % 2) * 2 + q % 2 AS BIGINT) + 1)") + "))"
    return f"SELECT CAST(vec_id AS VARCHAR) AS id, 'moments' AS model, round(list_sum(list_transform(range(8), lambda c: (c + 1) * list_avg(cells[c + 1]) + (c + 9) * list_stddev_pop(cells[c + 1]))), 2) AS told FROM (SELECT vec_id, {cells} AS cells FROM {V} WHERE vec_id % 5 <> 0)"


def _extracted(spark, sf_dir, write, ending: str, facts: DataFrame, scale: float) -> DataFrame:
    own = readers.volumes(files(spark, sf_dir, write, ending), facts, facts)
    out = volumes.extract(own, "moments")
    told_ = F.aggregate(F.transform("embedding", lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", "model", F.round(told_ * scale, 2).alias("told"))


@register("extract_npz", _moments("v[(i)]"))
def extract_npz(spark, sf_dir):
    """Zipped volumes, a fifth of them error pages, through validation, reading and extraction."""
    facts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit(1.0).alias("spacing"))
    return _extracted(spark, sf_dir, npz, ".npz", facts, 1.0)


@register("extract_nifti", _moments("(CASE WHEN list_min(v) * 4000 <= -800 THEN v[(i)] * 4000 ELSE v[(i)] * 4000 * 2 - 10 END) / 1000"))
def extract_nifti(spark, sf_dir):
    """NIfTI volumes: values that reach -800 are Hounsfield units already, others are rescaled."""
    facts = table(spark, sf_dir, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".nii.gz")).alias("id"), F.lit(2.0).alias("slope"), F.lit(-10.0).alias("intercept"))
    return _extracted(spark, sf_dir, lambda v: nifti(v * 4000, (1.0, 1.0, 1.0)), ".nii.gz", facts, 0.001)


@register("sound_files", "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id % 5 <> 0")
def sound_files(spark, sf_dir):
    return readers.sound(readers.named(files(spark, sf_dir, npz, ".npz"))).select("id")


@register("finest_spacing", f"SELECT vec_id, round(greatest(least(abs(v[1]) * 9, abs(v[2]) * 9, abs(v[3]) * 9), 0.75), 6) AS spacing FROM {V}")
def finest_spacing(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "spacing": [volumes.adaptive_spacing(tuple(abs(float(x)) * 9 for x in v[:3]))[0] for v in pdf["embedding"]]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, spacing double").select("vec_id", r6("spacing"))
