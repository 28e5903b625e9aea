"""Zero-shot scores from pairs of prompts, and the protocol of the encoders that embed them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors


class Scorer(Protocol):
    """What a text and image encoder has to offer."""

    name: str
    dim: int

    def encode_text(self, prompts: list[str]) -> np.ndarray: ...

    def image_projection(self) -> tuple[list[list[float]], list[float]]: ...


class HashScorer:
    """A stand-in without trained weights: prompts become unit vectors drawn from their digests, images pass unchanged."""

    def __init__(self, name: str, dim: int):
        self.name, self.dim = name, dim

    def encode_text(self, prompts: list[str]) -> np.ndarray:
        out = np.empty((len(prompts), self.dim))
        for i, p in enumerate(prompts):
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{self.name}:{p}".encode()).digest()[:8], "little"))
            out[i] = rng.normal(size=self.dim)
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def image_projection(self) -> tuple[list[list[float]], list[float]]:
        return np.eye(self.dim).tolist(), [0.0] * self.dim


_SCORERS: dict = {}


def register(name: str, build) -> None:
    """build() returns a Scorer; a plug-in with real weights registers itself here."""
    _SCORERS[name] = build


def build_scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[name]()


for _dim in (64, 512, 768, 1024):
    register(f"hash-{_dim}", lambda d=_dim: HashScorer(f"hash-{d}", d))


class ProjectedScorer:
    """A scorer of two given parts: a text encoder, and a linear projection of cached image vectors into the space they
    share. Dimensions are checked when it is built, not when the first image comes."""

    def __init__(self, name: str, encode: Callable[[list[str]], np.ndarray], weights: np.ndarray, bias: np.ndarray | None = None):
        self.name, self._encode, self._weights = name, encode, np.asarray(weights, np.float64)
        self._bias = np.zeros(len(self._weights)) if bias is None else np.asarray(bias, np.float64)
        self.dim, self.image_dim = self._weights.shape
        probe = np.asarray(encode(["probe"]))
        if probe.shape != (1, self.dim) or self._bias.shape != (self.dim,):
            raise ValueError(f"{name}: prompts have {probe.shape[-1]} dimensions, images {self.dim}")

    def encode_text(self, prompts: list[str]) -> np.ndarray:
        return np.asarray(self._encode(prompts), np.float64)

    def image_projection(self) -> tuple[list[list[float]], list[float]]:
        return self._weights.tolist(), self._bias.tolist()


def project(scans: DataFrame, scorer: Scorer) -> DataFrame:
    """scans with v in the space that the scorer's prompts are in; vectors of another length are an error."""
    weights, bias = scorer.image_projection()
    width = len(weights[0])
    if np.array_equal(weights, np.eye(width)) and not any(bias):
        return scans
    checked = F.when(F.size("v") == width, vectors.project(weights, bias, F.col("v"))).otherwise(F.raise_error(F.lit(f"{scorer.name} wants vectors of {width}")))
    return scans.withColumn("v", checked)


def prompt_table(spark: SparkSession, labels: list[str], scorer: Scorer, positive: str | None = None, negative: str | None = None) -> DataFrame:
    """(label, positive, negative, pos, neg): prompts and their vectors."""
    more = {k: v for k, v in (("positive", positive), ("negative", negative)) if v}
    named = spark.createDataFrame([(l,) for l in labels], "label string")
    p, n = text.prompts(F.col("label"), **more)
    rows = [tuple(r) for r in named.select("label", p, n).collect()]
    pos, neg = (scorer.encode_text([r[k] for r in rows]) for k in (1, 2))
    if pos.shape != (len(rows), scorer.dim):
        raise ValueError(f"{scorer.name} gave {pos.shape}, not {(len(rows), scorer.dim)}")
    return spark.createDataFrame([(*r, a.tolist(), b.tolist()) for r, a, b in zip(rows, pos, neg)], "label string, positive string, negative string, pos array<double>, neg array<double>")


def score(scans: DataFrame, prompts: DataFrame, labels: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys…, id, label, score) and y where labels has it: the sigmoid of the difference of the two cosines.

    The prompts are one row for each label of a study, so they are broadcast; images stay where they are.
    """
    keys = keys or []
    v = vectors.normalise(F.col("v"))
    pairs = scans.select(*keys, "id", v.alias("__v")).crossJoin(F.broadcast(prompts.select("label", vectors.normalise(F.col("pos")).alias("__p"), vectors.normalise(F.col("neg")).alias("__n"))))
    out = pairs.select(*keys, "id", "label", vectors.sigmoid(vectors.dot(F.col("__v"), F.col("__p")) - vectors.dot(F.col("__v"), F.col("__n"))).alias("score"))
    return out if labels is None else out.join(labels.select("id", "label", "y"), ["id", "label"]).select(*keys, "id", "label", "y", "score")
