"""Volume arithmetic for the extraction stage: numpy in the tasks of a mapInPandas, one volume at a time."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import EXTRACTORS

_OPPOSITE = {"L": "R", "R": "L", "A": "P", "P": "A", "S": "I", "I": "S"}


def reorient(volume: np.ndarray, from_: str, to: str) -> np.ndarray:
    """Permute and flip the axes of a volume whose axes run towards from_ (such as RAS) so that they run towards to."""
    order, flips = [], []
    for letter in to:
        at = from_.find(letter)
        at, flip = (at, False) if at >= 0 else (from_.find(_OPPOSITE[letter]), True)
        if at < 0:
            raise ValueError(f"{from_!r} has no axis for {letter!r}")
        order.append(at)
        flips.append(flip)
    out = np.transpose(volume, order)
    return np.flip(out, [i for i, f in enumerate(flips) if f]) if any(flips) else out


def resample(volume: np.ndarray, spacing: tuple, to: tuple) -> np.ndarray:
    """Linear interpolation to another spacing, the first voxel staying in its place."""
    out = volume.astype(np.float64)
    for axis, (s, t) in enumerate(zip(spacing, to)):
        n = out.shape[axis]
        size = max(1, int(round(n * s / t)))
        at = np.minimum(np.arange(size) * (t / s), n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        shape = [1] * out.ndim
        shape[axis] = size
        part = (at - low).reshape(shape)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def pad_or_crop(volume: np.ndarray, shape: tuple, value: float) -> np.ndarray:
    """The middle of a volume at the wanted shape; where it is smaller, value all around."""
    out = np.full(shape, value, np.float64)
    source, target = [], []
    for have, want in zip(volume.shape, shape):
        if have >= want:
            a = (have - want) // 2
            source.append(slice(a, a + want))
            target.append(slice(0, want))
        else:
            a = (want - have) // 2
            source.append(slice(0, have))
            target.append(slice(a, a + have))
    out[tuple(target)] = volume[tuple(source)]
    return out


def foreground(volume: np.ndarray, above: float) -> np.ndarray:
    """The smallest box with all voxels above a value; the volume itself if there is none."""
    mask = volume > above
    if not mask.any():
        return volume
    box = []
    for axis in range(volume.ndim):
        along = np.flatnonzero(mask.any(tuple(i for i in range(volume.ndim) if i != axis)))
        box.append(slice(along[0], along[-1] + 1))
    return volume[tuple(box)]


def windows(volume: np.ndarray, shape: tuple, value: float, overlap: float = 0.0) -> np.ndarray:
    """Windows, [n, *shape], of which neighbours share `overlap` of their length; the volume is padded at its ends."""
    if not 0 <= overlap < 1:
        raise ValueError("0 <= overlap < 1 is needed")
    steps = [max(1, round(s * (1 - overlap))) for s in shape]
    counts = [max(1, -(-(n - s) // t) + 1) for n, s, t in zip(volume.shape, shape, steps)]
    pad = [(0, max(0, (c - 1) * t + s - n)) for n, s, t, c in zip(volume.shape, shape, steps, counts)]
    v = np.pad(volume, pad, constant_values=value)
    every = np.lib.stride_tricks.sliding_window_view(v, shape)[tuple(slice(None, None, t) for t in steps)]
    return every.reshape(-1, *shape)


def slices(volume: np.ndarray, size: int, value: float) -> np.ndarray:
    """The slices along the first axis, each padded or cropped to a square."""
    return np.stack([pad_or_crop(s, (size, size), value) for s in volume])


def resize(volume: np.ndarray, shape: tuple) -> np.ndarray:
    """Linear interpolation to a shape, ends on ends."""
    out = volume.astype(np.float64)
    for axis, want in enumerate(shape):
        n = out.shape[axis]
        at = np.linspace(0, n - 1, want)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        size = [1] * out.ndim
        size[axis] = want
        part = (at - low).reshape(size)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def grid_crops(volume: np.ndarray, counts: tuple = (3, 3, 4), shape: tuple = (128, 128, 64)) -> np.ndarray:
    """A volume resized to counts x shape and cut into its cells."""
    return windows(resize(volume, tuple(c * s for c, s in zip(counts, shape))), shape, 0.0)


def intensity(volume: np.ndarray, profile: dict) -> np.ndarray:
    out = volume.astype(np.float64)
    if "clip" in profile:
        out = np.clip(out, *profile["clip"])
    if "scale" in profile:
        a, b, c, d = profile["scale"]
        out = np.clip((out - a) / (b - a) * (d - c) + c, min(c, d), max(c, d))
    if profile.get("z_score"):
        out = (out - out.mean()) / (out.std() + 1e-8)
    return out + profile.get("shift", 0.0)


def prepare(volume: np.ndarray, spacing: tuple, from_: str, profile: dict) -> np.ndarray:
    """A volume as a profile of functions.tables.EXTRACTORS wants it: orientation, spacing, foreground, intensity, shape.

    'axial' takes the axis along the body first. 'adaptive' resamples to the finest spacing, but no finer than that;
    'patches' is a patch's shape and how many there may be.
    """
    orient = profile.get("orient")
    if orient == "axial":
        along = next(i for i, x in enumerate(from_) if x in "SI")
        order = [along, *(i for i in (2, 1, 0) if i != along)]
        volume, spacing = np.transpose(volume, order), tuple(spacing[i] for i in order)
    elif orient:
        axes = [from_.find(x) if x in from_ else from_.find(_OPPOSITE[x]) for x in orient]
        volume, spacing = reorient(volume, from_, orient), tuple(spacing[i] for i in axes)
    if "spacing" in profile:
        volume = resample(volume, spacing, profile["spacing"])
    if "foreground" in profile:
        volume = foreground(volume, profile["foreground"])
    if "adaptive" in profile:
        volume = resample(volume, spacing, adaptive_spacing(spacing, profile["adaptive"]))
    if "patches" in profile:
        volume = patch_budget(volume, *profile["patches"])
    if "slices" in profile:  # slices become squares before one z-score of the whole volume
        size = profile["slices"]
        along = profile["orient"].find("S") if "S" in profile["orient"] else profile["orient"].find("I")
        volume = np.stack([resize(x, (size, size)) for x in np.moveaxis(volume, along, 0)])
    volume = intensity(volume, profile)
    return pad_or_crop(volume, profile["shape"], profile.get("pad", float(volume.min()))) if "shape" in profile else volume


def parts(volume: np.ndarray, profile: dict) -> Iterator[np.ndarray]:
    """What is embedded of a prepared volume, one after another: windows, slices, cells of a grid, or all of it."""
    if "windows" in profile:
        yield from windows(volume, profile["windows"], float(volume.min()), profile.get("overlap", 0.0))
    elif "slices" in profile:
        yield from volume
    elif "grid" in profile:
        yield from grid_crops(volume, *profile["grid"])
    else:
        yield volume


def embedded(model: Extractor, volume: np.ndarray, profile: dict) -> np.ndarray:
    """The mean of the embeddings of a prepared volume's parts."""
    total, n = None, 0
    for part in parts(volume, profile):
        one = np.asarray(model.embed(part), np.float64)
        total, n = (one if total is None else total + one), n + 1
    return (total / n).astype(np.float32)


def adaptive_pool(features: np.ndarray, bins: int) -> np.ndarray:
    """Means over `bins` nearly equal runs of the first axis."""
    n = len(features)
    edges = [(i * n // bins, -(-(i + 1) * n // bins)) for i in range(bins)]
    return np.stack([features[a:b].mean(0) for a, b in edges])


class Extractor(Protocol):
    """What a volume encoder has to offer; one with trained weights plugs in here. An extractor may have a `profile`, and a
    `worker(device)` that is called once in each task, before the first volume, such as to load weights."""

    name: str
    dim: int

    def embed(self, volume: np.ndarray) -> np.ndarray: ...


class MomentExtractor:
    """A stand-in without trained weights: means and deviations over a grid of cells."""

    def __init__(self, name: str = "moments", cells: tuple = (2, 2, 2)):
        self.name, self.cells, self.dim = name, cells, 2 * int(np.prod(cells))

    def embed(self, volume: np.ndarray) -> np.ndarray:
        volume = volume if volume.ndim == 3 else volume[None]
        cell = tuple(-(-n // c) for n, c in zip(volume.shape, self.cells))
        some = windows(volume, cell, float(volume.min()))
        out = np.concatenate([some.mean((1, 2, 3)), some.std((1, 2, 3))])
        return np.pad(out, (0, max(0, self.dim - len(out))))[: self.dim]


class ProfileExtractor:
    """The preprocessing of a kind of extractor, whole, before an encoder: weights aren't part of this, so unless one is
    given, moments over a grid stand for it. `profile` is one of functions.tables.EXTRACTORS, or has its keys."""

    def __init__(self, name: str, profile: dict, encoder: Callable[[np.ndarray], np.ndarray] | None = None, dim: int | None = None):
        self.name, self.profile = name, profile
        self._encode = encoder or MomentExtractor().embed
        self.dim = dim or (profile["dim"] if encoder else MomentExtractor().dim)

    def embed(self, volume: np.ndarray) -> np.ndarray:
        return np.asarray(self._encode(volume))


EXTRACTOR_BUILDERS: dict[str, Callable[[], Extractor]] = {"moments": MomentExtractor}
EXTRACTOR_BUILDERS |= {name: (lambda n=name, p=p: ProfileExtractor(n, p)) for name, p in EXTRACTORS.items()}


def register_extractor(name: str, build: Callable[[], Extractor]) -> None:
    """build() returns an Extractor; one with trained weights takes the place of the stand-in of its name."""
    EXTRACTOR_BUILDERS[name] = build


def build_extractor(name: str) -> Extractor:
    if name not in EXTRACTOR_BUILDERS:
        raise ValueError(f"unknown extractor {name!r}; known: {sorted(EXTRACTOR_BUILDERS)}")
    return EXTRACTOR_BUILDERS[name]()


def load_npz(content: bytes, key: str = "ct") -> np.ndarray:
    """A volume of a zipped numpy file; anything else, such as an HTML error page, is refused."""
    if content[:4] != b"PK\x03\x04":
        raise ValueError("not a zipped numpy file")
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        if key not in z.files:
            raise KeyError(f"{key!r} isn't among {z.files}")
        return z[key].astype(np.float32)


def load_volume(content: bytes, key: str = "ct", slope: float | None = None, intercept: float | None = None, spacing: float | None = None) -> tuple[np.ndarray, tuple, str]:
    """A volume, the spacing of its axes and where they run to, of zipped numpy or NIfTI.

    A zipped volume is [Z, Y, X] with one spacing; a NIfTI file has its affine, whose axes are named by the patient's
    axis that they are nearest to.
    """
    if content[:4] == b"PK\x03\x04":
        return load_npz(content, key), (float(spacing or 1.0),) * 3, "SPL"
    volume, affine = load_nifti(content, 1.0 if slope is None else slope, 0.0 if intercept is None else intercept)
    steps = affine[:3, :3]
    letters = ""
    for axis in range(3):
        at = int(np.argmax(np.abs(steps[:, axis])))
        letters += ("LPS" if steps[at, axis] > 0 else "RAI")[at]
    return volume.astype(np.float32), tuple(float(x) for x in np.linalg.norm(steps, axis=0)), letters


def skipping(load: Callable, content: bytes, **more):
    """What load gives, or None where the file can't be read: a worker goes on with the next volume."""
    try:
        return load(content, **more)
    except (ValueError, KeyError, OSError, EOFError, zlib.error, zipfile.BadZipFile):
        return None


def extract(volumes: DataFrame, extractor: str, profile: dict | None = None, key: str = "ct", device: str = "cpu", skip_broken: bool = False) -> DataFrame:
    """(id, model, embedding) of (id, content and, as far as they are known, spacing, slope, intercept).

    Each file is read, prepared as the profile (the extractor's own, if none is given) says, and embedded in a task, a
    volume at a time. A broken file is an error, or is left out if skip_broken.
    """
    facts = [c for c in ("spacing", "slope", "intercept") if c in volumes.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build_extractor(extractor)
        if hasattr(model, "worker"):
            model.worker(device)
        wants = profile if profile is not None else getattr(model, "profile", {})
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                more = {c: float(row[c]) for c in facts if row[c] is not None and row[c] == row[c]}
                load = (lambda c, **m: load_volume(c, key, **m)) if not skip_broken else (lambda c, **m: skipping(load_volume, c, key=key, **m))
                found = load(bytes(row["content"]), **more)
                if found is not None:
                    out.append((row["id"], model.name, embedded(model, prepare(*found, wants), wants)))
            yield pd.DataFrame(out, columns=["id", "model", "embedding"])

    return volumes.select("id", "content", *[F.col(c).cast("double").alias(c) for c in facts]).mapInPandas(run, "id string, model string, embedding array<float>")


def mean_pool(parts: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """The mean of the vectors of a group, all components at once; vectors are of one length and without nulls."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    return parts.where(F.col(vector).isNotNull()).groupBy(*keys).agg(vector_to_array(Summarizer.mean(v)).alias(vector))


_NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def load_nifti(content: bytes, slope: float = 1.0, intercept: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A volume [X, Y, Z] in Hounsfield units and its 4 x 4 affine, LPS, of a NIfTI-1 file, gzipped or not.

    Values that already reach -800 are taken as they are, others are rescaled.
    """
    import gzip
    import struct

    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = next((o for o in "<>" if len(data) >= 352 and struct.unpack_from(o + "i", data)[0] == 348), None)
    if order is None or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack_from(order + "8h", data, 40)
    kind = struct.unpack_from(order + "h", data, 70)[0]
    if kind not in _NIFTI_TYPES:
        raise ValueError(f"voxel type {kind} isn't supported")
    shape = dims[1 : 1 + dims[0]][:3]
    steps = struct.unpack_from(order + "8f", data, 76)
    start = int(struct.unpack_from(order + "f", data, 108)[0])
    dtype = np.dtype(_NIFTI_TYPES[kind]).newbyteorder(order)
    raw = np.frombuffer(data, dtype, int(np.prod(shape)), start).reshape(shape, order="F").astype(np.float64)
    if struct.unpack_from(order + "h", data, 254)[0] > 0:
        affine = np.vstack([np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4), [0, 0, 0, 1]])
    else:
        affine = np.diag([*steps[1:4], 1.0])
    affine[:2] *= -1  # RAS to LPS
    return (raw if raw.min() <= -800 else raw * slope + intercept), affine


def ct_windows(volume: np.ndarray, ranges: list[tuple[float, float]]) -> np.ndarray:
    """One channel for each (center, width) in Hounsfield units, scaled to [0, 1]."""
    return np.stack([np.clip((volume - (c - w / 2)) / w, 0, 1) for c, w in ranges])


def adaptive_spacing(spacing: tuple, least: float = 0.75) -> tuple:
    """The finest of a volume's spacings on all axes, but no finer than least."""
    return (max(min(spacing), least),) * len(spacing)


def patch_budget(volume: np.ndarray, patch: tuple, most: int) -> np.ndarray:
    """A volume cropped around its middle to whole patches, `most` of them at the most, the longest axis giving way."""
    counts = [max(1, n // p) for n, p in zip(volume.shape, patch)]
    while np.prod(counts) > most and max(counts) > 1:
        counts[int(np.argmax(counts))] -= 1
    return pad_or_crop(volume, tuple(c * p for c, p in zip(counts, patch)), float(volume.min()))


def pooled_projection(features: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The mean over the first axis, flattened, through a linear layer."""
    return weights @ features.mean(0).reshape(-1) + bias
