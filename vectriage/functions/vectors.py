"""Vector and array arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def rounded(v: Column, digits: int = 6) -> Column:
    """Each component rounded, halves away from zero; what is rounded to zero keeps its sign, as in IEEE 754 and in SQL
    engines that round doubles (Spark's round goes by way of a decimal, which has no -0.0)."""
    def one(x: Column) -> Column:
        r = F.round(x, digits)
        return F.when(r == 0, x * 0.0).otherwise(r)

    return F.transform(v, one)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column, eps: float = EPS) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def mean(v: Column) -> Column:
    return total(doubles(v)) / F.size(v)


def deviation(v: Column) -> Column:
    m = mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m)) / F.size(v))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def project(weights: list[list[float]], bias: list[float], v: Column) -> Column:
    """Linear projection W v + b."""
    rows = [dot(F.array(*[F.lit(float(x)) for x in row]), v) + F.lit(float(b)) for row, b in zip(weights, bias)]
    return F.array(*rows)


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask isn't 0; null if there is none."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m != 0, t)), lambda t: t.isNotNull())
    zero = F.transform(F.get(kept, F.lit(0)), lambda _: F.lit(0.0))
    summed = F.aggregate(kept, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(summed, lambda x: x / F.size(kept)))


def last_token(tokens: Column, n: Column) -> Column:
    return F.when(n > 0, F.get(tokens, n - 1))


def cls_and_mean(cls: Column, patches: Column) -> Column:
    """A class token followed by the mean of the patch tokens."""
    zero = F.transform(cls, lambda _: F.lit(0.0))
    summed = F.aggregate(patches, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y.cast("double")))
    return F.concat(doubles(cls), F.transform(summed, lambda x: x / F.size(patches)))


def calibrate_hu(v: Column, slope: Column, intercept: Column) -> Column:
    """Raw values that already reach -800 are Hounsfield units; others are rescaled."""
    return F.when(F.array_min(v) <= -800, doubles(v)).otherwise(F.transform(v, lambda x: x * slope + intercept))


def ras_to_lps(affine: Column) -> Column:
    """Rows 0 and 1 of a 4 x 4 affine change sign."""
    return F.transform(affine, lambda row, i: F.when(i < 2, F.transform(row, lambda x: -x)).otherwise(row))


def isotropic_lps(spacing: Column) -> Column:
    """Affine of a volume [Z, Y, X] with one spacing in millimetres."""
    s, o = spacing.cast("double"), F.lit(0.0)
    return F.array(F.array(-s, o, o, o), F.array(o, -s, o, o), F.array(o, o, s, o), F.array(o, o, o, F.lit(1.0)))


def spacing_of(affine: Column) -> Column:
    """Lengths of the three columns of an affine."""
    return F.array(*[F.sqrt(sum((F.get(F.get(affine, i), j) * F.get(F.get(affine, i), j) for i in range(3)), F.lit(0.0))) for j in range(3)])


def axial_axis(affine: Column) -> Column:
    """The voxel axis with the largest share along z; ties go to the first."""
    z = [F.abs(F.get(F.get(affine, 2), j)) for j in range(3)]
    return F.when((z[0] >= z[1]) & (z[0] >= z[2]), F.lit(0)).when(z[1] >= z[2], F.lit(1)).otherwise(F.lit(2))


def scale_clip(v: Column, a: float, b: float, c: float, d: float) -> Column:
    """[a, b] to [c, d], clipped."""
    return F.transform(v, lambda x: F.least(F.greatest((x.cast("double") - a) / (b - a) * (d - c) + c, F.lit(float(min(c, d)))), F.lit(float(max(c, d)))))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.transform(v, lambda x: F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))))


def shift(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") + by)


def z_score(v: Column, mean_: Column | float | None = None, std: Column | float | None = None, eps: float = 0.0) -> Column:
    """(x - mean) / (std + eps), by given constants or the vector's own."""
    m = mean(v) if mean_ is None else (F.lit(mean_) if not isinstance(mean_, Column) else mean_)
    s = deviation(v) if std is None else (F.lit(std) if not isinstance(std, Column) else std)
    return F.transform(v, lambda x: (x.cast("double") - m) / (s + eps))
