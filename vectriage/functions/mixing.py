"""A seeded integer mix that Spark, SQL engines and numpy evaluate alike; every intermediate stays below 2**63."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
ROUNDS = (48271, 69621, 16807)


def mix(b: Column | int, k: Column | int, seed: int) -> Column:
    """A number below MODULUS for draw k of resample b."""
    b, k = (c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long") for c in (b, k))
    x = (b * F.lit(1103515245) + k * F.lit(12345) + F.lit(seed * 40503 + 7)) % F.lit(MODULUS)
    for c in ROUNDS:
        x = ((x * x) % F.lit(MODULUS) + (x * F.lit(c)) % F.lit(MODULUS) + F.lit(c)) % F.lit(MODULUS)
    return x


def mix_numpy(b: np.ndarray | int, k: np.ndarray | int, seed: int) -> np.ndarray:
    x = (np.int64(1103515245) * np.asarray(b, np.int64) + np.int64(12345) * np.asarray(k, np.int64) + np.int64(seed * 40503 + 7)) % MODULUS
    for c in ROUNDS:
        x = ((x * x) % MODULUS + (x * c) % MODULUS + c) % MODULUS
    return x


def mix_rounds_sql(rows: str, b: str, k: str, seed: int, name: str = "x") -> str:
    """A subquery: rows with the mixed number as a column, one round at a time."""
    out = f"SELECT *, (CAST({b} AS BIGINT) * 1103515245 + CAST({k} AS BIGINT) * 12345 + {seed * 40503 + 7}) % {MODULUS} AS {name} FROM {rows}"
    for c in ROUNDS:
        out = f"SELECT * REPLACE ((({name} * {name}) % {MODULUS} + ({name} * {c}) % {MODULUS} + {c}) % {MODULUS} AS {name}) FROM ({out})"
    return f"({out})"
