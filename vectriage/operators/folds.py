"""Splitters, groups, duplicates and resamples. All are keyed by id, so every model sees the same folds.

Order comes from a seeded integer mix of dense row numbers, ties by id. Numbering all ids needs one global order; ids are
numbered in sorted ranges (see `numbered`), not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mixing import mix
from ..functions.text import patient_key, reconstruction
from ..sources.shared import written


#: Tables that Catalyst estimates below this are numbered by one window.
SMALL_BYTES = 32 << 20


def numbered(df: DataFrame, key: str, name: str = "k") -> DataFrame:
    """df with the place of each row in the order of key, from 0.

    Rows are dealt into ranges of the key, numbered within each range, and shifted by the sizes of the ranges before;
    a table known to be small is numbered at once. The ranges are written to the shared folder: if an executor is lost, both
    uses of them still see the same ones.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))
    ranged = written(df.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__size")).select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return ranged.withColumn("__own", own).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__own") - 1).cast("long")).drop("__range", "__own", "__start")


def _ranked(ids: DataFrame, key: str, seed: int, repeat: int = 0) -> DataFrame:
    """ids with their place (from 0) in a seeded order, and their number n."""
    mixed = numbered(ids.select(key).distinct(), key).withColumn("__x", mix(F.lit(repeat), F.col("k"), seed))
    order = mixed.withColumn("__order", F.struct("__x", key)).drop("k")
    placed = numbered(order, "__order", "place").drop("__order", "__x")
    return placed


def kfold(ids: DataFrame, key: str = "id", folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, repeat, fold): folds of equal size, the first n % folds of them one larger."""
    n = ids.select(key).distinct().count()
    if not 2 <= folds <= max(n, 2):
        raise ValueError("2 <= folds <= rows is needed")
    large, small = n % folds, n // folds
    p, edge = F.col("place"), large * (small + 1)
    fold = F.when(p < edge, F.floor(p / (small + 1))).otherwise(F.floor((p - edge) / max(small, 1)) + large)
    return _ranked(ids, key, seed).select(key, F.lit(0).alias("repeat"), fold.cast("int").alias("fold"))


def group_kfold(groups: DataFrame, key: str = "id", group: str = "grp", folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, repeat, fold): no group in two folds; groups dealt in turn in a seeded order."""
    if folds < 2:
        raise ValueError("folds >= 2 is needed")
    dealt = _ranked(groups.where(F.col(group).isNotNull()), group, seed).select(group, (F.col("place") % folds).cast("int").alias("fold"))
    return groups.select(key, group).distinct().join(dealt, group).select(key, F.lit(0).alias("repeat"), "fold")


def leave_one_out(ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, repeat, fold): each row a fold of its own."""
    return numbered(ids.select(key).distinct(), key, "fold").select(key, F.lit(0).alias("repeat"), "fold")


def holdout(ids: DataFrame, key: str = "id", test_frac: float = 0.2, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(key, repeat, fold): fold 0 is for tests and fold -1 for training only; tests are max(1, round(n * test_frac)) rows."""
    if not 0 < test_frac < 1 or repeats < 1:
        raise ValueError("0 < test_frac < 1 and repeats >= 1 are needed")
    n = ids.select(key).distinct().count()
    n_test = max(1, round(n * test_frac))
    out = None
    for r in range(repeats):
        own = _ranked(ids, key, seed + r).select(key, F.lit(r).alias("repeat"), F.when(F.col("place") < n_test, 0).otherwise(-1).alias("fold"))
        out = own if out is None else out.unionByName(own)
    return out


def split(ids: DataFrame, strategy: str = "kfold", key: str = "id", group: str | None = None, **more) -> DataFrame:
    """Dispatch by name: kfold, group_kfold, loo, holdout."""
    if strategy == "group_kfold":
        if group is None or group not in ids.columns:
            raise ValueError("group_kfold needs a group column")
        return group_kfold(ids, key, group, **more)
    known = {"kfold": kfold, "loo": leave_one_out, "holdout": holdout}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}")
    return known[strategy](ids, key, **more)


def with_patient(df: DataFrame, key: str = "id", name: str = "grp") -> DataFrame:
    return df.withColumn(name, patient_key(F.col(key)))


def lowest_reconstruction(df: DataFrame, key: str = "id") -> DataFrame:
    """The rows with the lowest reconstruction of each patient and study; ids of another form are all kept."""
    patient, study, recon = reconstruction(F.col(key))
    named = df.withColumn("__p", patient).withColumn("__s", study).withColumn("__r", recon)
    first = F.row_number().over(Window.partitionBy("__p", "__s").orderBy("__r", key))
    formed = named.where(F.col("__r").isNotNull()).withColumn("__first", first).where("__first = 1").drop("__first")
    return formed.unionByName(named.where(F.col("__r").isNull())).drop("__p", "__s", "__r")


def lowest_in_group(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("__first", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("__first = 1").drop("__first")


def scan_resamples(scans: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """(b, key, mult): resamples of single scans beside those of their groups, from a seed of their own (seed + 1000)."""
    return resamples(scans, key, n_boot, seed + 1000)


def subsample(df: DataFrame, place_by: str, partition: str, budgets: list[int], seed: int) -> DataFrame:
    """(…, budget): for each budget the rows that come first in a seeded order within a partition, without replacement.

    Budgets that reach a partition's size are one: all of it.
    """
    window = Window.partitionBy(partition).orderBy(mix(F.lit(0), F.col(place_by), seed), place_by)
    size = F.count("*").over(Window.partitionBy(partition))
    rows = df.withColumn("__place", F.row_number().over(window)).withColumn("__size", size)
    grid = F.array_append(F.filter(F.array(*[F.lit(b).cast("long") for b in sorted(set(budgets))]), lambda b: b < F.col("__size")), F.col("__size"))
    return rows.withColumn("budget", F.explode(grid)).where("__place <= budget").drop("__place", "__size")


def resamples(units: DataFrame, unit: str, n_boot: int, seed: int) -> DataFrame:
    """(b, unit, mult): how often each unit is drawn in resample b of as many draws as there are units. Only drawn ones."""
    n = units.select(unit).distinct().count()
    if not n:
        return units.select(F.lit(0).cast("long").alias("b"), unit, F.lit(0).cast("long").alias("mult")).limit(0)
    spark = units.sparkSession
    draws = spark.range(n_boot * n).select(F.floor(F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("k"))
    drawn = draws.select("b", (mix(F.col("b"), F.col("k"), seed) % n).alias("k")).groupBy("b", "k").agg(F.count("*").alias("mult"))
    return drawn.join(numbered(units.select(unit).distinct(), unit), "k").select("b", unit, "mult")
