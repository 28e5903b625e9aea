"""Tables for reports: star joins, pivots, bands of findings, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def concept_features(labels: DataFrame) -> DataFrame:
    """(cohort, label, finding_clean, organ_system, finding_type, prevalence) from (cohort, label, prevalence)."""
    organ = text.organ(F.col("label"))
    return labels.select("cohort", "label", F.col("label").alias("finding_clean"), organ.alias("organ_system"), text.finding_type(F.col("label"), organ).alias("finding_type"), "prevalence")


def with_features(fact: DataFrame, features: DataFrame, how: str = "left") -> DataFrame:
    """The fact table with each label's organ and finding type; features is one row for each cohort and label."""
    return fact.join(features.select("cohort", "label", "organ_system", "finding_type"), ["cohort", "label"], how)


def typed(df: DataFrame) -> DataFrame:
    return df.where(F.col("finding_type").isNotNull() & (F.length("finding_type") > 0))


def mean_by(df: DataFrame, keys: list[str], value: str = "roc_auc") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("n_labels"))


def range_across(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys…, low, mid, high): least, median and greatest over what keys leave."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.median(value).alias("mid"), F.max(value).alias("high"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def bands(df: DataFrame, cohort: str, label: str, by: str, size: int = 10) -> DataFrame:
    """The size most and least frequent labels of each cohort, as bands 'top' and 'bottom' that never meet."""
    down, up = (Window.partitionBy(cohort).orderBy(o, label) for o in (F.desc(by), F.asc(by)))
    rows = df.withColumn("__d", F.row_number().over(down)).withColumn("__u", F.row_number().over(up))
    k = F.least(F.lit(size), F.floor(F.count("*").over(Window.partitionBy(cohort)) / 2))
    rows = rows.withColumn("band", F.when(F.col("__d") <= k, "top").when(F.col("__u") <= k, "bottom"))
    return rows.where(F.col("band").isNotNull()).withColumn("place", F.when(F.col("band") == "top", F.col("__d")).otherwise(F.col("__u"))).drop("__d", "__u")


def best(df: DataFrame, keys: list[str], name: str, value: str, order: list[str] | None = None) -> DataFrame:
    """The first row with the greatest value in each group; among equals by the given order of names, or by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name)) if order else F.col(name)
    w = Window.partitionBy(*keys).orderBy(F.desc(value), place)
    return df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def grid(findings: DataFrame, models: DataFrame, fact: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every finding with every model, and the value where there is one. models is a short list."""
    return findings.crossJoin(F.broadcast(models)).join(fact.select(*on, value), on, "left")


def wide(df: DataFrame, row: str | list[str], column: str, values: list[str], cells: list[str]) -> DataFrame:
    """One row for each group, and a column `<value>_<cell>` for each pair; values are fixed, so missing ones are null."""
    rows = [row] if isinstance(row, str) else row
    return df.groupBy(*rows).agg(*[F.max(F.when(F.col(column) == v, F.col(c))).alias(f"{v}_{c}") for v in values for c in cells])


def reindex(df: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """df with a row for each of names, null where it has none."""
    return names.select(on).join(df, on, "left")


def pairs_in_order(names: DataFrame, name: str, place: str) -> DataFrame:
    b = names.select(F.col(name).alias(f"{name}_b"), F.col(place).alias("__b"))
    return names.select(F.col(name).alias(f"{name}_a"), F.col(place).alias("__a")).join(b, F.col("__a") < F.col("__b")).drop("__a", "__b")


def missing(wanted: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(there, on, "left_anti")


def differences(df: DataFrame, keys: list[str], kind: str, a: str, b: str, value: str) -> DataFrame:
    """(keys…, a, b, difference a - b) of two kinds of a row."""
    return wide(df, keys, kind, [a, b], [value]).select(*keys, F.col(f"{a}_{value}").alias(a), F.col(f"{b}_{value}").alias(b), (F.col(f"{a}_{value}") - F.col(f"{b}_{value}")).alias("difference"))


def latex_rows(df: DataFrame, row: str, columns: list[str], digits: int = 3) -> DataFrame:
    """(row, line): cells joined by ampersands, `--` for missing ones."""
    cell = lambda c: F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{digits}f", F.col(c)))
    return df.select(row, F.concat(F.concat_ws(" & ", F.col(row), *[cell(c) for c in columns]), F.lit(r" \\")).alias("line"))


def fixed_width(df: DataFrame, columns: dict[str, int], digits: int = 3) -> DataFrame:
    """(line): numbers to the right with fixed decimals, other values to the left."""
    kinds = dict(df.dtypes)

    def cell(c: str, n: int):
        if kinds[c] in ("double", "float"):
            return F.lpad(F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double"))), n, " ")
        return F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("--")), n, " ")

    return df.select(F.concat_ws(" ", *[cell(c, n) for c, n in columns.items()]).alias("line"))


def by_greatest(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, greatest, place): names by their greatest value, the greatest first, ties by name; places from 1."""
    top = df.groupBy(name).agg(F.max(value).alias("greatest"))
    return _placed(top, F.desc_nulls_last("greatest"), name)


def by_difficulty(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, mean, place): the easiest, with the greatest mean, first."""
    return _placed(df.groupBy(name).agg(F.avg(value).alias("mean")), F.desc_nulls_last("mean"), name)


def by_median(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, mid, place): the least median first."""
    return _placed(df.groupBy(name).agg(F.median(value).alias("mid")), F.asc_nulls_last("mid"), name)


def _placed(names: DataFrame, order, name: str) -> DataFrame:
    """One row for each model, label or organ of a report, so one window over all of them is small."""
    return names.withColumn("place", F.row_number().over(Window.orderBy(order, F.col(name))))
