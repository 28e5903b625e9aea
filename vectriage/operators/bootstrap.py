"""Confidence intervals from resamples that all models share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mixing import mix_numpy
from ..sources.shared import written
from . import metrics


def interval(value: str | Column) -> tuple[Column, Column]:
    """Linearly interpolated 2.5 and 97.5 percentiles; nulls are left out."""
    both = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return F.get(both, F.lit(0)), F.get(both, F.lit(1))


def weighted(df: DataFrame, boot: DataFrame, unit: str) -> DataFrame:
    """Each scored row once for each resample that draws its unit, with the multiplicity as `mult`."""
    return df.join(boot, unit)


def runs(df: DataFrame, boot: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """(keys…, b, label, ap, auroc, prevalence, skill) of each resample."""
    r = metrics.ranking(weighted(df, boot, unit), [*keys, "b"], "mult")
    return r.withColumn("skill", metrics.skill(F.col("ap"), F.col("prevalence"), point=False))


def scalar_runs(df: DataFrame, boot: DataFrame, unit: str, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys…, b, metric, value): macro and micro F1, subset and hamming accuracy, macro PR-AUC of each resample."""
    rows = weighted(df, boot, unit)
    t = metrics.threshold_metrics(rows, [*keys, "b"], threshold, "mult")
    names = ["macro_f1", "micro_f1", "subset_accuracy", "hamming_accuracy"]
    ap = metrics.macro_pr_auc(rows, [*keys, "b"], "mult")
    return t.join(ap, [*keys, "b"]).unpivot([*keys, "b"], [*names, "macro_pr_auc"], "metric", "value")


def points(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys…, metric, value) of the rows as they are."""
    t = metrics.threshold_metrics(df, keys, threshold)
    ap = metrics.macro_pr_auc(df, keys)
    wide = t.join(ap, keys) if keys else t.crossJoin(ap)
    return wide.unpivot(list(keys), ["macro_f1", "micro_f1", "subset_accuracy", "hamming_accuracy", "macro_pr_auc"], "metric", "value")


def _by_label(rows: DataFrame, keys: list[str], threshold: float, weight: str | None) -> DataFrame:
    """(keys…, label, metric, value): AP, F1 and prevalence of each label."""
    r = metrics.ranking(rows, keys, weight).select(*keys, "label", F.col("ap").alias("pr_auc_per_class"), F.col("prevalence").alias("prevalence_per_class"))
    f = metrics.confusion(rows, keys, threshold, weight).select(*keys, "label", F.col("f1").alias("f1_per_class"))
    return r.join(f, [*keys, "label"]).unpivot([*keys, "label"], ["pr_auc_per_class", "prevalence_per_class", "f1_per_class"], "metric", "value")


def evaluate(df: DataFrame, boot: DataFrame, unit: str, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys…, metric, label, point, ci95_low, ci95_high): scalars (label null) and per-class AP, F1 and prevalence."""
    low, high = interval("value")
    scalar = scalar_runs(df, boot, unit, keys, threshold).groupBy(*keys, "metric").agg(low.alias("ci95_low"), high.alias("ci95_high"))
    scalar = points(df, keys, threshold).withColumnRenamed("value", "point").join(scalar, [*keys, "metric"], "left").withColumn("label", F.lit(None).cast("string"))
    rows = weighted(df, boot, unit)
    classes = _by_label(rows, [*keys, "b"], threshold, "mult").groupBy(*keys, "label", "metric").agg(low.alias("ci95_low"), high.alias("ci95_high"))
    classes = _by_label(df, keys, threshold, None).withColumnRenamed("value", "point").join(classes, [*keys, "label", "metric"], "left")
    columns = [*keys, "metric", "label", "point", "ci95_low", "ci95_high"]
    return scalar.select(*columns).unionByName(classes.select(*columns))


def sign(low: Column, high: Column, a: str = "A", b: str = "B", none: str = "ns") -> Column:
    return F.when(low > 0, a).when(high < 0, b).otherwise(none)


def paired(run_a: DataFrame, run_b: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by…, diff, ci95_low, ci95_high, sig): diff is the mean over resamples that both have."""
    both = run_a.select(*by, "b", F.col(value).alias("__a")).join(run_b.select(*by, "b", F.col(value).alias("__b")), [*by, "b"])
    low, high = interval(F.col("__a") - F.col("__b"))
    out = both.groupBy(*by).agg(F.avg(F.col("__a") - F.col("__b")).alias("diff"), low.alias("ci95_low"), high.alias("ci95_high"))
    return out.withColumn("sig", sign(F.col("ci95_low"), F.col("ci95_high")))


def all_pairs(run: DataFrame, model: str, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """(model_a, model_b, by…, diff, ci95_low, ci95_high, sig) of all pairs of models in the given order, in one pass."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model))
    a = run.withColumn("__p", place).where("__p > 0")
    b = a.select(*by, "b", F.col(model).alias("model_b"), F.col("__p").alias("__q"), F.col(value).alias("__b"))
    both = a.withColumnRenamed(model, "model_a").join(b, [*by, "b"]).where("__p < __q").withColumn("__d", F.col(value) - F.col("__b"))
    low, high = interval("__d")
    out = both.groupBy("model_a", "model_b", *by).agg(F.avg("__d").alias("diff"), low.alias("ci95_low"), high.alias("ci95_high"))
    return out.withColumn("sig", sign(F.col("ci95_low"), F.col("ci95_high")))


# ---- many resamples: one task for each label, counts made in the task from the seed

def multiplicities(n_boot: int, n: int, seed: int, mode: str = "mix", first: int = 0) -> np.ndarray:
    """[n_boot, n] draws of n units with replacement, from resample `first` on: by the shared integer mix, or by numpy's
    generator, which has a stream of its own for each resample."""
    out = np.empty((n_boot, n), np.int32)
    for b in range(n_boot):
        drawn = mix_numpy(first + b, np.arange(n), seed) % n if mode == "mix" else np.random.default_rng([seed, first + b]).integers(0, n, n)
        out[b] = np.bincount(drawn, minlength=n)
    return out


def _runs(y: np.ndarray, score: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AP, AUROC and prevalence of each resample; weight is [n_boot, n], NaN where undefined."""
    order = np.argsort(-score, kind="stable")
    y, score, w = y[order], score[order], weight[:, order]
    start = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    cnt = np.add.reduceat(w, start, axis=1).astype(float)
    pos = np.add.reduceat(w * y, start, axis=1).astype(float)
    tp, pp = pos.cumsum(1), cnt.cumsum(1)
    p, n = tp[:, -1], pp[:, -1]
    with np.errstate(invalid="ignore", divide="ignore"):
        ap = np.where(cnt > 0, pos * tp / pp, 0).sum(1) / p
        neg = cnt - pos
        below = (n - p)[:, None] - neg.cumsum(1)
        auc = (pos * (below + 0.5 * neg)).sum(1) / (p * (n - p))
        return np.where(p > 0, ap, np.nan), np.where((p > 0) & (n > p), auc, np.nan), p / n


def _ranked(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Average precision by rank of each resample, rows in order, each as often as its weight; NaN without positives."""
    at = np.flatnonzero(y > 0)
    pp = (np.cumsum(weight, axis=1) - weight)[:, at].reshape(-1)
    w = weight[:, at]
    tp = (np.cumsum(w, axis=1) - w).reshape(-1)
    p, w = w.sum(1), w.reshape(-1)
    total = np.zeros(len(weight))
    left = np.flatnonzero(w > 0)
    j = 1
    while len(left):  # the positives that are drawn j times or more
        total += np.bincount(left // len(at), (tp[left] + j) / (pp[left] + j), minlength=len(total))
        left = left[w[left] > j]
        j += 1
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(p > 0, total / p, np.nan)


#: Multiplicities of units that the resamples of one task add up to, and of rows or units that it holds at a time: a label
#: has many more rows than units where units are few, and a dozen arrays of that size are alive at once.
DRAWS, CELLS = 1 << 24, 1 << 20


def _drawn(k: np.ndarray, first: int, many: int, n: int, seed: int, mode: str = "mix"):
    """(multiplicities of the units, multiplicities of the rows) of some resamples at a time, in order; k is a row's unit."""
    step = max(1, CELLS // max(1, n, len(k)))
    for b in range(first, first + many, step):
        w = multiplicities(min(step, first + many - b), n, seed, mode, b)
        yield w, w[:, k]


def _merged(y: np.ndarray, score: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """(y, score, k, how many) of the rows that have all three in common, greatest scores first."""
    order = np.lexsort((y, k, -score))
    y, score, k = y[order], score[order], k[order]
    head = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) | (k[1:] != k[:-1]) | (y[1:] != y[:-1])])
    return y[head], score[head], k[head], np.diff(np.r_[head, len(y)])


def fast_runs(df: DataFrame, units: DataFrame, unit: str, keys: list[str], n_boot: int = 1000, seed: int = 42, mode: str = "mix", draws: int = DRAWS) -> DataFrame:
    """The rows of `runs` for many resamples: (keys…, label, b, ap, auroc, prevalence, skill).

    A task has the scores of one label of one model, and as many resamples as make `draws` multiplicities, which it makes
    itself, some at a time; a label's scores go to each such task. units numbers the units densely.
    """
    rows, total, step = _blocks(df, units, unit, n_boot, draws)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in [*keys, "label"]) + "b long, ap double, auroc double, prevalence double, skill double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["__first"].iloc[0])
        many = min(step, n_boot - first)
        y, score, k, size = _merged(pdf["y"].to_numpy(float), pdf["score"].to_numpy(float), pdf["__k"].to_numpy())
        some = [_runs(y, score, w * size) for _, w in _drawn(k, first, many, total, seed, mode)]
        ap, auc, prev = (np.concatenate(x) for x in zip(*some))
        with np.errstate(invalid="ignore", divide="ignore"):
            skill = np.where(prev < 0.999, (ap - prev) / (1 - prev), np.nan)
        head = {c: [pdf[c].iloc[0]] * many for c in [*keys, "label"]}
        values = {k: pd.Series(v).astype(object).where(~np.isnan(v), None) for k, v in (("ap", ap), ("auroc", auc), ("prevalence", prev), ("skill", skill))}
        return pd.DataFrame(head | {"b": first + np.arange(many)} | values)

    return rows.select(*keys, "label", "y", "score", "__k", "__first").groupBy(*keys, "label", "__first").applyInPandas(run, schema)


def _blocks(df: DataFrame, units: DataFrame, unit: str, n_boot: int, draws: int) -> tuple[DataFrame, int, int]:
    """df with its units' numbers __k, once for each block of resamples (__first); the number of units, a block's size."""
    from .folds import numbered

    ids = numbered(units.select(unit).distinct(), unit, "__k")
    total = ids.count()
    step = int(max(1, min(n_boot, draws // max(1, total))))
    return df.join(ids, unit).withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(step)))), total, step


def fast_evaluate(df: DataFrame, units: DataFrame, unit: str, keys: list[str], n_boot: int = 1000, seed: int = 42, threshold: float = 0.5, draws: int = DRAWS) -> DataFrame:
    """The rows of `evaluate` for many resamples, without a row for each draw: resamples are made in the tasks.

    A task has the scores of one label of one model; sums over labels come from what tasks return for each resample.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    counts = ["tp", "fp", "fn", "tn"]
    values = [*counts, "ap", "ap_rank", "prevalence"]
    rows, total, step = _blocks(df, units, unit, n_boot, draws)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        first, y = int(pdf["__first"].iloc[0]), pdf["y"].to_numpy(float)
        score, k = pdf["score"].to_numpy(float), pdf["__k"].to_numpy()
        said, true = score >= threshold, y == 1
        cases = {"tp": said & true, "fp": said & ~true, "fn": ~said & true, "tn": ~said & ~true}
        by_unit = np.stack([np.bincount(k[c], minlength=total) for c in cases.values()], 1).astype(float)
        merged_y, merged_score, merged_k, size = _merged(y, score, k)
        some = []
        for units_, w in _drawn(k, first, min(step, n_boot - first), total, seed):
            ap, _, prevalence = _runs(merged_y, merged_score, units_[:, merged_k] * size)
            some.append(np.column_stack([units_ @ by_unit, ap, _ranked(y, w), prevalence]))
        out = dict(zip(values, np.concatenate(some).T))
        columns = {k: pd.Series(np.asarray(v, float)).astype(object).where(~np.isnan(np.asarray(v, float)), None) for k, v in out.items()}
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(out["tp"]) for c in [*keys, "label"]} | {"b": first + np.arange(len(out["tp"]))} | columns)

    classes = rows.select(*keys, "label", "id", "y", "score", "__k", "__first").groupBy(*keys, "label", "__first").applyInPandas(run, f"{head}label string, b long, " + ", ".join(f"{v} double" for v in values))
    # sums over labels and each label's own values both read this
    classes = written(classes.where("tp + fp + fn + tn > 0"), "classes")

    right = F.bool_and((F.col("score") >= threshold).cast("int") == F.col("y"))
    whole = df.groupBy(*keys, "id", unit).agg(right.cast("int").alias("__right")).groupBy(*keys, unit).agg(F.sum("__right").alias("__right"), F.count("*").alias("__rows"))

    def subset(pdf: pd.DataFrame) -> pd.DataFrame:
        first, k = int(pdf["__first"].iloc[0]), pdf["__k"].to_numpy()
        counts_ = pdf[["__rows", "__right"]].to_numpy(float)
        n, right_ = np.concatenate([w @ counts_ for _, w in _drawn(k, first, min(step, n_boot - first), total, seed)]).T
        share = np.where(n > 0, right_ / np.maximum(n, 1), np.nan)
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(n) for c in keys} | {"b": first + np.arange(len(n)), "subset_accuracy": pd.Series(share).astype(object).where(n > 0, None)})

    exact = _blocks(whole, units, unit, n_boot, draws)[0].groupBy(*keys, "__first").applyInPandas(subset, f"{head}b long, subset_accuracy double")

    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-8)
    tp, fp, fn, tn = (F.sum(c) for c in counts)
    scalar = classes.groupBy(*keys, "b").agg(F.avg(f1).alias("macro_f1"), (2 * tp / (2 * tp + fp + fn + 1e-8)).alias("micro_f1"), ((tp + tn) / (tp + fp + fn + tn)).alias("hamming_accuracy"), F.avg("ap_rank").alias("macro_pr_auc")).join(exact, [*keys, "b"])
    names = ["macro_f1", "micro_f1", "subset_accuracy", "hamming_accuracy", "macro_pr_auc"]
    classes = classes.select(*keys, "b", "label", F.col("ap").alias("pr_auc_per_class"), F.col("prevalence").alias("prevalence_per_class"), f1.alias("f1_per_class"))
    columns = [*keys, "label", "metric", "value"]
    each = scalar.withColumn("label", F.lit(None).cast("string")).unpivot([*keys, "label"], names, "metric", "value").select(*columns)
    each = each.unionByName(classes.unpivot([*keys, "label"], ["pr_auc_per_class", "prevalence_per_class", "f1_per_class"], "metric", "value").select(*columns))
    low, high = interval("value")
    spread = each.groupBy(*keys, "label", "metric").agg(low.alias("ci95_low"), high.alias("ci95_high"))
    point = points(df, keys, threshold).withColumn("label", F.lit(None).cast("string")).select(*columns)
    point = point.unionByName(_by_label(df, keys, threshold, None).select(*columns)).withColumnRenamed("value", "point")
    on = F.col("label").eqNullSafe(F.col("__label")) & (F.col("metric") == F.col("__metric"))
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    spread = spread.select(*[F.col(c).alias(f"__{c}") for c in [*keys, "label", "metric"]], "ci95_low", "ci95_high")
    return point.join(spread, on, "left").select(*keys, "metric", "label", "point", "ci95_low", "ci95_high")


def units_table(run: DataFrame, keys: list[str], types: DataFrame) -> DataFrame:
    """(keys…, b, finding_type, value): the mean skill of each resample over all labels (finding_type null) and over the
    labels of each type; types: label, finding_type. What a file of bootstrap units holds, in long form."""
    macro = run.groupBy(*keys, "b").agg(F.avg("skill").alias("value")).withColumn("finding_type", F.lit(None).cast("string"))
    typed = run.join(types.where(F.col("finding_type").isNotNull()), "label").groupBy(*keys, "b", "finding_type").agg(F.avg("skill").alias("value"))
    columns = [*keys, "b", "finding_type", "value"]
    return macro.select(*columns).unionByName(typed.select(*columns))


def macro_interval(run: DataFrame, keys: list[str], value: str, point: DataFrame) -> DataFrame:
    """(keys…, point, ci_low, ci_high): a macro mean and its interval over resamples; point has keys… and point."""
    low, high = interval("__m")
    macro = run.groupBy(*keys, "b").agg(F.avg(value).alias("__m")).groupBy(*keys).agg(low.alias("ci_low"), high.alias("ci_high"))
    return point.join(macro, keys, "left")
