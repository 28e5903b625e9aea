"""Metrics over scored rows in long form: keys…, id, label, y, score, and an optional weight.

A weight is a resample's multiplicity, so points and bootstraps share one definition. Undefined is null, never NaN.
Running sums meet one row for each distinct score. Where a label has very many scores, `buckets` cuts the score range
[0, 1] so that no task sorts all of a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_groups(df: DataFrame, keys: list[str], weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Rows of equal score as one: pos, cnt, and the running sums above (tp, pp) and below (neg_below) it; P, N."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    by = [*keys, "label"]
    g = df.groupBy(*by, "score").agg(F.sum(F.col("y") * w).alias("pos"), F.sum(w).alias("cnt"))
    whole = Window.partitionBy(*by)
    if buckets:
        g = g.withColumn("__b", F.floor(F.col("score") * buckets))
        part = [*by, "__b"]
        sums = g.groupBy(*part).agg(F.sum("pos").alias("__p"), F.sum("cnt").alias("__c"))
        up = Window.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*part, *[F.coalesce(F.sum(a).over(up), F.lit(0.0)).alias(b) for a, b in (("__p", "__tp0"), ("__c", "__pp0"))], F.sum("__p").over(whole).alias("P"), F.sum("__c").over(whole).alias("__all"))
        down = Window.partitionBy(*part).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        g = g.withColumn("tp", F.sum("pos").over(down)).withColumn("pp", F.sum("cnt").over(down)).join(sums, part)
        g = g.withColumn("tp", F.col("tp") + F.col("__tp0")).withColumn("pp", F.col("pp") + F.col("__pp0")).drop("__b", "__tp0", "__pp0")
    else:
        down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        g = g.withColumn("tp", F.sum("pos").over(down)).withColumn("pp", F.sum("cnt").over(down)).withColumn("P", F.sum("pos").over(whole)).withColumn("__all", F.sum("cnt").over(whole))
    n = F.col("__all") - F.col("P")
    below = n - (F.col("pp") - F.col("tp"))
    return g.withColumn("N", n).withColumn("neg_below", below).drop("__all")


def ranking(df: DataFrame, keys: list[str], weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """(keys…, label, n, n_pos, prevalence, ap, auroc): tie-correct average precision and AUROC."""
    g = score_groups(df, keys, weight, buckets)
    neg = F.col("cnt") - F.col("pos")
    ap = F.sum(F.col("pos") / F.col("P") * F.col("tp") / F.col("pp"))
    auc = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * neg))
    out = g.where("cnt > 0").withColumn("P", F.nullif("P", F.lit(0.0))).groupBy(*keys, "label").agg(
        F.sum("cnt").alias("n"), F.sum("pos").alias("n_pos"), ap.alias("ap"), auc.alias("__auc"), F.max("N").alias("__n")
    )
    return out.withColumn("prevalence", F.col("n_pos") / F.col("n")).withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("__n") > 0), F.col("__auc") / (F.col("n_pos") * F.col("__n")))).drop("__auc", "__n")


def average_precision_ranked(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys…, label, ap_rank): average precision with ties broken by id; null without positives.

    A weight is how many times a row is there, one after another: a positive with tp positives among pp rows before it
    adds the sum of (tp + j) / (pp + j) for j from 1 to its weight.
    """
    whole = Window.partitionBy(*keys, "label")
    order = whole.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    ranked = df.withColumn("__w", w).withColumn("__r", F.sum("__w").over(order) - F.col("__w"))
    ranked = ranked.withColumn("__tp", F.sum(F.col("y") * F.col("__w")).over(order) - F.col("y") * F.col("__w")).withColumn("__p", F.sum(F.col("y") * F.col("__w")).over(whole))
    one = lambda j: (F.col("__tp") + j).cast("double") / (F.col("__r") + j)
    gain = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("__w"), F.lit(1))), F.lit(0.0), lambda total, j: total + one(j)) if weight else one(F.lit(1))
    gain = F.when((F.col("y") == 1) & (F.col("__w") > 0), gain / F.col("__p")).otherwise(F.when(F.col("__p") > 0, 0.0))
    return ranked.withColumn("__gain", gain).groupBy(*keys, "label").agg(F.sum("__gain").alias("ap_rank"))


def macro_pr_auc(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys…, macro_pr_auc): the mean over labels of the average precision by rank, without labels that have no positives."""
    return average_precision_ranked(df, keys, weight).groupBy(*keys).agg(F.avg("ap_rank").alias("macro_pr_auc"))


def skill(ap: Column, prevalence: Column, point: bool = True) -> Column:
    """(ap - prevalence) / (1 - prevalence); from 0.999 on a point is 0 and a resample null."""
    out = F.when(prevalence < 0.999, (ap - prevalence) / (1.0 - prevalence))
    return F.when(ap.isNotNull() & (prevalence >= 0.999), F.lit(0.0)).otherwise(out) if point else out


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """(keys…, label, tp, fp, fn, tn, f1)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pred, y = F.col("score") >= threshold, F.col("y") == 1
    count = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    out = df.groupBy(*keys, "label").agg(count(pred & y).alias("tp"), count(pred & ~y).alias("fp"), count(~pred & y).alias("fn"), count(~pred & ~y).alias("tn"))
    return out.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-8))


def threshold_metrics(df: DataFrame, keys: list[str], threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """(keys…, macro_f1, micro_f1, subset_accuracy, hamming_accuracy). The weight is a row's, the same for its labels."""
    c = confusion(df, keys, threshold, weight)
    tp, fp, fn, tn = (F.sum(x) for x in ("tp", "fp", "fn", "tn"))
    macro = c.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), (2 * tp / (2 * tp + fp + fn + 1e-8)).alias("micro_f1"), ((tp + tn) / (tp + fp + fn + tn)).alias("hamming_accuracy"))
    right = (F.col("score") >= threshold).cast("int") == F.col("y")
    w = F.max(weight).cast("double") if weight else F.lit(1.0)
    rows = df.groupBy(*keys, "id").agg(F.bool_and(right).alias("__all"), w.alias("__w"))
    subset = rows.groupBy(*keys).agg((F.sum(F.when(F.col("__all"), F.col("__w")).otherwise(0.0)) / F.sum("__w")).alias("subset_accuracy"))
    return macro.join(subset, keys) if keys else macro.crossJoin(subset)


def prevalence(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return labels.groupBy(*(keys or []), "label").agg(F.avg(F.col("y").cast("double")).alias("prevalence"), F.sum("y").cast("long").alias("n_pos"), F.count("*").alias("n"))


def enough(df: DataFrame, keys: list[str], min_pos: int = 20) -> DataFrame:
    """The rows of labels with min_pos positives or more."""
    kept = df.groupBy(*keys, "label").agg(F.sum("y").alias("__p")).where(F.col("__p") >= min_pos).drop("__p")
    return df.join(kept, [*keys, "label"], "left_semi")


def usable(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of labels that have both positives and negatives."""
    kept = df.groupBy(*keys, "label").agg(F.sum("y").alias("__p"), F.count("*").alias("__n")).where("__p > 0 and __p < __n").drop("__p", "__n")
    return df.join(kept, [*keys, "label"], "left_semi")


def per_class(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """The fact table: (keys…, label, n_samples, n_pos, prevalence, pr_auc, roc_auc, skill) of usable labels."""
    r = ranking(df, keys, None, buckets).where("n_pos > 0 and n_pos < n")
    return r.select(*keys, "label", F.col("n").cast("long").alias("n_samples"), F.col("n_pos").cast("long").alias("n_pos"), "prevalence", F.col("ap").alias("pr_auc"), F.col("auroc").alias("roc_auc"), skill(F.col("ap"), F.col("prevalence")).alias("skill"))


def macro(fact: DataFrame, keys: list[str], min_pos: int = 20) -> DataFrame:
    """Means over the labels with min_pos positives or more."""
    return fact.where(F.col("n_pos") >= min_pos).groupBy(*keys).agg(F.avg("pr_auc").alias("macro_ap"), F.avg("skill").alias("macro_skill"), F.avg("roc_auc").alias("macro_auroc"), F.count("*").alias("n_labels"))


def finite_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    for c in (a, b):
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df
