"""Mixing sources to target weights.

A tree of domains, their languages and their sources gets a token budget. Each level shares what its node has among the
children by weight; a child can take no more than its documents have, times max_epochs, so what it can't take goes to
its siblings by their weights, and only what all children of a node together can't take goes back to the node's own
siblings: nodes carry the capacity of their subtree, and budgets are settled from the top down. Budgets are whole tokens,
weights whole numbers; a level's budgets add up exactly. Then each leaf takes tokens from its documents in a seeded order,
anew in each epoch: whole epochs first, then the first documents of the next, of which the last may be cut.

Tokens are words (runs of characters other than blanks, tabs and line ends). Everything is built-in functions. The tree
is as large as its leaves. A leaf's documents are dealt into about sqrt(n) buckets along the order, so running sums meet
about sqrt(n) rows of a leaf in a task, however much of the corpus a leaf holds.

Defined results: a null domain, language or source is a child of the name 'unknown'. Children without a weight of their
own have the default weight, and children of weight 0 get nothing. Documents without words (null, empty) are never taken.
Ties of the seeded order go to the smaller id; rows that repeat an id are rows of their own, and the order among rows
alike in id and text doesn't matter. A budget beyond the capacity takes all there is. An empty table gives no rows.
Columns that are computed replace input columns of the same name; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, string_columns

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "language", "origin")
NONE = "unknown"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(column: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in sorted(weights.items(), reverse=True):
        out = F.when(column == name, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with a budget: `given` of the parent by `weight`, up to `capacity`. All are whole numbers."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("__ratio", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    group = Window.partitionBy(*parent)
    rows = (
        children.withColumn("__ratio", ratio)
        .withColumn("__left", F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(after))
        .withColumn("__full", (F.col("weight") > 0) & (F.col("capacity") * F.col("__weights") <= F.col("__left") * F.col("weight")))
    )
    # the full ones come first; the others share what these leave
    rows = rows.withColumn("__rest", F.col("given") - F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0)).over(group))
    rows = rows.withColumn("__open", F.when(F.col("__full"), F.lit(0)).otherwise(F.col("weight")))
    rows = rows.withColumn("__total", F.sum("__open").over(group)).withColumn("__to", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.expr("(__rest * __to) div __total - (__rest * (__to - __open)) div __total")
    budget = F.when(F.col("__full"), F.col("capacity")).when(F.col("__open") > 0, part).otherwise(F.lit(0))
    return rows.withColumn("budget", budget.cast("long")).drop("__ratio", "__left", "__weights", "__full", "__rest", "__open", "__total", "__to")


def plan(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], default: int, max_epochs: int) -> DataFrame:
    """leaves (domain, language, origin, tokens, n) with a budget each."""
    d, l, o = LEVELS
    own = {n: weight_of(F.col(n), weights.get(n, {}), default) for n in LEVELS}
    usable = (own[d] > 0) & (own[l] > 0) & (own[o] > 0)
    leaves = leaves.withColumn("capacity", F.when(usable, F.col("tokens") * F.lit(max_epochs)).otherwise(F.lit(0)))
    whole = Window.partitionBy()
    level = leaves.groupBy(d).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("__own"))
    level = level.withColumn("tokens", F.sum("__own").over(whole)).withColumn("given", F.least(budget, F.sum("capacity").over(whole)))
    top = share_out(level.withColumn("weight", own[d]), [], d).select(d, F.col("budget").alias("given"))
    level = leaves.groupBy(d, l).agg(F.sum("capacity").alias("capacity")).withColumn("weight", own[l]).join(top, d)
    mid = share_out(level, [d], l).select(d, l, F.col("budget").alias("given"))
    level = leaves.withColumn("weight", own[o]).join(mid, [d, l])
    return share_out(level, [d, l], o).select(d, l, o, "tokens", "n", "budget")


def mix_sources(
    df: DataFrame,
    domain: Column,
    language: Column,
    source: Column,
    weights: dict[str, dict[str, int]],
    share: float | None = None,
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 1,
    default: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of df that are taken, once for each epoch: with domain, language, origin, tokens, epoch and taken.

    The budget is that many tokens, or the share of all tokens (rounded down). taken is less than tokens for a cut one.
    """
    string_columns(df, key, text)
    if (share is None) == (budget is None) or max_epochs < 1 or (share or budget or 0) < 0:
        raise ValueError("one of share and budget, neither negative, and max_epochs of 1 or more are needed")
    passed = [c for c in df.columns if c not in (*LEVELS, "tokens", "epoch", "taken")]
    names = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(LEVELS, (domain, language, source))]
    rows = df.select(*passed, *names, word_count(F.col(text)).alias("tokens")).where("tokens > 0")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    amount = F.floor(F.col("tokens") * F.lit(float(share))).cast("long") if share is not None else F.lit(int(budget)).cast("long")
    chosen = plan(leaves, amount, weights, default, max_epochs).where("budget > 0")
    chosen = chosen.select(
        *[F.col(n).alias(f"__{n}") for n in LEVELS],
        F.expr("cast(budget div tokens as int)").alias("__whole"),
        (F.col("budget") % F.col("tokens")).alias("__rest"),
        F.ceil(F.sqrt("n")).cast("long").alias("__buckets"),
    )
    chosen = materialize(chosen, "budgets")
    at = F.lit(True)
    for n in LEVELS:
        at = at & (F.col(n) == F.col(f"__{n}"))
    rows = rows.join(chosen, at)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = rows.withColumn("__place", place).withColumn("__bucket", F.floor(F.conv(F.substring("__place", 1, 8), 16, 10).cast("long") * F.col("__buckets") / F.lit(float(1 << 32))).cast("long"))

    leaf = [f"__{n}" for n in LEVELS]
    sums = rows.where("__rest > 0").groupBy(*leaf, "__bucket").agg(F.sum("tokens").alias("__own"))
    along = Window.partitionBy(*leaf).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.withColumn("__before", F.coalesce(F.sum("__own").over(along), F.lit(0))).select(*[F.col(c).alias(f"{c}_s") for c in leaf], F.col("__bucket").alias("__bucket_s"), "__before"), "starts")
    same = F.col("__bucket") == F.col("__bucket_s")
    for c in leaf:
        same = same & (F.col(c) == F.col(f"{c}_s"))
    ordered = Window.partitionBy(*leaf, "__bucket").orderBy("__place", key, text).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, same, "left")
    rows = rows.withColumn("__at", F.coalesce(F.col("__before"), F.lit(0)) + F.coalesce(F.sum("tokens").over(ordered), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("__rest") - F.col("__at")))
    each = F.transform(F.sequence(F.lit(0), F.col("__whole")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("__whole"), F.col("tokens")).otherwise(part).cast("long").alias("taken")))
    return rows.select(*passed, *LEVELS, "tokens", F.explode(each).alias("__each")).select(*passed, *LEVELS, "tokens", "__each.epoch", "__each.taken").where("taken > 0")


def cut_text(text: Column, tokens: Column, taken: Column) -> Column:
    """The first `taken` words of a text that is cut, joined by blanks; the text itself where it isn't cut."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(taken >= tokens, text).otherwise(F.array_join(F.slice(words, F.lit(1), taken.cast("int")), " "))
