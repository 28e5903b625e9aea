"""Registered queries over the driver's tables, and the SQL they are held against.

Stand-ins: scans are `embeddings`; labels are one against the rest, and two that overlap; models are four views of the
vectors; patients are id % 125. Computed doubles are rounded in both forms, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.mixing import mix_rounds_sql
from ..functions.tables import FINDING_TYPE_WORDS, GUARD_WORDS, ORGANS, PHRASES
from ..sources.shared import written
from ..operators import bootstrap, folds, knn, metrics, probe, report, stats, volumes, zeroshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODELS = ["full", "first", "second", "sign"]
N_BOOT = 20


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c, name: str | None = None):
    out = F.round(c, 6)
    return out.alias(name or (c if isinstance(c, str) else "value"))


# ---- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.doubles(F.col("embedding")).alias("v"))


def model_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    views = [v, F.slice(v, 1, 32), F.slice(v, 33, 32), F.transform(v, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), x.alias("v")) for m, x in zip(MODELS, views)]))
    return scans(spark, sf_dir).select("id", each.alias("x")).select("x.model", "id", "x.v")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = F.col("label")
    named = [(f"c{c}", l == c) for c in range(10)] + [("even", l % 2 == 0), ("low", l < 3)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.cast("int").alias("y")) for n, c in named]))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), each.alias("x")).select("id", "x.label", "x.y")


def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.kfold(scans(spark, sf_dir).select("id"), folds=5, seed=42)


def pools(spark: SparkSession, sf_dir: str, weighting: str = "distance", models: list[str] | None = None) -> DataFrame:
    chosen = model_scans(spark, sf_dir) if models is None else model_scans(spark, sf_dir).where(F.col("model").isin(models))
    return knn.pool(chosen, labels(spark, sf_dir), fold_table(spark, sf_dir), 5, weighting, keys=["model"]).withColumn("score", F.round("score", 9))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).select("id", (F.col("id") % 125).alias("grp"))


def boot(spark: SparkSession, sf_dir: str, n_boot: int = N_BOOT, seed: int = 11) -> DataFrame:
    return folds.resamples(patients(spark, sf_dir), "grp", n_boot, seed)


def unstable(df: DataFrame) -> DataFrame:
    """Pools that several branches read are computed once, and written to the shared folder."""
    return written(df, "pools")


# ---- the same inputs as SQL

SCANS = "scans AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
MODEL_SCANS = (
    SCANS + ", model_scans AS (SELECT 'full' AS model, id, v FROM scans UNION ALL SELECT 'first', id, v[1:32] FROM scans UNION ALL SELECT 'second', id, v[33:64] FROM scans"
    " UNION ALL SELECT 'sign', id, list_transform(v, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) FROM scans)"
)
LABELS = "labels_long AS (SELECT vec_id AS id, 'c' || c AS label, CAST(label = c AS INTEGER) AS y FROM embeddings, range(10) t(c) UNION ALL SELECT vec_id, 'even', CAST(label % 2 = 0 AS INTEGER) FROM embeddings UNION ALL SELECT vec_id, 'low', CAST(label < 3 AS INTEGER) FROM embeddings)"
_NUMBERED = "(SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings)"
FOLDS = f"folds AS (SELECT id, ntile(5) OVER (ORDER BY x, id) - 1 AS fold FROM {mix_rounds_sql(_NUMBERED, '0', 'k', 42)})"
_SIM = "SELECT q.model, q.id, t.id AS train_id, list_cosine_similarity(q.v, t.v) AS sim FROM (SELECT * FROM model_scans JOIN folds USING (id)) q JOIN (SELECT * FROM model_scans JOIN folds USING (id)) t ON q.model = t.model AND q.fold <> t.fold"
NEIGHBOURS = f"neighbours AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY sim DESC, train_id) AS rank FROM ({_SIM})) WHERE rank <= 5)"


def pools_sql(weighting: str = "distance") -> str:
    w = "greatest(sim + 1, 1e-6)" if weighting == "distance" else "1.0"
    return f"""{MODEL_SCANS}, {LABELS}, {FOLDS}, {NEIGHBOURS},
pools AS (SELECT v.model, v.id, v.label, l.y, v.score FROM (
  SELECT model, n.id, label, round(sum(y * {w}) / sum({w}), 9) AS score FROM neighbours n JOIN labels_long t ON n.train_id = t.id GROUP BY 1, 2, 3) v JOIN labels_long l ON v.id = l.id AND v.label = l.label)"""


def ranking_sql(rows: str, keys: str, w: str = "1.0") -> str:
    return f"""(SELECT {keys}, label, sum(cnt) AS n, sum(pos) AS n_pos, sum(pos) / sum(cnt) AS prevalence,
      CASE WHEN sum(pos) > 0 THEN sum(CASE WHEN cnt > 0 AND P > 0 THEN pos / P * tp / pp ELSE 0 END) END AS ap,
      CASE WHEN sum(pos) > 0 AND sum(cnt) > sum(pos) THEN sum(pos * ((A - P) - (pp - tp) + 0.5 * (cnt - pos))) / (sum(pos) * (sum(cnt) - sum(pos))) END AS auroc
    FROM (SELECT *, sum(pos) OVER (PARTITION BY {keys}, label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(cnt) OVER (PARTITION BY {keys}, label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pp,
                 sum(pos) OVER (PARTITION BY {keys}, label) AS P, sum(cnt) OVER (PARTITION BY {keys}, label) AS A
          FROM (SELECT {keys}, label, score, CAST(sum(y * {w}) AS DOUBLE) AS pos, CAST(sum({w}) AS DOUBLE) AS cnt FROM {rows} GROUP BY {keys}, label, score))
    GROUP BY {keys}, label)"""


def skill_sql(point: bool = True) -> str:
    return f"CASE WHEN ap IS NULL THEN NULL WHEN prevalence < 0.999 THEN (ap - prevalence) / (1 - prevalence) ELSE {'0' if point else 'NULL'} END"


FACT = f"fact AS (SELECT model, label, CAST(n AS BIGINT) AS n_samples, CAST(n_pos AS BIGINT) AS n_pos, prevalence, ap AS pr_auc, auroc AS roc_auc, {skill_sql()} AS skill FROM {ranking_sql('pools', 'model')} WHERE n_pos > 0 AND n_pos < n)"
_UNITS = "(SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS k FROM (SELECT DISTINCT vec_id % 125 AS grp FROM embeddings))"
_COUNT = "(SELECT count(DISTINCT vec_id % 125) FROM embeddings)"


def boot_sql(n_boot: int = N_BOOT, seed: int = 11) -> str:
    draws = f"(SELECT b, k FROM range({n_boot}) t(b), range({_COUNT}) u(k))"
    return f"boot AS (SELECT b, grp, mult FROM (SELECT b, x % {_COUNT} AS k, count(*) AS mult FROM {mix_rounds_sql(draws, 'b', 'k', seed)} GROUP BY 1, 2) JOIN {_UNITS} USING (k))"


RUNS = f"runs AS (SELECT *, {skill_sql(False)} AS skill FROM {ranking_sql('(SELECT p.*, b, mult FROM pools p JOIN boot ON p.id % 125 = boot.grp)', 'model, b', 'mult')})"

# ---- neighbours and votes


@register("cosine_knn_topk", f"WITH {MODEL_SCANS}, {FOLDS}, {NEIGHBOURS} SELECT id, CAST(rank AS INTEGER) AS rank, train_id, round(sim, 6) AS sim FROM neighbours WHERE model = 'full'")
def cosine_knn_topk(spark, sf_dir):
    return knn.neighbours(scans(spark, sf_dir), fold_table(spark, sf_dir), 5).select("id", "rank", "train_id", r6("sim"))


@register("cosine_knn_topk_join", ORACLE["cosine_knn_topk"])
def cosine_knn_topk_join(spark, sf_dir):
    return knn.neighbours(scans(spark, sf_dir), fold_table(spark, sf_dir), 5, impl="join").select("id", "rank", "train_id", r6("sim"))


def _prob(weighting):
    return f"WITH {pools_sql(weighting)} SELECT model, id, label, y, round(score, 6) AS score FROM pools"


@register("knn_prob_uniform", _prob("uniform"))
def knn_prob_uniform(spark, sf_dir):
    return pools(spark, sf_dir, "uniform").select("model", "id", "label", "y", r6("score"))


@register("knn_prob_distance", _prob("distance"))
def knn_prob_distance(spark, sf_dir):
    return pools(spark, sf_dir).select("model", "id", "label", "y", r6("score"))


@register("normalised_vectors", f"WITH {SCANS} SELECT id, round(list_sum(list_transform(v, lambda x: abs(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-8)))), 6) AS absolute FROM scans")
def normalised_vectors(spark, sf_dir):
    unit = vectors.normalise(F.col("v"))
    return scans(spark, sf_dir).select("id", r6(vectors.total(F.transform(unit, F.abs)), "absolute"))


# ---- splits


@register("kfold_ntile", f"WITH {FOLDS} SELECT id, CAST(fold AS INTEGER) AS fold FROM folds")
def kfold_ntile(spark, sf_dir):
    return fold_table(spark, sf_dir).select("id", "fold")


@register("loo_split", "SELECT vec_id AS id, (SELECT count(*) FROM embeddings) - 1 AS n_train FROM embeddings")
def loo_split(spark, sf_dir):
    split = folds.leave_one_out(scans(spark, sf_dir).select("id"))
    train = split.agg(F.count("*").alias("__n"))
    return split.crossJoin(F.broadcast(train)).select("id", (F.col("__n") - 1).alias("n_train"))


_HOLD = " UNION ALL ".join(
    f"SELECT id, {r} AS repeat, CASE WHEN row_number() OVER (ORDER BY x, id) <= greatest(1, round_even((SELECT count(*) FROM embeddings) * 0.2, 0)) THEN 0 ELSE -1 END AS fold FROM {mix_rounds_sql(_NUMBERED, '0', 'k', 42 + r)}"
    for r in range(3)
)


@register("holdout_split", _HOLD)
def holdout_split(spark, sf_dir):
    return folds.holdout(scans(spark, sf_dir).select("id"), test_frac=0.2, repeats=3, seed=42)


_GROUPS = "(SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS k FROM (SELECT DISTINCT vec_id % 125 AS grp FROM embeddings))"
GROUP_FOLDS = f"group_folds AS (SELECT vec_id AS id, grp, fold FROM (SELECT DISTINCT vec_id FROM embeddings) JOIN (SELECT grp, CAST((row_number() OVER (ORDER BY x, grp) - 1) % 5 AS INTEGER) AS fold FROM {mix_rounds_sql(_GROUPS, '0', 'k', 42)}) g ON vec_id % 125 = g.grp)"


@register("group_kfold", f"WITH {GROUP_FOLDS} SELECT id, fold FROM group_folds")
def group_kfold(spark, sf_dir):
    return folds.group_kfold(patients(spark, sf_dir), folds=5, seed=42).select("id", "fold")


_RECON = "(SELECT 'valid_' || (vec_id % 40) || '_' || chr(CAST(97 + vec_id % 3 AS INTEGER)) || '_' || (vec_id % 7) || CASE WHEN vec_id % 2 = 0 THEN '.nii.gz' ELSE '' END || CASE WHEN vec_id % 50 = 0 THEN '-odd' ELSE '' END AS id, vec_id FROM embeddings)"


def recon_ids(spark, sf_dir):
    v = F.col("vec_id")
    name = F.concat(F.lit("valid_"), (v % 40).cast("string"), F.lit("_"), F.chr(97 + v % 3), F.lit("_"), (v % 7).cast("string"), F.when(v % 2 == 0, ".nii.gz").otherwise(""), F.when(v % 50 == 0, "-odd").otherwise(""))
    return table(spark, sf_dir, "embeddings").select(name.alias("id"), "vec_id")


@register("patient_key", f"SELECT vec_id, coalesce(nullif(regexp_extract(id, '^(valid_[0-9]+)', 1), ''), id) AS grp FROM {_RECON}")
def patient_key(spark, sf_dir):
    return folds.with_patient(recon_ids(spark, sf_dir)).select("vec_id", "grp")


@register(
    "dedup_lowest_recon",
    f"""WITH parsed AS (SELECT id, regexp_extract(regexp_replace(id, '\\.nii\\.gz$', ''), '^(valid_[0-9]+)_([A-Za-z0-9]+)_([0-9]+)$', ['p', 's', 'r']) AS x FROM (SELECT DISTINCT id FROM {_RECON}))
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY x.p, x.s ORDER BY try_cast(x.r AS BIGINT), id) AS k FROM parsed WHERE x.r <> '') WHERE k = 1 UNION ALL SELECT id FROM parsed WHERE x.r = ''""",
)
def dedup_lowest_recon(spark, sf_dir):
    return folds.lowest_reconstruction(recon_ids(spark, sf_dir).select("id").distinct())


@register("dedup_lowest_turn", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def dedup_lowest_turn(spark, sf_dir):
    return folds.lowest_in_group(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@register("bootstrap_counts", f"WITH {boot_sql(50)} SELECT CAST(b AS BIGINT) AS b, grp, mult FROM boot")
def bootstrap_counts(spark, sf_dir):
    return boot(spark, sf_dir, 50)


@register(
    "subsample_budget",
    f"""WITH {FOLDS}, r AS (SELECT id, fold, row_number() OVER (PARTITION BY fold ORDER BY x, id) AS place, count(*) OVER (PARTITION BY fold) AS size FROM {mix_rounds_sql('folds', '0', 'id', 7)})
SELECT fold, budget, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT *, unnest(list_append(list_filter([10::BIGINT, 25, 50, 100000], lambda b: b < size), size)) AS budget FROM r) WHERE place <= budget GROUP BY 1, 2""".replace("SELECT fold,", "SELECT CAST(fold AS INTEGER) AS fold,"),
)
def subsample_budget(spark, sf_dir):
    return folds.subsample(fold_table(spark, sf_dir).select("id", "fold"), "id", "fold", [10, 25, 50, 100000], 7).groupBy("fold", "budget").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# ---- metrics


@register("ap_rank", f"WITH {pools_sql()} SELECT model, label, round(sum(y * cum / r) / max(total), 6) AS ap_rank FROM (SELECT *, sum(y) OVER (PARTITION BY model, label ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY model, label ORDER BY score DESC, id) AS r, nullif(sum(y) OVER (PARTITION BY model, label), 0) AS total FROM pools) GROUP BY 1, 2")
def ap_rank(spark, sf_dir):
    return metrics.average_precision_ranked(pools(spark, sf_dir), ["model"]).select("model", "label", r6("ap_rank"))


@register("ap_tie", f"WITH {pools_sql()} SELECT model, label, round(ap, 6) AS ap FROM {ranking_sql('pools', 'model')}")
def ap_tie(spark, sf_dir):
    return metrics.ranking(pools(spark, sf_dir), ["model"]).select("model", "label", r6("ap"))


@register("auroc", f"WITH {pools_sql()} SELECT model, label, round(auroc, 6) AS auroc FROM {ranking_sql('pools', 'model')}")
def auroc(spark, sf_dir):
    return metrics.ranking(pools(spark, sf_dir), ["model"], buckets=16).select("model", "label", r6("auroc"))


@register("skill", f"WITH {pools_sql()} SELECT model, label, round({skill_sql()}, 6) AS skill FROM {ranking_sql('pools', 'model')}")
def skill(spark, sf_dir):
    return metrics.ranking(pools(spark, sf_dir), ["model"]).select("model", "label", r6(metrics.skill(F.col("ap"), F.col("prevalence")), "skill"))


@register("perclass_fact", f"WITH {pools_sql()}, {FACT} SELECT model, label, n_samples, n_pos, round(prevalence, 6) AS prevalence, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(skill, 6) AS skill FROM fact")
def perclass_fact(spark, sf_dir):
    return metrics.per_class(pools(spark, sf_dir), ["model"]).select("model", "label", "n_samples", "n_pos", *[r6(c) for c in ("prevalence", "pr_auc", "roc_auc", "skill")])


@register("macro_metrics", f"WITH {pools_sql()}, {FACT} SELECT model, round(avg(pr_auc), 6) AS macro_ap, round(avg(skill), 6) AS macro_skill, round(avg(roc_auc), 6) AS macro_auroc, count(*) AS n_labels FROM fact WHERE n_pos >= 20 GROUP BY 1")
def macro_metrics(spark, sf_dir):
    return metrics.macro(metrics.per_class(pools(spark, sf_dir), ["model"]), ["model"]).select("model", *[r6(c) for c in ("macro_ap", "macro_skill", "macro_auroc")], "n_labels")


_CONFUSION = "confusion AS (SELECT model, label, sum(CASE WHEN score >= 0.5 AND y = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN score >= 0.5 AND y = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN score < 0.5 AND y = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN score < 0.5 AND y = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS tn FROM pools GROUP BY 1, 2)"


@register("confusion_f1", f"WITH {pools_sql()}, {_CONFUSION} SELECT *, round(2 * tp / (2 * tp + fp + fn + 1e-8), 6) AS f1 FROM confusion")
def confusion_f1(spark, sf_dir):
    return metrics.confusion(pools(spark, sf_dir), ["model"]).select("model", "label", "tp", "fp", "fn", "tn", r6("f1"))


@register(
    "f1_subset_hamming",
    f"""WITH {pools_sql()}, {_CONFUSION}, a AS (SELECT model, avg(2 * tp / (2 * tp + fp + fn + 1e-8)) AS macro_f1, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn) + 1e-8) AS micro_f1, sum(tp + tn) / sum(tp + fp + fn + tn) AS hamming_accuracy FROM confusion GROUP BY 1),
s AS (SELECT model, avg(CAST(ok AS INTEGER)) AS subset_accuracy FROM (SELECT model, id, bool_and(CAST(score >= 0.5 AS INTEGER) = y) AS ok FROM pools GROUP BY 1, 2) GROUP BY 1)
SELECT model, round(macro_f1, 6) AS macro_f1, round(micro_f1, 6) AS micro_f1, round(hamming_accuracy, 6) AS hamming_accuracy, round(subset_accuracy, 6) AS subset_accuracy FROM a JOIN s USING (model)""",
)
def f1_subset_hamming(spark, sf_dir):
    return metrics.threshold_metrics(pools(spark, sf_dir), ["model"]).select("model", *[r6(c) for c in ("macro_f1", "micro_f1", "hamming_accuracy", "subset_accuracy")])


@register("prevalence", f"WITH {LABELS} SELECT label, round(avg(y), 6) AS prevalence, CAST(sum(y) AS BIGINT) AS n_pos, count(*) AS n FROM labels_long GROUP BY 1")
def prevalence(spark, sf_dir):
    return metrics.prevalence(labels(spark, sf_dir)).select("label", r6("prevalence"), "n_pos", "n")


@register("min_positives", f"WITH {LABELS}, u AS (SELECT label FROM labels_long GROUP BY 1 HAVING sum(y) >= 50) SELECT label, count(*) AS n, count(DISTINCT id % 125) AS patients FROM labels_long WHERE label IN (SELECT label FROM u) GROUP BY 1")
def min_positives(spark, sf_dir):
    return metrics.enough(labels(spark, sf_dir), [], 50).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct(F.col("id") % 125).alias("patients"))


@register("usable_labels", "WITH l AS (SELECT doc_id, 'quality' AS label, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels UNION ALL SELECT doc_id, 'none', 0 FROM labels) SELECT label, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM l GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(*)")
def usable_labels(spark, sf_dir):
    long = table(spark, sf_dir, "labels").withColumn("none", F.lit(0)).unpivot("doc_id", ["quality", "toxic", "none"], "label", "y")
    return metrics.usable(long, []).groupBy("label").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"))


@register("external_scores", f"SELECT label, round(ap, 6) AS ap, round(auroc, 6) AS auroc FROM {ranking_sql('(SELECT 0 AS one, label, y, n_chars AS score FROM (SELECT doc_id, unnest([struct_pack(label := $$quality$$, y := quality), struct_pack(label := $$toxic$$, y := toxic)], recursive := true) FROM labels) JOIN documents USING (doc_id))', 'one')}")
def external_scores(spark, sf_dir):
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "label", "y")
    scored = long.join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")
    return metrics.ranking(scored, []).select("label", r6("ap"), r6("auroc"))


# ---- resamples


@register("bootstrap_macro_auroc_ci", f"WITH {pools_sql()}, {boot_sql()}, {RUNS}, {FACT}, keep AS (SELECT model, label FROM fact WHERE n_pos >= 20), m AS (SELECT model, b, avg(auroc) AS m FROM runs JOIN keep USING (model, label) GROUP BY 1, 2), p AS (SELECT model, avg(roc_auc) AS point, count(*) AS n_labels FROM fact WHERE n_pos >= 20 GROUP BY 1) SELECT model, round(any_value(point), 6) AS point, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, any_value(n_labels) AS n_labels FROM m JOIN p USING (model) GROUP BY 1")
def bootstrap_macro_auroc_ci(spark, sf_dir):
    scored = unstable(metrics.enough(pools(spark, sf_dir), ["model"]).withColumn("grp", F.col("id") % 125))
    run = bootstrap.fast_runs(scored, patients(spark, sf_dir), "grp", ["model"], N_BOOT, 11)
    point = metrics.macro(metrics.per_class(scored, ["model"]), ["model"]).select("model", F.col("macro_auroc").alias("point"), "n_labels")
    return bootstrap.macro_interval(run, ["model"], "auroc", point).select("model", r6("point"), r6("ci_low"), r6("ci_high"), "n_labels")


_TYPE = "CASE WHEN label IN ('even', 'low') THEN 'mixed' WHEN label < 'c5' THEN 'lower' ELSE 'upper' END"


def _type(c="label"):
    return F.when(F.col(c).isin("even", "low"), "mixed").when(F.col(c) < "c5", "lower").otherwise("upper")


@register("bootstrap_skill_by_type", f"WITH {pools_sql()}, {boot_sql()}, {RUNS}, m AS (SELECT model, {_TYPE} AS finding_type, b, avg(skill) AS m FROM runs GROUP BY 1, 2, 3) SELECT model, finding_type, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY 1, 2")
def bootstrap_skill_by_type(spark, sf_dir):
    scored = pools(spark, sf_dir).withColumn("grp", F.col("id") % 125)
    run = bootstrap.runs(scored, boot(spark, sf_dir), "grp", ["model"]).withColumn("finding_type", _type())
    low, high = bootstrap.interval("m")
    return run.groupBy("model", "finding_type", "b").agg(F.avg("skill").alias("m")).groupBy("model", "finding_type").agg(r6(low, "ci_low"), r6(high, "ci_high"))


@register("bootstrap_class_ci", f"WITH {pools_sql()}, {boot_sql()}, {RUNS} SELECT model, label, round(quantile_cont(ap, 0.025), 6) AS ap_low, round(quantile_cont(ap, 0.975), 6) AS ap_high, round(quantile_cont(prevalence, 0.5), 6) AS prevalence_mid FROM runs GROUP BY 1, 2")
def bootstrap_class_ci(spark, sf_dir):
    scored = pools(spark, sf_dir).withColumn("grp", F.col("id") % 125)
    run = bootstrap.runs(scored, boot(spark, sf_dir), "grp", ["model"])
    low, high = bootstrap.interval("ap")
    return run.groupBy("model", "label").agg(r6(low, "ap_low"), r6(high, "ap_high"), r6(F.percentile("prevalence", F.lit(0.5)), "prevalence_mid"))


_PAIRED = "SELECT a.model AS model_a, b.model AS model_b, a.label, a.b, a.ap - b.ap AS d FROM runs a JOIN runs b USING (label, b) WHERE list_position(['full', 'first', 'second', 'sign'], a.model) < list_position(['full', 'first', 'second', 'sign'], b.model)".replace("a.b,", "b AS b,").replace("a.label,", "label,")


@register("paired_diff_sig", f"WITH {pools_sql()}, {boot_sql()}, {RUNS}, d AS ({_PAIRED}), c AS (SELECT model_a, model_b, label, avg(d) AS diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1, 2, 3) SELECT model_a, model_b, label, round(diff, 6) AS diff, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high, CASE WHEN lo > 0 THEN 'A' WHEN hi < 0 THEN 'B' ELSE 'ns' END AS sig FROM c")
def paired_diff_sig(spark, sf_dir):
    scored = pools(spark, sf_dir).withColumn("grp", F.col("id") % 125)
    run = unstable(bootstrap.fast_runs(scored, patients(spark, sf_dir), "grp", ["model"], N_BOOT, 11))
    return bootstrap.all_pairs(run, "model", ["label"], MODELS, "ap").select("model_a", "model_b", "label", r6("diff"), r6("ci95_low"), r6("ci95_high"), "sig")


@register("pairs_all", "WITH m AS (SELECT unnest(['full', 'first', 'second', 'sign']) AS model, unnest(range(4)) AS pos) SELECT a.model AS model_a, b.model AS model_b FROM m a JOIN m b ON a.pos < b.pos")
def pairs_all(spark, sf_dir):
    return report.pairs_in_order(spark.createDataFrame(list(zip(MODELS, range(4))), "model string, pos int"), "model", "pos")


_RANKED = """(SELECT {k}, label, CASE WHEN max(p) > 0 THEN sum(CASE WHEN y = 1 THEN tp * 1.0 / r / p ELSE 0 END) END AS ap_rank FROM (
  SELECT *, sum(y) OVER (PARTITION BY {k}, label ORDER BY score DESC, id, copy) AS tp, row_number() OVER (PARTITION BY {k}, label ORDER BY score DESC, id, copy) AS r, sum(y) OVER (PARTITION BY {k}, label) AS p FROM {rows}) GROUP BY {k}, label)"""
_DRAWN = "(SELECT p.*, b, mult FROM pools p JOIN boot ON p.id % 125 = boot.grp)"


def _evaluated(rows: str, k: str, w: str) -> str:
    """(keys, metric, label, value) of the scalar metrics and of each label's."""
    copies = f"(SELECT *, unnest(range(CAST({w} AS BIGINT))) AS copy FROM {rows})"
    c = f"(SELECT {k}, label, sum(CASE WHEN score >= 0.5 AND y = 1 THEN {w} ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN score >= 0.5 AND y = 0 THEN {w} ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN score < 0.5 AND y = 1 THEN {w} ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN score < 0.5 AND y = 0 THEN {w} ELSE 0 END)::DOUBLE AS tn FROM {rows} GROUP BY {k}, label)"
    whole = f"(SELECT {k}, avg(2 * tp / (2 * tp + fp + fn + 1e-8)) AS macro_f1, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn) + 1e-8) AS micro_f1, sum(tp + tn) / sum(tp + fp + fn + tn) AS hamming_accuracy FROM {c} GROUP BY {k})"
    exact = f"(SELECT {k}, sum(CASE WHEN ok THEN w ELSE 0 END)::DOUBLE / sum(w) AS subset_accuracy FROM (SELECT {k}, id, bool_and(CAST(score >= 0.5 AS INTEGER) = y) AS ok, max({w}) AS w FROM {rows} GROUP BY {k}, id) GROUP BY {k})"
    ap = f"(SELECT {k}, avg(ap_rank) AS macro_pr_auc FROM {_RANKED.format(k=k, rows=copies)} GROUP BY {k})"
    scalar = " UNION ALL ".join(f"SELECT {k}, '{m}' AS metric, NULL AS label, {m} AS value FROM {t}" for m, t in (("macro_f1", whole), ("micro_f1", whole), ("hamming_accuracy", whole), ("subset_accuracy", exact), ("macro_pr_auc", ap)))
    ranked = ranking_sql(rows, k, w)
    return f"{scalar} UNION ALL SELECT {k}, 'f1_per_class', label, 2 * tp / (2 * tp + fp + fn + 1e-8) FROM {c} UNION ALL SELECT {k}, 'pr_auc_per_class', label, ap FROM {ranked} UNION ALL SELECT {k}, 'prevalence_per_class', label, prevalence FROM {ranked}"


@register("evaluate_twenty", f"WITH {pools_sql()}, {boot_sql()}, drawn AS {_DRAWN}, pt AS ({_evaluated('pools', 'model', '1')}), rs AS ({_evaluated('drawn', 'model, b', 'mult')}), ci AS (SELECT model, metric, label, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM rs GROUP BY 1, 2, 3) SELECT pt.model, pt.metric, pt.label, round(value, 6) AS point, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high FROM pt LEFT JOIN ci ON pt.model = ci.model AND pt.metric = ci.metric AND pt.label IS NOT DISTINCT FROM ci.label")
def evaluate_twenty(spark, sf_dir):
    """The whole evaluation of all models, with as many resamples as SQL can follow; evaluate_model has 1000."""
    scored = unstable(pools(spark, sf_dir).withColumn("grp", F.col("id") % 125))
    out = bootstrap.fast_evaluate(scored, patients(spark, sf_dir), "grp", ["model"], N_BOOT, 11)
    return out.select("model", "metric", "label", r6("point"), r6("ci95_low"), r6("ci95_high"))


def _full_pools(weighting: str, name: str) -> str:
    """The pools of the model 'full' under a weighting, which is the model here."""
    w = "greatest(sim + 1, 1e-6)" if weighting == "distance" else "1.0"
    return f"""{name} AS (SELECT '{weighting}' AS model, v.id, v.label, l.y, v.score FROM (
  SELECT n.id, label, round(sum(y * {w}) / sum({w}), 9) AS score FROM neighbours n JOIN labels_long t ON n.train_id = t.id WHERE model = 'full' GROUP BY 1, 2) v JOIN labels_long l ON v.id = l.id AND v.label = l.label)"""


@register("readouts_sign", f"WITH {MODEL_SCANS}, {LABELS}, {FOLDS}, {NEIGHBOURS}, {_full_pools('distance', 'dist')}, {_full_pools('uniform', 'unif')}, pools AS (SELECT * FROM dist UNION ALL SELECT * FROM unif), {boot_sql()}, {RUNS}, d AS (SELECT label, b, max(CASE WHEN model = 'distance' THEN ap END) - max(CASE WHEN model = 'uniform' THEN ap END) AS d FROM runs GROUP BY 1, 2), c AS (SELECT label, avg(d) AS diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1) SELECT label, round(diff, 6) AS diff, round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high, CASE WHEN lo > 0 THEN 'distance>uniform' WHEN hi < 0 THEN 'uniform>distance' ELSE 'tied' END AS diff_sign FROM c")
def readouts_sign(spark, sf_dir):
    """Which of two readouts of one model is better, label by label: what probe_vs_knn_sign does, of two that SQL can express."""
    own, split, full = labels(spark, sf_dir), fold_table(spark, sf_dir), scans(spark, sf_dir)
    near = knn.neighbours(full, split)
    scored = [knn.vote(near, own, w).select(F.lit(w).alias("readout"), "id", "label", "y", F.round("score", 9).alias("score")) for w in ("distance", "uniform")]
    scored = unstable(scored[0].unionByName(scored[1]).withColumn("grp", F.col("id") % 125))
    run = unstable(bootstrap.fast_runs(scored, patients(spark, sf_dir), "grp", ["readout"], N_BOOT, 11))
    out = bootstrap.paired(run.where("readout = 'distance'"), run.where("readout = 'uniform'"), ["label"], "ap")
    return out.select("label", r6("diff"), r6("ci95_low"), r6("ci95_high"), bootstrap.sign(F.col("ci95_low"), F.col("ci95_high"), "distance>uniform", "uniform>distance", "tied").alias("diff_sign"))


@register("evaluate_model", None)
def evaluate_model(spark, sf_dir):
    """All models, 1000 resamples of patients each."""
    scored = unstable(pools(spark, sf_dir).withColumn("grp", F.col("id") % 125))
    out = bootstrap.fast_evaluate(scored, patients(spark, sf_dir), "grp", ["model"], 1000, 11)
    return out.select("model", "metric", "label", r6("point"), r6("ci95_low"), r6("ci95_high"))


@register("bootstrap_thousand", None)
def bootstrap_thousand(spark, sf_dir):
    """All pairs of models, 1000 paired resamples of patients each."""
    scored = pools(spark, sf_dir).withColumn("grp", F.col("id") % 125)
    run = unstable(bootstrap.fast_runs(scored, patients(spark, sf_dir), "grp", ["model"], 1000, 11))
    return bootstrap.all_pairs(run, "model", ["label"], MODELS, "ap").select("model_a", "model_b", "label", r6("diff"), r6("ci95_low"), r6("ci95_high"), "sig")


# ---- probes and zero-shot scores


@register("linear_probe", None)
def linear_probe(spark, sf_dir):
    scores = probe.probe_scores(scans(spark, sf_dir), labels(spark, sf_dir), fold_table(spark, sf_dir))
    return metrics.per_class(scores, []).select("label", "n_samples", "n_pos", r6("pr_auc"), r6("roc_auc"), r6("skill"))


@register("probe_vs_knn_sign", None)
def probe_vs_knn_sign(spark, sf_dir):
    ids, own = patients(spark, sf_dir), labels(spark, sf_dir)
    a = probe.probe_scores(scans(spark, sf_dir), own, fold_table(spark, sf_dir)).select(F.lit("probe").alias("readout"), "id", "label", "y", "score")
    b = knn.pool(scans(spark, sf_dir), own, fold_table(spark, sf_dir)).select(F.lit("knn").alias("readout"), "id", "label", "y", "score")
    scored = a.unionByName(b).withColumn("grp", F.col("id") % 125)
    run = unstable(bootstrap.fast_runs(scored, ids, "grp", ["readout"], 200, 11))
    out = bootstrap.paired(run.where("readout = 'probe'"), run.where("readout = 'knn'"), ["label"], "ap")
    return out.select("label", r6("diff"), r6("ci95_low"), r6("ci95_high"), bootstrap.sign(F.col("ci95_low"), F.col("ci95_high"), "probe>kNN", "kNN>probe", "tied").alias("diff_sign"))


@register("data_efficiency", None)
def data_efficiency(spark, sf_dir):
    return probe.budget_curve(scans(spark, sf_dir), labels(spark, sf_dir), fold_table(spark, sf_dir), [50, 100, 200]).select("budget", r6("macro_skill"))


_AXES = "pos AS (SELECT c, list_transform(range(64), lambda i: CASE WHEN i % 10 = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, list_transform(range(64), lambda i: CASE WHEN (i + 3) % 10 = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS n FROM range(10) t(c))"


@register("zero_shot_sigmoid", f"WITH {SCANS}, {_AXES} SELECT id, 'c' || c AS label, round(1 / (1 + exp(-(list_cosine_similarity(v, p) - list_cosine_similarity(v, n)))), 6) AS score FROM scans, pos")
def zero_shot_sigmoid(spark, sf_dir):
    rows = [(f"c{c}", [float(i % 10 == c) for i in range(64)], [float((i + 3) % 10 == c) for i in range(64)]) for c in range(10)]
    table_ = spark.createDataFrame(rows, "label string, pos array<double>, neg array<double>")
    return zeroshot.score(scans(spark, sf_dir), table_).select("id", "label", r6("score"))


def _labels_sql():
    return ", ".join(f"('{l}')" for l in sorted(set(PHRASES) | {l for ls in ORGANS.values() for l in ls}))


def known_labels(spark):
    return spark.createDataFrame([(l,) for l in sorted(set(PHRASES) | {l for ls in ORGANS.values() for l in ls})], "label string")


_PHRASE = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHRASES.items()) + " ELSE lower(replace(label, '_', ' ')) END"
_ORGAN = "CASE " + " ".join("WHEN label IN (" + ", ".join(f"'{l}'" for l in ls) + f") THEN '{o}'" for o, ls in ORGANS.items()) + " ELSE 'other' END"
_FTYPE = f"CASE WHEN {_ORGAN} = 'devices_surgical' THEN 'device_foreign' WHEN regexp_matches(lower(label), '{'|'.join(GUARD_WORDS)}') THEN 'morphometric_fluid' " + " ".join(f"WHEN regexp_matches(lower(label), '{'|'.join(ws)}') THEN '{n}'" for n, ws in FINDING_TYPE_WORDS.items()) + " END"


@register("prompts", f"SELECT label, 'A chest CT scan showing ' || {_PHRASE} || '.' AS positive, 'A chest CT scan showing no ' || {_PHRASE} || '.' AS negative FROM (VALUES {_labels_sql()}) t(label)")
def prompts(spark, sf_dir):
    p, n = text.prompts(F.col("label"))
    return known_labels(spark).select("label", p.alias("positive"), n.alias("negative"))


@register("taxonomy_type", f"SELECT label, {_ORGAN} AS organ_system, {_FTYPE} AS finding_type FROM (VALUES {_labels_sql()}) t(label)")
def taxonomy_type(spark, sf_dir):
    organ = text.organ(F.col("label"))
    return known_labels(spark).select("label", organ.alias("organ_system"), text.finding_type(F.col("label"), organ).alias("finding_type"))


@register("organ_counts", f"SELECT organ_system, count(*) AS n FROM (SELECT {_ORGAN} AS organ_system FROM (VALUES {_labels_sql()}) t(label)) GROUP BY 1")
def organ_counts(spark, sf_dir):
    return report.value_counts(known_labels(spark).select(text.organ(F.col("label")).alias("organ_system")), "organ_system")


# ---- star joins, ranges, bands, ranks


def _fact(spark, sf_dir):
    return metrics.per_class(pools(spark, sf_dir), ["model"])


@register("star_join_type_mean", f"WITH {pools_sql()}, {FACT} SELECT model, {_TYPE} AS finding_type, round(avg(roc_auc), 6) AS mean_roc_auc, count(roc_auc) AS n_labels FROM fact GROUP BY 1, 2")
def star_join_type_mean(spark, sf_dir):
    dim = labels(spark, sf_dir).select(F.lit("study").alias("cohort"), "label").distinct().select("cohort", "label", F.lit("all").alias("organ_system"), _type().alias("finding_type"))
    joined = report.typed(report.with_features(_fact(spark, sf_dir).withColumn("cohort", F.lit("study")), dim))
    return report.mean_by(joined, ["model", "finding_type"]).select("model", "finding_type", r6("mean_roc_auc"), "n_labels")


@register("organ_range", f"WITH {pools_sql()}, {FACT} SELECT label, round(min(roc_auc), 6) AS low, round(median(roc_auc), 6) AS mid, round(max(roc_auc), 6) AS high FROM fact GROUP BY 1")
def organ_range(spark, sf_dir):
    return report.range_across(_fact(spark, sf_dir), ["label"], "roc_auc").select("label", r6("low"), r6("mid"), r6("high"))


@register(
    "top_bottom_prevalence",
    """WITH p AS (SELECT o_orderpriority AS cohort, 'm' || (o_custkey % 30) AS label, avg(CAST(o_totalprice > 150000 AS INTEGER)) AS prevalence FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY prevalence DESC, label) AS d, row_number() OVER (PARTITION BY cohort ORDER BY prevalence, label) AS u, least(10, count(*) OVER (PARTITION BY cohort) // 2) AS k FROM p)
SELECT cohort, label, round(prevalence, 6) AS prevalence, CASE WHEN d <= k THEN 'top' ELSE 'bottom' END AS band, CAST(CASE WHEN d <= k THEN d ELSE u END AS INTEGER) AS place FROM r WHERE d <= k OR u <= k""",
)
def top_bottom_prevalence(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("cohort"), F.concat(F.lit("m"), (F.col("o_custkey") % 30).cast("string")).alias("label")).agg(F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("prevalence"))
    return report.bands(p, "cohort", "label", "prevalence").select("cohort", "label", r6("prevalence"), "band", "place")


@register("best_encoder", f"WITH {pools_sql()}, {FACT} SELECT label, model, round(roc_auc, 6) AS roc_auc FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY roc_auc DESC, list_position(['full', 'first', 'second', 'sign'], model)) AS k FROM (SELECT model, label, round(roc_auc, 9) AS roc_auc FROM fact)) WHERE k = 1")
def best_encoder(spark, sf_dir):
    fact = _fact(spark, sf_dir).withColumn("roc_auc", F.round("roc_auc", 9))
    return report.best(fact, ["label"], "model", "roc_auc", MODELS).select("label", "model", r6("roc_auc"))


@register("difficulty_order", f"WITH {pools_sql()}, {FACT} SELECT label, round(m, 6) AS mean, CAST(row_number() OVER (ORDER BY m DESC, label) AS INTEGER) AS place FROM (SELECT label, avg(round(roc_auc, 9)) AS m FROM fact GROUP BY 1)")
def difficulty_order(spark, sf_dir):
    return report.by_difficulty(_ratings(spark, sf_dir), "label", "v").select("label", r6("mean"), "place")


@register("model_order", f"WITH {pools_sql()}, {FACT} SELECT model, round(m, 6) AS greatest, CAST(row_number() OVER (ORDER BY m DESC, model) AS INTEGER) AS place FROM (SELECT model, max(round(skill, 9)) AS m FROM fact GROUP BY 1)")
def model_order(spark, sf_dir):
    fact = _fact(spark, sf_dir).select("model", F.round("skill", 9).alias("skill"))
    return report.by_greatest(fact, "model", "skill").select("model", r6("greatest"), "place")


@register("organ_order", f"WITH {pools_sql()}, {FACT} SELECT label, round(m, 6) AS mid, CAST(row_number() OVER (ORDER BY m, label) AS INTEGER) AS place FROM (SELECT label, median(round(roc_auc, 9)) AS m FROM fact GROUP BY 1)")
def organ_order(spark, sf_dir):
    return report.by_median(_ratings(spark, sf_dir), "label", "v").select("label", r6("mid"), "place")


@register("macro_pr_auc", f"WITH {pools_sql()} SELECT model, round(avg(ap_rank), 6) AS macro_pr_auc FROM {_RANKED.format(k='model', rows='(SELECT *, 0 AS copy FROM pools)')} GROUP BY 1")
def macro_pr_auc(spark, sf_dir):
    return metrics.macro_pr_auc(pools(spark, sf_dir), ["model"]).select("model", r6("macro_pr_auc"))


_RANKS = "ranks AS (SELECT model, label, row_number() OVER (PARTITION BY model ORDER BY v, label) AS r FROM (SELECT model, label, round(roc_auc, 9) AS v FROM fact))"


def _ratings(spark, sf_dir):
    return _fact(spark, sf_dir).select("model", "label", F.round("roc_auc", 9).alias("v"))


@register("kendall_w", f"WITH {pools_sql()}, {FACT}, {_RANKS}, s AS (SELECT label, CAST(sum(r) AS DOUBLE) AS r, count(*) AS m FROM ranks GROUP BY 1) SELECT max(m) AS m, count(*) AS n, round(12 * sum((r - (SELECT avg(r) FROM s)) ** 2) / (max(m) ** 2 * (count(*) ** 3 - count(*))), 6) AS w FROM s")
def kendall_w(spark, sf_dir):
    return stats.kendall_w(_ratings(spark, sf_dir), "model", "label", "v").select("m", "n", r6("w"))


@register("spearman_pairs", f"WITH {pools_sql()}, {FACT}, {_RANKS} SELECT a.model AS rater_a, b.model AS rater_b, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM ranks a JOIN ranks b ON a.label = b.label AND a.model < b.model GROUP BY 1, 2")
def spearman_pairs(spark, sf_dir):
    return stats.spearman_pairs(_ratings(spark, sf_dir), "model", "label", "v").select("rater_a", "rater_b", "n", r6("rho"))


@register("complete_items", "WITH p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= (SELECT count(DISTINCT user_id) FROM events)")
def complete_items(spark, sf_dir):
    rated = table(spark, sf_dir, "events").select("user_id", "event_type").distinct().withColumn("v", F.lit(1))
    return stats.complete_items(rated, "user_id", "event_type", "v").groupBy("event_type").agg(F.count("*").alias("n"))


_CELLS = ", ".join(f"max(CASE WHEN model = '{m}' THEN round(roc_auc, 6) END) AS {m}_roc_auc, max(CASE WHEN model = '{m}' THEN round(pr_auc, 6) END) AS {m}_pr_auc" for m in MODELS)


@register("pivot_per_class", f"WITH {pools_sql()}, {FACT} SELECT label, {_CELLS} FROM fact GROUP BY 1")
def pivot_per_class(spark, sf_dir):
    fact = _fact(spark, sf_dir).select("model", "label", r6("roc_auc"), r6("pr_auc"))
    return report.wide(fact, "label", "model", MODELS, ["roc_auc", "pr_auc"])


@register("grid_of_all_events", "WITH c AS (SELECT user_id % 20 AS finding, event_type, avg(value) AS v FROM events GROUP BY 1, 2), f AS (SELECT unnest(range(25)) AS finding), m AS (SELECT DISTINCT event_type FROM events) SELECT CAST(f.finding AS BIGINT) AS finding, m.event_type, round(c.v, 6) AS v FROM f CROSS JOIN m LEFT JOIN c USING (finding, event_type)")
def grid_of_all_events(spark, sf_dir):
    """Findings 20 to 24 have no events, so they are the grid's gaps."""
    events = table(spark, sf_dir, "events")
    cells = events.groupBy((F.col("user_id") % 20).alias("finding"), "event_type").agg(r6(F.avg("value"), "v"))
    return report.grid(spark.range(25).withColumnRenamed("id", "finding"), events.select("event_type").distinct(), cells, ["finding", "event_type"], "v")


@register("events_pivot", "SELECT user_id, " + ", ".join(f"max(CASE WHEN k = {k} THEN n END) AS k{k}_n" for k in range(3)) + " FROM (SELECT user_id, event_id % 3 AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def events_pivot(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    return report.wide(n, "user_id", "k", ["k0", "k1", "k2"], ["n"])


@register("resume_antijoin", "SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 5 = 0)")
def resume_antijoin(spark, sf_dir):
    from ..sources.writers import open_cells

    events = table(spark, sf_dir, "events")
    return open_cells(events.select("user_id", "event_type").distinct(), events.where("event_id % 5 = 0"), ["user_id", "event_type"])


@register("findings_of_region", "SELECT r_name, l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def findings_of_region(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "l_returnflag").agg(F.count("*").alias("n"), r6(F.avg("l_discount"), "mean_discount"))


@register("scored_lineitems", f"SELECT l_returnflag, label, round(ap, 6) AS ap, round(auroc, 6) AS auroc FROM {ranking_sql('(SELECT l_returnflag, l_linestatus AS label, CAST(l_quantity > 25 AS INTEGER) AS y, l_discount AS score FROM lineitem)', 'l_returnflag')}")
def scored_lineitems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("label"), (F.col("l_quantity") > 25).cast("int").alias("y"), F.col("l_discount").alias("score"))
    return metrics.ranking(rows, ["l_returnflag"]).select("l_returnflag", "label", r6("ap"), r6("auroc"))


# ---- arrays and volumes

_HU = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 3000 ELSE 300 END)"


@register("hu_calibration", f"SELECT vec_id, round(list_sum(CASE WHEN list_min(r) <= -800 THEN r ELSE list_transform(r, lambda x: x * 2.0 + -10.0) END), 4) AS total FROM (SELECT vec_id, {_HU} AS r FROM embeddings)")
def hu_calibration(spark, sf_dir):
    raw = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 2 == 0, 3000).otherwise(300))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("r"))
    return rows.select("vec_id", F.round(vectors.total(vectors.calibrate_hu(F.col("r"), F.lit(2.0), F.lit(-10.0))), 4).alias("total"))


@register("affine_spacing", "SELECT vec_id, [round(sqrt(a[1]*a[1] + a[5]*a[5] + a[9]*a[9]), 6), round(sqrt(a[2]*a[2] + a[6]*a[6] + a[10]*a[10]), 6), round(sqrt(a[3]*a[3] + a[7]*a[7] + a[11]*a[11]), 6)] AS spacing, CASE WHEN abs(a[9]) >= abs(a[10]) AND abs(a[9]) >= abs(a[11]) THEN 0 WHEN abs(a[10]) >= abs(a[11]) THEN 1 ELSE 2 END AS axis FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)")
def affine_spacing(spark, sf_dir):
    affine = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", affine.alias("a"))
    return rows.select("vec_id", F.transform(vectors.spacing_of(F.col("a")), lambda x: F.round(x, 6)).alias("spacing"), vectors.axial_axis(F.col("a")).alias("axis"))


@register("intensity_scale", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(greatest((CAST(x AS DOUBLE) + 0.1) / 0.2 * 2 - 1, -1), 1))), 6) AS total FROM embeddings")
def intensity_scale(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(vectors.total(vectors.scale_clip(F.col("embedding"), -0.1, 0.1, -1.0, 1.0)), "total"))


@register("volume_z_score", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs((CAST(x AS DOUBLE) - m) / (s + 1e-8)))), 5) AS total FROM (SELECT vec_id, embedding, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m, list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)")
def volume_z_score(spark, sf_dir):
    z = vectors.z_score(F.col("embedding"), eps=1e-8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.total(F.transform(z, F.abs)), 5).alias("total"))


@register("mean_pool_patches", "SELECT p, list_transform(list(m ORDER BY d), lambda x: round(x, 6)) AS v FROM (SELECT vec_id % 125 AS p, d, avg(CAST(embedding[d] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(d) GROUP BY 1, 2) GROUP BY 1")
def mean_pool_patches(spark, sf_dir):
    pooled = volumes.mean_pool(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 125).alias("p"), F.col("embedding").alias("v")), ["p"])
    return pooled.select("p", vectors.rounded(F.col("v")).alias("v"))


@register("masked_mean_tokens", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE list_transform(range(1, 17), lambda i: round((CAST(embedding[i] AS DOUBLE) + CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[i + 16] AS DOUBLE) ELSE 0 END) / CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END, 6)) END AS v FROM embeddings")
def masked_mean_tokens(spark, sf_dir):
    e, i = F.col("embedding"), F.col("vec_id")
    tokens = F.array(F.slice(e, 1, 16), F.slice(e, 17, 16), F.slice(e, 33, 16))
    mask = F.array((i % 5 != 0).cast("int"), ((i % 5 != 0) & (i % 2 == 0)).cast("int"), F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.rounded(vectors.masked_mean(tokens, mask)).alias("v"))


# ---- text and sources


@register("nested_path", f"WITH n AS (SELECT vec_id, CASE WHEN id LIKE '%.nii.gz' THEN id ELSE id || '.nii.gz' END AS f FROM {_RECON}), p AS (SELECT vec_id, f, string_split(regexp_replace(f, '\\.nii\\.gz$', ''), '_') AS s FROM n) SELECT vec_id, CASE WHEN len(s) >= 3 THEN array_to_string(s[1:2], '_') || '/' || array_to_string(s[1:3], '_') || '/' || f END AS path FROM p")
def nested_path(spark, sf_dir):
    return recon_ids(spark, sf_dir).select("vec_id", text.nested_path(F.col("id")).alias("path"))


@register("spacing_parse", "SELECT event_id, try_cast(string_split(regexp_replace(s, '[\\[\\]]', '', 'g'), ',')[1] AS DOUBLE) AS xy FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || round(value, 3) || ', 0.7]' WHEN 1 THEN CAST(round(value, 3) AS VARCHAR) WHEN 2 THEN 'n/a' ELSE NULL END AS s FROM events)")
def spacing_parse(spark, sf_dir):
    i, v = F.col("event_id") % 4, F.round("value", 3).cast("string")
    s = F.when(i == 0, F.concat(F.lit("["), v, F.lit(", 0.7]"))).when(i == 1, v).when(i == 2, "n/a")
    return table(spark, sf_dir, "events").select("event_id", text.first_number(s).alias("xy"))


@register("percent_cells", f"WITH {LABELS}, p AS (SELECT label, avg(y) / 10 AS p FROM labels_long GROUP BY 1) SELECT label, CASE WHEN p >= 0.01 THEN printf('%.0f%%', p * 100) ELSE printf('%.1f%%', p * 100) END AS cell FROM p")
def percent_cells(spark, sf_dir):
    return metrics.prevalence(labels(spark, sf_dir)).select("label", text.percent(F.col("prevalence") / 10).alias("cell"))


@register("label_scan", "SELECT label, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y FROM labels) GROUP BY 1")
def label_scan(spark, sf_dir):
    from ..sources.readers import long_labels

    return long_labels(table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"]).groupBy("label").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"))


@register("labels_with_whole_reports", "SELECT l.doc_id, l.quality, d.source, c.text AS report FROM labels l JOIN documents d USING (doc_id) LEFT JOIN conversations c ON c.conv_id = l.doc_id AND c.turn = 0")
def labels_with_whole_reports(spark, sf_dir):
    from ..sources.readers import samples

    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    reports = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("report"))
    return samples(own, meta, reports).select(F.col("id").alias("doc_id"), "quality", "source", "report")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from ..streaming.incremental import counts_by_window

    return counts_by_window(table(spark, sf_dir, "events"), "ts", "event_type", "value").select("start", "event_type", "n", F.round("total", 4).alias("total"))


from . import catalog_files, catalog_volumes  # noqa: E402, F401  (they register their queries)
