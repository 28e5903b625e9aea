"""Registered queries that write files to the shared folder and read them back, and report tables, each held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import bootstrap, folds, metrics, probe, report, stats
from ..sources import readers, writers
from ..sources.shared import shared_dir
from . import evaluate as evaluation
from .catalog import _CONFUSION, _DRAWN, _PAIRED, _RANKS, _TYPE, FACT, FOLDS, MODELS, RUNS, _evaluated, _fact, _ratings, _type, boot, boot_sql, fold_table, labels, patients, pools, pools_sql, r6, register, scans, table, unstable


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/vectriage/{name}-{uuid.uuid4().hex}"


# ---- label files and what stands beside them


@register("json_labels", "SELECT CAST(doc_id AS VARCHAR) AS id, label, CAST(y AS INTEGER) AS y FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y FROM labels)")
def json_labels(spark, sf_dir):
    """Boolean fields of records are the labels."""
    path = folder(spark, "labels-json")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("NoteAcc_DEID"), F.lit("file.npz").alias("image"), (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    rows.write.json(path)
    return readers.read_label_json(spark, path, lines=True)


_ACCEPTED = "(SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 400) AND doc_id IN (SELECT conv_id FROM conversations) ORDER BY CAST(doc_id AS VARCHAR) LIMIT 5)"


@register("csv_labels_limited", f"SELECT CAST(doc_id AS VARCHAR) AS id, label, CAST(y AS INTEGER) AS y FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y FROM labels WHERE doc_id IN {_ACCEPTED})")
def csv_labels_limited(spark, sf_dir):
    """A column for each label; the limit counts ids that have both a file and metadata."""
    path = folder(spark, "labels-csv")
    table(spark, sf_dir, "labels").select(F.col("doc_id").alias("VolumeName"), "quality", "toxic").write.csv(path, header=True)
    file = table(spark, sf_dir, "documents").where("n_chars > 400").select(F.col("doc_id").cast("string").alias("id"))
    meta = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"))
    return readers.read_label_csv(spark, path, max_samples=5, needs={"file": file, "metadata": meta})


@register("skipped_samples", "SELECT count(*) FILTER (f AND m) AS found, count(*) FILTER (NOT f) AS missing_file, count(*) FILTER (f AND NOT m) AS missing_metadata FROM (SELECT doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 400) AS f, doc_id IN (SELECT conv_id FROM conversations) AS m FROM (SELECT DISTINCT doc_id FROM labels))")
def skipped_samples(spark, sf_dir):
    """How many ids are left out, and for want of what, counted on the way."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("quality").alias("label"), F.col("quality").alias("y"))
    file = table(spark, sf_dir, "documents").where("n_chars > 400").select(F.col("doc_id").alias("id"))
    meta = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    seen = Observation(f"skipped-{uuid.uuid4().hex}")
    readers.accepted(own, {"file": file, "metadata": meta}, 0, seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(int(seen.get[n]) for n in ("found", "missing_file", "missing_metadata"))], "found long, missing_file long, missing_metadata long")


_SPACING = "CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 7 = 1 THEN '' ELSE CAST(round(value, 3) AS VARCHAR) END"


@register("spacing_file", f"SELECT CAST(event_id AS VARCHAR) AS id, try_cast({_SPACING} AS DOUBLE) AS spacing FROM events WHERE try_cast({_SPACING} AS DOUBLE) IS NOT NULL")
def spacing_file(spark, sf_dir):
    path, i = folder(spark, "spacing-csv"), F.col("event_id")
    value = F.when(i % 7 == 0, "x").when(i % 7 == 1, "").otherwise(F.round("value", 3).cast("string"))
    table(spark, sf_dir, "events").select(i.alias("NoteAcc_DEID"), value.alias("final_spacing")).write.csv(path, header=True)
    return readers.read_spacing(spark, path)


@register("metadata_file", "SELECT CAST(event_id AS VARCHAR) AS id, 1.0::DOUBLE AS slope, -1024.0::DOUBLE AS intercept, CAST(round(value, 3) AS DOUBLE) AS xy, 1.5::DOUBLE AS z FROM events WHERE event_id % 4 <> 0")
def metadata_file(spark, sf_dir):
    path, i, v = folder(spark, "metadata-csv"), F.col("event_id"), F.round("value", 3).cast("string")
    xy = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, v).otherwise(F.concat(F.lit("["), v, F.lit(", "), v, F.lit("]")))
    rows = table(spark, sf_dir, "events").select(i.alias("VolumeName"), F.lit("1").alias("RescaleSlope"), F.lit("-1024").alias("RescaleIntercept"), xy.alias("XYSpacing"), F.lit("1.5").alias("ZSpacing"))
    rows.write.csv(path, header=True, escape='"')
    return readers.read_metadata(spark, path)


@register("reports_file", "SELECT conv_id || '_' || turn AS id, md5(text) AS findings, role AS impressions FROM conversations")
def reports_file(spark, sf_dir):
    """Whole texts, with line breaks and quotes, through CSV."""
    path = folder(spark, "reports-csv")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("VolumeName"), F.col("text").alias("Findings_EN"), F.col("role").alias("Impressions_EN"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.read_reports(spark, path).select("id", F.md5("findings").alias("findings"), "impressions")


@register("categories_file", "SELECT doc_id AS id, 'toxic' AS label, toxic AS y FROM labels")
def categories_file(spark, sf_dir):
    path = folder(spark, "categories")
    spark.createDataFrame([(["quality"], ["toxic", "other"])], "form array<string>, content array<string>").write.json(path)
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic").unpivot("id", ["quality", "toxic"], "label", "y")
    return readers.in_category(own, readers.read_categories(spark, path), "content")


@register("label_subset", "SELECT doc_id AS id, 'toxic' AS label, toxic AS y FROM labels")
def label_subset(spark, sf_dir):
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic").unpivot("id", ["quality", "toxic"], "label", "y")
    return readers.labels_subset(own, ["toxic"])


@register("samples_with_spacing", "SELECT l.doc_id AS id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS spacing FROM labels l JOIN documents d USING (doc_id) WHERE d.n_chars > 400")
def samples_with_spacing(spark, sf_dir):
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    spacing = table(spark, sf_dir, "documents").where("n_chars > 400").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("spacing"))
    return readers.samples(own, spacing)


@register("finite_pairs", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 3 > 0 AND event_id % 5 > 0")
def finite_pairs(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf_dir, "events").select(F.when(i % 3 > 0, v).alias("a"), F.when(i % 5 == 0, F.lit(float("nan"))).otherwise(v).alias("b"))
    return metrics.finite_pairs(rows, "a", "b").agg(F.count("*").alias("n"), F.round(F.sum("a"), 4).alias("total"))


# ---- caches, pools and result files


@register("embedding_cache", "SELECT CAST(vec_id AS VARCHAR) AS id, 'a' AS model, round(CAST(-embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def embedding_cache(spark, sf_dir):
    """Two models' vectors, of which one is read under the other's name."""
    path, e = folder(spark, "cache"), F.col("embedding")
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("d").alias("dataset"), e.alias("embedding"))
    both = own.withColumn("model", F.lit("a")).unionByName(own.withColumn("model", F.lit("b")).withColumn("embedding", F.transform("embedding", lambda x: -x)))
    writers.write_embeddings(both, path)
    return readers.read_embeddings(spark, path, {"a": "b"}).select("id", "model", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def _pools(spark, sf_dir) -> DataFrame:
    return unstable(pools(spark, sf_dir).withColumn("cohort", F.lit("c")).withColumn("readout", F.lit("knn")).withColumn("id", F.col("id").cast("string")))


@register("pool_files", f"WITH {pools_sql()} SELECT model, 'knn' AS readout, label, count(*) AS n, round(sum(score), 4) AS total FROM pools WHERE model <> 'sign' GROUP BY 1, 3 UNION ALL SELECT 'sign', 'zs', label, count(*), round(sum(score), 4) FROM pools WHERE model = 'sign' GROUP BY 3")
def pool_files(spark, sf_dir):
    """Pools by cell, one model's as a prediction file of another readout, read by readout."""
    path, single, own = folder(spark, "pools"), folder(spark, "predictions"), _pools(spark, sf_dir)
    own.where("model = 'sign'").select("id", "label", "y", "score").write.parquet(single)
    there, _ = readers.existing(spark, {"sign": single})
    writers.write_pools(own.where("model <> 'sign'"), path)
    writers.write_pools(readers.read_predictions(spark, there["sign"], "c", "sign"), path)
    both = readers.read_pools(spark, path, "knn").unionByName(readers.read_pools(spark, path, "zs"))
    return both.groupBy("model", "readout", "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@register("result_file", f"WITH {pools_sql()}, {FACT} SELECT model, label, n_samples, n_pos, round_even(prevalence, 4) AS prevalence, round_even(round(pr_auc, 9), 4) AS pr_auc FROM fact")
def result_file(spark, sf_dir):
    """The fact table through a CSV with four decimals, and a schema of its own."""
    path = folder(spark, "perclass-csv")
    fact = _fact(spark, sf_dir).withColumn("pr_auc", F.round("pr_auc", 9))
    named = fact.select(F.lit("d").alias("dataset"), F.lit("s").alias("suffix"), "model", F.lit("knn").alias("readout"), "label", "n_samples", "n_pos", "prevalence", "pr_auc", "roc_auc")
    writers.write_csv(named, path)
    return readers.read_result(spark, path, readers.PER_CLASS).select("model", "label", "n_samples", "n_pos", "prevalence", "pr_auc")


@register("pools_complete", "SELECT event_type AS model, count(DISTINCT user_id) AS n_ids, count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events) AS complete FROM events GROUP BY 1")
def pools_complete(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("id"))
    return readers.same_ids(own, ["model"])


_TARGETS = "t AS (SELECT event_type AS m, user_id AS id, max(CAST(value > 50 AS INTEGER)) AS y FROM events GROUP BY 1, 2)"


@register("targets_compared", f"WITH {_TARGETS}, n AS (SELECT m, count(*) AS n FROM t GROUP BY 1), b AS (SELECT a.m AS model_a, b.m AS model_b, count(*) AS n_shared, sum(CAST(a.y <> b.y AS INTEGER)) AS n_differ FROM t a JOIN t b ON a.id = b.id AND a.m < b.m GROUP BY 1, 2) SELECT a.m AS model_a, b.m AS model_b, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared, CAST(a.n + b.n - 2 * coalesce(n_shared, 0) AS BIGINT) AS n_only, CAST(coalesce(n_differ, 0) AS BIGINT) AS n_differ FROM n a JOIN n b ON a.m < b.m LEFT JOIN b ON b.model_a = a.m AND b.model_b = b.m".replace("LEFT JOIN b ON b.model_a = a.m AND b.model_b = b.m", "LEFT JOIN b s ON s.model_a = a.m AND s.model_b = b.m"))
def targets_compared(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("id")).agg(F.max((F.col("value") > 50).cast("int")).alias("y"))
    return readers.same_targets(own.withColumn("label", F.lit("l")))


@register("stale_pairs", "WITH c AS (SELECT event_type AS model, max(event_id) AS w FROM events GROUP BY 1), p AS (SELECT a.model AS model_a, b.model AS model_b, a.w AS wa, b.w AS wb, (SELECT max(w) FROM c) AS top FROM c a JOIN c b ON a.model < b.model) SELECT model_a, model_b FROM p WHERE NOT (top > wa AND top > wb)")
def stale_pairs(spark, sf_dir):
    caches = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.max("event_id").alias("written"))
    pairs = caches.select(F.col("model").alias("model_a")).join(caches.select(F.col("model").alias("model_b")), F.col("model_a") < F.col("model_b"))
    done = pairs.crossJoin(caches.agg(F.max("written").alias("written")))
    return evaluation.stale_pairs(pairs, done, caches)


@register("cells_left", "SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events) e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 5 = 0 AND d.user_id = e.user_id AND d.event_type = e.event_type) ORDER BY 1, 2 LIMIT 7")
def cells_left(spark, sf_dir):
    """The chunk limiter: the first cells that aren't done."""
    events = table(spark, sf_dir, "events")
    return writers.open_cells(events.select("user_id", "event_type").distinct(), events.where("event_id % 5 = 0"), ["user_id", "event_type"], 7)


# ---- splits and resamples


@register("strategies", "SELECT 'loo' AS strategy, count(*) AS n, CAST(count(*) AS BIGINT) AS n_folds FROM embeddings UNION ALL SELECT 'kfold', count(*), 5 FROM embeddings UNION ALL SELECT 'group_kfold', count(*), 5 FROM embeddings UNION ALL SELECT 'holdout', count(*), 2 FROM embeddings")
def strategies(spark, sf_dir):
    ids = patients(spark, sf_dir)
    found = [folds.split(ids, s, **({"group": "grp"} if s == "group_kfold" else {})).select(F.lit(s).alias("strategy"), "id", "fold") for s in ("loo", "kfold", "group_kfold", "holdout")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).groupBy("strategy").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("n_folds"))


def _scan_boot(seed: int, n_boot: int = 5) -> str:
    from ..functions.mixing import mix_rounds_sql

    draws = f"(SELECT b, k FROM range({n_boot}) t(b), range((SELECT count(*) FROM embeddings)) u(k))"
    return f"SELECT b, id, mult FROM (SELECT b, x % (SELECT count(*) FROM embeddings) AS k, count(*) AS mult FROM {mix_rounds_sql(draws, 'b', 'k', seed)} GROUP BY 1, 2) JOIN (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) USING (k)"


@register("scan_resamples", f"SELECT CAST(b AS BIGINT) AS b, id, mult FROM ({_scan_boot(1011)})")
def scan_resamples(spark, sf_dir):
    return folds.scan_resamples(scans(spark, sf_dir).select("id"), "id", 5, 11)


@register("row_bootstrap", f"WITH {pools_sql()}, rb AS ({_scan_boot(3)}), r AS (SELECT b, label, sum(y * mult)::DOUBLE / sum(mult) AS prevalence FROM pools JOIN rb USING (id) WHERE model = 'full' GROUP BY 1, 2) SELECT label, round(avg(prevalence), 6) AS mean FROM r GROUP BY 1")
def row_bootstrap(spark, sf_dir):
    """Rows drawn one by one, as multiplicities."""
    scored = pools(spark, sf_dir, models=["full"])
    run = bootstrap.runs(scored, folds.resamples(scored.select("id"), "id", 5, 3), "id", ["model"])
    return run.groupBy("label").agg(r6(F.avg("prevalence"), "mean"))


# ---- evaluations as tables

_RESULTS = f"{pools_sql()}, {boot_sql()}, drawn AS {_DRAWN}, pt AS ({_evaluated('pools', 'model', '1')}), rs AS ({_evaluated('drawn', 'model, b', 'mult')}), ci AS (SELECT model, metric, label, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM rs GROUP BY 1, 2, 3), results AS (SELECT pt.model, pt.metric, pt.label, value AS point, lo AS ci95_low, hi AS ci95_high FROM pt LEFT JOIN ci ON pt.model = ci.model AND pt.metric = ci.metric AND pt.label IS NOT DISTINCT FROM ci.label)"
SCALARS = ["macro_f1", "micro_f1", "hamming_accuracy", "subset_accuracy", "macro_pr_auc"]


def _results(spark, sf_dir) -> DataFrame:
    scored = unstable(pools(spark, sf_dir).withColumn("grp", F.col("id") % 125))
    out = bootstrap.evaluate(scored, boot(spark, sf_dir), "grp", ["model"])
    return out.select("model", "metric", "label", r6("point"), r6("ci95_low"), r6("ci95_high"))


def _cells(column: str, values: list[str], cells: list[str]) -> str:
    return ", ".join(f"max(CASE WHEN {column} = '{v}' THEN round({c}, 6) END) AS {v}_{c}" for v in values for c in cells)


@register("aggregate_table", f"WITH {_RESULTS} SELECT model, {_cells('metric', SCALARS, ['point', 'ci95_low', 'ci95_high'])} FROM results WHERE label IS NULL GROUP BY 1")
def aggregate_table(spark, sf_dir):
    return evaluation.aggregate_table(_results(spark, sf_dir), SCALARS)


@register("class_table", f"WITH {_RESULTS} SELECT label, max(CASE WHEN metric = 'prevalence_per_class' THEN round(point, 6) END) AS prevalence, " + _cells("model", MODELS, ["point", "ci95_low", "ci95_high"]).replace("WHEN model", "WHEN metric = 'pr_auc_per_class' AND model") + " FROM results WHERE label IS NOT NULL GROUP BY 1")
def class_table(spark, sf_dir):
    return evaluation.class_table(_results(spark, sf_dir), MODELS)


@register("results_json", f"WITH {_RESULTS} SELECT model, max(CASE WHEN metric = 'macro_f1' THEN round(point, 6) END) AS macro_f1, max(CASE WHEN metric = 'macro_pr_auc' THEN round(ci95_high, 6) END) AS macro_high, max(CASE WHEN metric = 'f1_per_class' AND label = 'c3' THEN round(ci95_low, 6) END) AS c3_low FROM results GROUP BY 1")
def results_json(spark, sf_dir):
    """Nested results as JSON files, and some cells of them read again."""
    path = folder(spark, "results-json")
    writers.write_json(writers.nested_json(_results(spark, sf_dir), ["model"]), path)
    rows = spark.read.schema("model string, json string").json(path)
    cell = lambda at: F.get_json_object("json", at).cast("double")
    classes = F.get_json_object("json", "$.per_class.f1_per_class")
    return rows.select("model", cell("$.aggregate.macro_f1.point").alias("macro_f1"), cell("$.aggregate.macro_pr_auc.ci95_high").alias("macro_high"), F.get_json_object(classes, "$.c3.ci95_low").cast("double").alias("c3_low"))


_DIFF = f"d AS ({_PAIRED}), c AS (SELECT model_a, model_b, label, avg(d) AS diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1, 2, 3)"


@register("pair_table", f"WITH {pools_sql()}, {boot_sql()}, {RUNS}, {_DIFF} SELECT label, max(CASE WHEN model_b = 'first' THEN round(diff, 6) END) AS first_diff, max(CASE WHEN model_b = 'first' THEN CASE WHEN lo > 0 THEN 'A' WHEN hi < 0 THEN 'B' ELSE 'ns' END END) AS first_sig, max(CASE WHEN model_b = 'second' THEN round(hi, 6) END) AS second_high FROM c WHERE model_a = 'full' GROUP BY 1")
def pair_table(spark, sf_dir):
    scored = unstable(pools(spark, sf_dir).withColumn("grp", F.col("id") % 125))
    run = unstable(bootstrap.fast_runs(scored, patients(spark, sf_dir), "grp", ["model"], 20, 11))
    wide = evaluation.pair_table(bootstrap.all_pairs(run, "model", ["label"], MODELS, "ap"), ["full vs first", "full vs second"])
    number = lambda c: F.col(f"`{c}`").cast("double")
    return wide.select("label", number("full vs first_diff").alias("first_diff"), F.col("`full vs first_sig`").alias("first_sig"), number("full vs second_high").alias("second_high"))


_MACRO = f"WITH {_RESULTS}, w AS (SELECT a.model AS model_a, b.model AS model_b, metric, b, a.value - b.value AS d FROM rs a JOIN rs b USING (metric, b) WHERE a.label IS NULL AND b.label IS NULL AND list_position(['full', 'first', 'second', 'sign'], a.model) < list_position(['full', 'first', 'second', 'sign'], b.model)), c AS (SELECT model_a || ' vs ' || model_b AS pair, metric, avg(d) AS diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM w GROUP BY 1, 2) SELECT pair, max(CASE WHEN metric = 'macro_f1' THEN round(diff, 6) END) AS f1_diff, max(CASE WHEN metric = 'macro_pr_auc' THEN round(lo, 6) END) AS pr_low, max(CASE WHEN metric = 'hamming_accuracy' THEN round(hi, 6) END) AS hamming_high FROM c GROUP BY 1"


@register("macro_pairs", _MACRO)
def macro_pairs(spark, sf_dir):
    scored = unstable(pools(spark, sf_dir).withColumn("grp", F.col("id") % 125))
    cfg = evaluation.EvalConfig(n_boot=20, seed=11)
    wide = evaluation.macro_pair_table(evaluation.compare_scalars(scored, cfg, MODELS), SCALARS)
    number = lambda c, name: F.col(c).cast("double").alias(name)
    return wide.select("pair", number("macro_f1_diff", "f1_diff"), number("macro_pr_auc_low", "pr_low"), number("hamming_accuracy_high", "hamming_high"))


_UNITS = f"WITH {pools_sql()}, {boot_sql()}, {RUNS} SELECT model, CAST(b AS BIGINT) AS b, NULL AS finding_type, round(avg(skill), 6) AS value FROM runs GROUP BY 1, 2 UNION ALL SELECT model, CAST(b AS BIGINT), {_TYPE}, round(avg(skill), 6) FROM runs GROUP BY 1, 2, 3"


@register("unit_files", _UNITS)
def unit_files(spark, sf_dir):
    """Bootstrap units, of all labels and by type, through files by model."""
    path = folder(spark, "units")
    scored = pools(spark, sf_dir).withColumn("grp", F.col("id") % 125)
    run = unstable(bootstrap.fast_runs(scored, patients(spark, sf_dir), "grp", ["model"], 20, 11))
    types = labels(spark, sf_dir).select("label").distinct().withColumn("finding_type", _type())
    writers.write_units(bootstrap.units_table(run, ["model"], types), path, ["model"])
    return spark.read.schema("b long, finding_type string, value double, model string").parquet(path).select("model", "b", "finding_type", r6("value"))


# ---- reports


@register("latex_lines", f"WITH {pools_sql()}, {FACT} SELECT label, label || ' & ' || coalesce(printf('%.3f', max(CASE WHEN model = 'full' THEN round(roc_auc, 6) END)), '--') || ' & -- \\\\' AS line FROM fact GROUP BY 1")
def latex_lines(spark, sf_dir):
    fact = _fact(spark, sf_dir).select("model", "label", r6("roc_auc"))
    return report.latex_rows(report.wide(fact, "label", "model", ["full", "none"], ["roc_auc"]), "label", ["full_roc_auc", "none_roc_auc"])


@register("fixed_width_lines", "SELECT rpad(r_name, 12, ' ') || ' ' || lpad(printf('%.2f', CAST(r_regionkey AS DOUBLE) / 4), 8, ' ') AS line FROM region")
def fixed_width_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_name", (F.col("r_regionkey").cast("double") / 4).alias("x"))
    return report.fixed_width(rows, {"r_name": 12, "x": 8}, 2)


@register("text_report", "SELECT 'Regions' || chr(10) || '=======' || chr(10) || string_agg(r_name, chr(10) ORDER BY r_name) || chr(10) AS report FROM region")
def text_report(spark, sf_dir):
    path, lines = folder(spark, "lines"), table(spark, sf_dir, "region").select(F.col("r_name").alias("line")).orderBy("line")
    writers.write_lines(lines, path)
    again = spark.read.text(path).select(F.col("value").alias("line")).orderBy("line")
    return spark.createDataFrame([(writers.text_report("Regions", again),)], "report string")


@register("mean_concordance", f"WITH {pools_sql()}, {FACT}, {_RANKS}, p AS (SELECT corr(a.r, b.r) AS rho FROM ranks a JOIN ranks b ON a.label = b.label AND a.model < b.model GROUP BY a.model, b.model) SELECT round(avg(rho), 6) AS mean_rho, count(*) AS n_pairs FROM p")
def mean_concordance(spark, sf_dir):
    return stats.mean_pairwise(_ratings(spark, sf_dir), "model", "label", "v").select(r6("mean_rho"), "n_pairs")


@register("readout_differences", "SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS even, sum(CASE WHEN event_id % 2 = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS odd, (sum(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0 END) - sum(CASE WHEN event_id % 2 = 1 THEN 1.0 ELSE 0 END))::DOUBLE AS difference FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 2) = 2")
def readout_differences(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("kind")).agg(F.count("*").cast("double").alias("n"))
    return report.differences(n, ["user_id"], "kind", "even", "odd", "n").where("difference is not null")


@register("missing_labels", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3) ORDER BY 1")
def missing_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return report.missing(part.select("p_brand").distinct(), part.where("p_size < 3").select("p_brand"), ["p_brand"]).orderBy("p_brand")


@register("reindexed_bands", "WITH p AS (SELECT o_orderpriority AS label, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT unnest(['1-URGENT', '2-HIGH', 'none']) AS label) SELECT n.label, round(v, 4) AS v FROM n LEFT JOIN p USING (label)")
def reindexed_bands(spark, sf_dir):
    means = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("label")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return report.reindex(means, spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("none",)], "label string"), "label")


@register("features_of_bands", "WITH p AS (SELECT p_type AS label, avg(p_size) AS prevalence FROM part GROUP BY 1) SELECT label, round(prevalence, 6) AS prevalence, 'n' || len(label) AS organ_system, lower(label) AS finding_type FROM p WHERE label NOT IN ('PROMO', 'LARGE')")
def features_of_bands(spark, sf_dir):
    """Features join by cohort and label; a null or an empty type is none."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("label")).agg(F.avg("p_size").alias("prevalence")).withColumn("cohort", F.lit("c"))
    kind = F.when(F.col("label") == "LARGE", "").when(F.col("label") != "PROMO", F.lower("label"))
    dim = p.select("cohort", "label", F.concat(F.lit("n"), F.length("label").cast("string")).alias("organ_system"), kind.alias("finding_type"))
    return report.typed(report.with_features(p, dim, "inner")).select("label", r6("prevalence"), "organ_system", "finding_type")


@register("first_of_each", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def first_of_each(spark, sf_dir):
    return report.first_per_group(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), "event_id"]).select("event_type", "event_id")


# ---- splits, probes that have nothing to learn from, blocks of readouts


@register("loo_folds", "SELECT vec_id AS id, 0 AS repeat, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS fold FROM embeddings")
def loo_folds(spark, sf_dir):
    return folds.leave_one_out(scans(spark, sf_dir).select("id"))


_ALONE = "l AS (SELECT id, 'none' AS label, 0 AS y FROM folds UNION ALL SELECT id, 'single', CAST(id = (SELECT min(vec_id) FROM embeddings) AS INTEGER) FROM folds UNION ALL SELECT id, 'all', 1 FROM folds)"


@register("probe_fallback", f"WITH {FOLDS}, {_ALONE}, t AS (SELECT label, f, sum(CASE WHEN fold <> f THEN y ELSE 0 END) * 1.0 / sum(CASE WHEN fold <> f THEN 1 ELSE 0 END) AS score FROM l JOIN folds USING (id), (SELECT DISTINCT fold AS f FROM folds) GROUP BY 1, 2) SELECT l.id, l.label, l.y, round(t.score, 6) AS score FROM l JOIN folds USING (id) JOIN t ON t.label = l.label AND t.f = folds.fold")
def probe_fallback(spark, sf_dir):
    """Labels with fewer than two positives, or no negatives, in training: the score is the share of positives there."""
    own = scans(spark, sf_dir)
    first = own.agg(F.min("id").alias("__m"))
    alone = own.select("id").crossJoin(first).select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), y.cast("int").alias("y")) for n, y in (("none", F.lit(0)), ("single", F.col("id") == F.col("__m")), ("all", F.lit(1)))])).alias("x")).select("id", "x.label", "x.y")
    return probe.probe_scores(own, alone, fold_table(spark, sf_dir), least_pos=2).select("id", "label", "y", r6("score"))


@register("readout_blocks", "SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' AND e = {e} THEN n END) AS {t}_{e}_n" for t in ("click", "view", "absent") for e in (0, 1)) + " FROM (SELECT user_id, event_type, event_id % 2 AS e, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1")
def readout_blocks(spark, sf_dir):
    """Blocks of columns side by side, one for each readout and model; what a block lacks is null."""
    name = F.concat_ws("_", "event_type", (F.col("event_id") % 2).cast("string"))
    n = table(spark, sf_dir, "events").groupBy("user_id", name.alias("block")).agg(F.count("*").alias("n"))
    return report.wide(n, "user_id", "block", [f"{t}_{e}" for t in ("click", "view", "absent") for e in (0, 1)], ["n"])


@register("numbered_groups", "SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT event_type FROM events)")
def numbered_groups(spark, sf_dir):
    return folds.numbered(table(spark, sf_dir, "events").select("event_type").distinct(), "event_type")
