"""Readers of study files, as long tables keyed by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_number, nested_path


def need(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")
    return df


def limited(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows by key; 0 stands for all."""
    return df.orderBy(key).limit(n) if n else df


def accepted(labels: DataFrame, needs: dict[str, DataFrame] | None = None, max_samples: int = 0, observation: Observation | None = None) -> DataFrame:
    """The labels of the ids that each of needs (name: a table with id) has; of these the first max_samples, 0 for all.

    The limit counts accepted ids, so it comes last. observation, if given, counts `missing_<name>` of the ids that are
    left out, each for the first need that it misses, and `found`.
    """
    ids, ok, counts = labels.select("id").distinct(), F.lit(True), {}
    for name, table in (needs or {}).items():
        there = F.col(f"__{name}").isNotNull()
        ids = ids.join(table.select("id").distinct().withColumn(f"__{name}", F.lit(1)), "id", "left")
        counts[f"missing_{name}"], ok = ok & ~there, ok & there
    if observation is not None:
        ids = counted(ids, observation, found=ok, **counts)
    return labels.join(limited(ids.where(ok).select("id"), max_samples), "id", "left_semi")


def long_labels(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(id, label, y) of one column for each label; a missing value is 0."""
    wide = df.select(F.col(key).cast("string").alias("id"), *[F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)).alias(c) for c in labels])
    return wide.unpivot("id", labels, "label", "y")


def read_label_json(spark: SparkSession, path: str, key: str = "NoteAcc_DEID", labels: list[str] | None = None, max_samples: int = 0, needs: dict[str, DataFrame] | None = None, observation: Observation | None = None, lines: bool = False) -> DataFrame:
    """(id, label, y) of a JSON list of records: labels are the boolean fields, or those asked for.

    needs, max_samples and observation as in `accepted`. A list is one value, so one task reads a file; for long ones,
    `lines` reads one record from each line, in many tasks.
    """
    df = need(spark.read.option("multiLine", not lines).json(path), key)
    found = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    chosen = found if labels is None else labels
    need(df, *chosen)
    if not chosen:
        raise ValueError("no label columns")
    return accepted(long_labels(df, key, chosen), needs, max_samples, observation)


def read_label_csv(spark: SparkSession, path: str, key: str = "VolumeName", labels: list[str] | None = None, max_samples: int = 0, needs: dict[str, DataFrame] | None = None, observation: Observation | None = None) -> DataFrame:
    """(id, label, y) of a table with one column for each label; needs, max_samples and observation as in `accepted`."""
    df = need(spark.read.csv(path, header=True), key)
    chosen = [c for c in df.columns if c != key] if labels is None else labels
    need(df, *chosen)
    return accepted(long_labels(df, key, chosen), needs, max_samples, observation)


def read_spacing(spark: SparkSession, path: str, key: str = "NoteAcc_DEID", column: str = "final_spacing") -> DataFrame:
    """(id, spacing): rows whose spacing is a number; of a repeated id the last row of the file."""
    raw = need(spark.read.csv(path, header=True), key, column).withColumn("__at", F.monotonically_increasing_id())
    rows = raw.select(F.col(key).alias("id"), F.col(column).try_cast("double").alias("spacing"), "__at").where("id is not null and spacing is not null and not isnan(spacing)")
    return rows.groupBy("id").agg(F.max_by("spacing", "__at").alias("spacing"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, slope, intercept, xy, z); a spacing may be written `[x, y]`. Rows with a missing number are left out."""
    df = need(spark.read.csv(path, header=True, escape='"'), "VolumeName", "RescaleSlope", "RescaleIntercept", "XYSpacing", "ZSpacing")
    number = lambda c: F.col(c).try_cast("double")
    rows = df.select(F.col("VolumeName").alias("id"), number("RescaleSlope").alias("slope"), number("RescaleIntercept").alias("intercept"), first_number(F.col("XYSpacing")).alias("xy"), number("ZSpacing").alias("z"))
    return rows.na.drop()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(id, findings, impressions); missing texts stay null."""
    df = need(spark.read.csv(path, header=True, multiLine=True, escape='"'), "VolumeName", "Findings_EN", "Impressions_EN")
    return df.select(F.col("VolumeName").alias("id"), F.col("Findings_EN").alias("findings"), F.col("Impressions_EN").alias("impressions"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(category, label) of a JSON object of lists."""
    df = spark.read.option("multiLine", True).json(path)
    kinds = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    return df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"`{k}`").alias("labels")) for k in kinds])).alias("x")).select("x.category", F.explode("x.labels").alias("label"))


def in_category(labels: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    return labels.join(categories.where(F.col("category") == category).select("label"), "label", "left_semi")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content", "length")


def is_zip(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.unhex(F.lit("504B0304"))


def volume_paths(labels: DataFrame, root: str) -> DataFrame:
    """(id, path) of the ids' volumes; ids without a path are left out."""
    return labels.select("id").distinct().withColumn("path", nested_path(F.col("id"), root)).where(F.col("path").isNotNull())


def is_nifti(content: Column) -> Column:
    """Gzipped, or with the header size of NIfTI-1 in either order."""
    return (F.substring(content, 1, 2) == F.unhex(F.lit("1F8B"))) | F.substring(content, 1, 4).isin(F.unhex(F.lit("5C010000")), F.unhex(F.lit("0000015C")))


def named(files: DataFrame) -> DataFrame:
    """files with the id that their name is."""
    return files.withColumn("id", F.regexp_replace(F.substring_index("path", "/", -1), r"\.(npz|nii\.gz|nii)$", ""))


def sound(files: DataFrame) -> DataFrame:
    """The files that begin as zipped numpy or NIfTI volumes do; others, such as HTML error pages, go."""
    return files.where(is_zip(F.col("content")) | is_nifti(F.col("content")))


def volumes(files: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, content, …) of the sound files that have both labels and facts (id, spacing; or id, slope, intercept, xy, z);
    a file's name is the id, with or without the ending."""
    bare = lambda c: F.regexp_replace(c, r"\.(npz|nii\.gz|nii)$", "")
    own = sound(named(files)).select("id", "content")
    wanted = labels.select(bare(F.col("id")).alias("id")).distinct()
    return own.join(wanted, "id", "left_semi").join(facts.withColumn("id", bare(F.col("id"))), "id")


def counted(df: DataFrame, observation, **counters: Column) -> DataFrame:
    """df, while an Observation collects counts of rows, such as skipped ones, on the way."""
    return df.observe(observation, *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counters.items()])


def samples(labels: DataFrame, metadata: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Labels with the metadata they need (rows without are left out), and reports where there are any."""
    out = labels.join(metadata, "id")
    return out if reports is None else out.join(reports, "id", "left")


def scans(df: DataFrame, id_: str, vector: str) -> DataFrame:
    return df.select(F.col(id_).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))


def labels_subset(labels: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of the wanted labels; a label that nothing has is an error."""
    there = {r[0] for r in labels.where(F.col("label").isin(wanted)).select("label").distinct().collect()}
    if set(wanted) - there:
        raise KeyError(f"missing labels {sorted(set(wanted) - there)}")
    return labels.where(F.col("label").isin(wanted))


def read_embeddings(spark: SparkSession, path: str, override: dict[str, str] | None = None) -> DataFrame:
    """An embedding cache; override reads one model's rows in place of another's."""
    df = need(spark.read.parquet(path), "id", "model", "embedding")
    if not override:
        return df
    for name, stands in override.items():
        df = df.where(F.col("model") != name).withColumn("model", F.when(F.col("model") == stands, name).otherwise(F.col("model")))
    return df


POOL = ["cohort", "model", "readout", "id", "label", "y", "score"]


def read_pools(spark: SparkSession, path: str, readout: str | None = None) -> DataFrame:
    """Pools of scores, keyed by id, so that no order counts; of one readout, such as 'zs' for zero-shot scores."""
    df = need(spark.read.parquet(path), *POOL)
    return df if readout is None else df.where(F.col("readout") == readout)


def read_predictions(spark: SparkSession, path: str, cohort: str, model: str, readout: str = "zs") -> DataFrame:
    """One model's prediction file (id, label, y, score) as a pool."""
    df = need(spark.read.parquet(path), "id", "label", "y", "score")
    cell = {"cohort": cohort, "model": model, "readout": readout}
    return df.select(*[F.lit(v).alias(c) for c, v in cell.items()], F.col("id").cast("string").alias("id"), "label", F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score"))


def existing(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """The inputs that are there, and the names of the others, with a warning for each."""
    import warnings

    there, gone = {}, []
    for name, path in paths.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            there[name] = path
        else:
            gone.append(name)
            warnings.warn(f"{name} is left out: there is no {path}", stacklevel=2)
    return there, gone


def same_ids(pools: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, n_ids, complete): whether each pool covers the ids that any pool has."""
    everyone = pools.agg(F.count_distinct("id").alias("__n"))
    return pools.groupBy(*keys).agg(F.count_distinct("id").alias("n_ids")).crossJoin(everyone).select(*keys, "n_ids", (F.col("n_ids") == F.col("__n")).alias("complete"))


def same_targets(pools: DataFrame, model: str = "model") -> DataFrame:
    """(model_a, model_b, n_shared, n_only, n_differ) of all pairs of models: rows (id, label) that both have, that one
    alone has, and that both have with other targets. A pair compares as it should where the last two are 0."""
    rows = pools.groupBy(F.col(model).alias("m"), "id", "label").agg(F.max("y").alias("y"))
    sizes = rows.groupBy("m").agg(F.count("*").alias("n"))
    a, b = (sizes.select(F.col("m").alias(f"model_{x}"), F.col("n").alias(f"__{x}")) for x in "ab")
    pairs = a.join(b, F.col("model_a") < F.col("model_b"))  # of models, which are few
    mine, other = rows.select(F.col("m").alias("model_a"), "id", "label", "y"), rows.select(F.col("m").alias("model_b"), "id", "label", F.col("y").alias("__y"))
    met = mine.join(other, ["id", "label"]).where("model_a < model_b").groupBy("model_a", "model_b")
    met = met.agg(F.count("*").alias("n_shared"), F.sum(F.when(F.col("y") != F.col("__y"), 1).otherwise(0)).alias("n_differ"))
    out = pairs.join(met, ["model_a", "model_b"], "left").na.fill(0, ["n_shared", "n_differ"])
    return out.select("model_a", "model_b", "n_shared", (F.col("__a") + F.col("__b") - 2 * F.col("n_shared")).alias("n_only"), "n_differ")


#: Schemas of result tables, so that no reader infers.
PER_CLASS = "dataset string, suffix string, model string, readout string, label string, n_samples long, n_pos long, prevalence double, pr_auc double, roc_auc double"
CONCEPTS = "cohort string, label string, finding_clean string, organ_system string, finding_type string, prevalence double"


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
