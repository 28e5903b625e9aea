"""Language identification by Bayesian fusion of evidence.

The evidence: the text's likelihood under byte-trigram models of the languages; a declared language (of markup or of a
catalogue); the suffix of the address; and a prior for the host, smoothed towards its domain and that towards the whole
corpus. Every label that occurs has a model (256 KB), fitted on a bounded sample of labelled rows (SAMPLE a language, by a
hash of the id). Counts for
suffixes, domains and hosts cover all rows: each row counts for the language its text alone suggests, grouped and summed
by Spark, and a row's own vote is taken out of its host's, domain's and suffix's counts (the corpus's include it). Texts are read
whole.

A row is accepted if its text has letters, its posterior is MIN_CONFIDENCE or more, and the language is wanted.

Defined results: a null or empty text, or one without letters, has the language 'und', confidence 0, and is rejected.
Null or unknown declarations, hosts and suffixes are no evidence. Ties go to the language that comes first by name.
Repeated rows get the same result each. An empty table, or one with no labelled rows, gives every row 'und'. Computed
columns replace input columns of the same name; other columns are passed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, raw, string_columns, trim

#: Labelled rows a language that the models are fitted on, at most.
SAMPLE = 300
BITS = 16
#: Overlapping trigrams say the same thing several times over: their log-likelihood counts for so much.
TEMPER = 0.25
#: How often a declared language is right; how many rows a parent's distribution counts for.
DECLARED, STRENGTH = 0.9, 20.0
MIN_CONFIDENCE = 0.5
SLAB = 1 << 18

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte trigram at each position (but the last two), and where it counts: letters, no two blanks."""
    b = _FOLD[data]
    upper = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
    b[1:][upper] += 32
    c = b.astype(np.uint32)
    code = ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    counts = ((b[:-2] == 32).view(np.int8) + (b[1:-1] == 32) + (b[2:] == 32)) < 2
    return code, counts


def fit(rows: list[tuple[str, str]], languages: list[str]) -> np.ndarray:
    """Log-probabilities of trigrams, a row for each language."""
    table = np.full((len(languages), 1 << BITS), 0.1)
    for language, text in rows:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(data) > 2:
            code, counts = trigrams(data)
            table[languages.index(language)] += np.bincount(code[counts], minlength=1 << BITS)
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihoods of each text, a column for each language, and the trigrams they rest on."""
    n = len(offsets) - 1
    out, used = np.zeros((n, len(table))), np.zeros(n, np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, "right")) - 1)
        lo = offsets[at]
        part, edges = data[lo : offsets[to]], offsets[at : to + 1] - lo
        if len(part) > 2:
            code, counts = trigrams(part)
            for e in (edges[1:-1] - 1, edges[1:-1] - 2):  # not across texts
                counts[e[(e >= 0) & (e < len(counts))]] = False
            where = np.flatnonzero(counts)
            cut = np.searchsorted(where, edges)
            code = code[where]
            for k in range(len(table)):
                total = np.concatenate([[0.0], np.cumsum(table[k][code], dtype=np.float64)])
                out[at:to, k] = (total[cut[1:]] - total[cut[:-1]]) * TEMPER
            used[at:to] = np.diff(cut)
        at = to
    return out, used


def sample(df: DataFrame, key: str, text: str, label: str, per_language: int) -> list[tuple[str, str]]:
    """Labelled texts to fit on: of each language the per_language rows with the least hashes of their ids."""
    known = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    count = known.groupBy("l").count().orderBy("l").collect()
    if not count:
        return []
    bounds = F.when(F.lit(False), F.lit(0))
    for r in count:  # a threshold on the hash leaves about twice the rows that are wanted, however many there are
        share = min(1.0, 2.0 * per_language / r["count"])
        bounds = bounds.when(F.col("l") == r["l"], F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * float(1 << 64)))))
    few = known.where(F.col("h") <= bounds).groupBy("l").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "t"))), 1, per_language).alias("s"))
    return [(r["l"], r["t"]) for r in few.select("l", F.explode("s.t").alias("t")).collect()]


def suffix_of(host: Column) -> Column:
    """The last label of a host name that has several."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name that has more."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.substring_index(host, ".", -2))


def identify(df: DataFrame, key: str, text: str, models: tuple[list[str], np.ndarray], declared: Column | None = None, host: Column | None = None, wanted: list[str] | None = None) -> DataFrame:
    """df with language, confidence, text_language and accepted."""
    string_columns(df, key, text)
    bounded_batches(df)
    languages, table = models
    computed = ("language", "confidence", "text_language", "accepted")
    passed = [c for c in df.columns if c not in computed]
    if not languages:
        return df.select(*passed, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_language"), F.lit(False).alias("accepted"))
    none = F.lit(None).cast("string")
    seen = df.select(*passed, F.lower(declared.cast("string") if declared is not None else none).alias("__declared"), F.lower(host.cast("string") if host is not None else none).alias("__host"))
    scores = [f"__t{k}" for k in range(len(languages))]
    schema = T.StructType(list(seen.schema) + [T.StructField(s, T.DoubleType()) for s in scores] + [T.StructField("__used", T.LongType())])

    def run(batches):
        for batch in batches:
            found, used = likelihoods(*raw(batch.column(text)), table)
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(found[:, k]) for k in range(len(languages))] + [pa.array(used)], schema.names)
        trim()

    rows = seen.mapInArrow(run, schema)
    best = F.greatest(*[F.col(s) for s in scores]) if len(scores) > 1 else F.col(scores[0])
    vote = F.array_position(F.array(*scores), best) - 1  # the first of equals
    rows = rows.withColumn("__vote", F.when(F.col("__used") > 0, vote).otherwise(F.lit(-1)).cast("int"))
    rows = rows.withColumn("__suffix", suffix_of(F.col("__host"))).withColumn("__domain", domain_of(F.col("__host")))
    own = [F.when(F.col("__vote") == k, 1.0).otherwise(0.0) for k in range(len(languages))]

    # counts of votes: one row for each host, with its domain and suffix; all sums come from these
    votes = [F.sum(F.when(F.col("__vote") == k, 1.0).otherwise(0.0)).alias(f"__n{k}") for k in range(len(languages))]
    light = seen.mapInArrow(run, schema).withColumn("__vote", F.when(F.col("__used") > 0, vote).otherwise(F.lit(-1)).cast("int"))
    hosts = materialize(light.groupBy("__host").agg(*votes), "hosts")
    hosts = hosts.withColumn("__suffix", suffix_of(F.col("__host"))).withColumn("__domain", domain_of(F.col("__host")))
    sums = lambda by, name: hosts.groupBy(by).agg(*[F.sum(f"__n{k}").alias(f"{name}{k}") for k in range(len(languages))])
    everyone = hosts.agg(*[F.sum(f"__n{k}") for k in range(len(languages))]).first()
    total = [float(x or 0.0) for x in everyone]
    world = [(x + 1.0) / (sum(total) + len(languages)) for x in total]
    facts = hosts.where("__host is not null").select(F.col("__host").alias("__h"), "__suffix", "__domain", *[F.col(f"__n{k}").alias(f"__h{k}") for k in range(len(languages))])
    facts = facts.join(sums("__suffix", "__s").where("__suffix is not null"), "__suffix", "left").join(sums("__domain", "__d").where("__domain is not null"), "__domain", "left")
    every = lambda name: F.aggregate(F.array(*[F.coalesce(f"{name}{k}", F.lit(0.0)) for k in range(len(languages))]), F.lit(0.0), lambda x, y: x + y)
    facts = materialize(facts.drop("__suffix", "__domain").select("*", *[every(name).alias(f"{name}_all") for name in ("__h", "__d", "__s")]), "priors")
    rows = rows.drop("__suffix", "__domain").join(facts, F.col("__host") == F.col("__h"), "left")

    def count(name: str, k: int) -> Column:  # without the row's own vote
        return F.coalesce(F.greatest(F.col(f"{name}{k}") - own[k], F.lit(0.0)), F.lit(0.0))

    def added(name: str) -> Column:
        mine = F.when(F.col("__vote") >= 0, F.element_at(F.array(*[f"{name}{k}" for k in range(len(languages))]), F.col("__vote") + 1))
        return F.coalesce(f"{name}_all", F.lit(0.0)) - F.least(F.coalesce(mine, F.lit(0.0)), F.lit(1.0))

    size = len(languages)
    rows = rows.select("*", *[added(name).alias(f"{name}_added") for name in ("__h", "__d", "__s")])
    of_hosts, of_domain, of_suffix_all = F.col("__h_added"), F.col("__d_added"), F.col("__s_added")
    logs = []
    for k, language in enumerate(languages):
        domain = (count("__d", k) + F.lit(STRENGTH * world[k])) / (of_domain + F.lit(STRENGTH))
        prior = (count("__h", k) + F.lit(STRENGTH) * domain) / (of_hosts + F.lit(STRENGTH))
        of_suffix = F.when(of_suffix_all > 0, F.log((count("__s", k) + F.lit(STRENGTH * world[k])) / (of_suffix_all + F.lit(STRENGTH)) / F.lit(world[k]))).otherwise(F.lit(0.0))
        said = F.when(F.col("__declared") == language, F.lit(math.log(DECLARED))).when(F.col("__declared").isin(languages), F.lit(math.log((1 - DECLARED) / max(1, size - 1)))).otherwise(F.lit(0.0))
        logs.append((F.col(scores[k]) + F.log(prior) + of_suffix * F.lit(TEMPER) + said).alias(f"__p{k}"))
    rows = rows.select("*", *logs)
    posterior = [F.col(f"__p{k}") for k in range(size)]
    top = F.greatest(*posterior) if size > 1 else posterior[0]
    mass = F.aggregate(F.array(*reversed(posterior)), F.lit(0.0), lambda x, p: x + F.exp(p - top))
    names = F.array(*[F.lit(x) for x in languages])
    chosen = F.element_at(names, F.array_position(F.array(*posterior), top).cast("int"))
    from_text = F.when(F.col("__vote") >= 0, F.element_at(names, F.col("__vote") + 1)).otherwise(F.lit("und"))
    has = F.col("__used") > 0
    confidence = F.when(has, 1.0 / mass).otherwise(F.lit(0.0))
    rows = rows.withColumn("__confidence", confidence).withColumn("__language", F.when(has, chosen).otherwise(F.lit("und")))
    accepted = (F.col("__confidence") >= MIN_CONFIDENCE) & F.col("__language").isin(languages if wanted is None else wanted)
    return rows.select(*passed, F.col("__language").alias("language"), F.col("__confidence").alias("confidence"), from_text.alias("text_language"), accepted.alias("accepted"))


def models_for(df: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, by name, and their trigram tables, fitted on a bounded sample."""
    rows = sample(df, key, text, label, per_language)
    languages = sorted({l for l, _ in rows})
    return languages, fit(rows, languages)
