"""A training-data pipeline: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as the next
one's docs. All but the last return the columns of documents: doc_id, text, lang, source, n_chars; other columns, whatever
their names, aren't passed on. An empty table gives no rows at any stage. Nulls, empty and long texts, ties and repeated
rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectriage.llm import bpe, langid, minhash, mixing, suffix
from vectriage.llm.common import materialize
from vectriage.llm.queries import EPOCHS, MIX, SEED, SHARE, domain_of_source, pattern, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that their evidence supports go; lang becomes the language that was found.

    Null and empty texts, and texts without letters, go. Null or unknown declarations and sources are no evidence. Ties go
    to the language that comes first by name; repeated rows each get the same. Texts count as a whole, however long.
    """
    models = langid.models_for(docs, "doc_id", "text", "lang")
    found = langid.identify(docs, "doc_id", "text", models, F.col("lang"), F.col("source")).where("accepted")
    return found.withColumn("lang", F.col("language")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id: five-word shingles, a similarity of 0.8 or more.

    Texts without words, and rows without a doc_id, stay. Rows that repeat a doc_id stay or go together.
    """
    return minhash.drop_near_duplicates(docs, "doc_id", "text", width=5, share=(4, 5)).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out; every document stays, if without text.

    A null text becomes an empty one. Rows without a doc_id, or with the same one, don't affect each other. A character
    that loses some of its bytes goes.
    """
    left = suffix.remove_repeated(docs, "doc_id", "text", whole_characters=True)
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources at their target weights; a document is there once for each epoch it is taken in.

    Texts without words go. A null language or source is one of its own, `unknown`. In an epoch that isn't whole, documents
    come by a hash of their doc_id, ties by doc_id and text; the last one is cut after a word.
    """
    mixed = mixing.mix_sources(docs, domain_of_source(), F.col("lang"), F.col("source"), MIX, share=SHARE, max_epochs=EPOCHS, seed=SEED)
    text = mixing.cut_text(F.col("text"), F.col("tokens"), F.col("taken"))
    return mixed.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with proof that they decode to its text. A null text has no ids."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, pattern())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("round_trip"),
    )


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Near-duplicates, repeated passages and byte-pair merges have no SQL form; tests/llm/test_pipeline.py holds the rows of run()
#: against each stage written out in plain Python, and the mixing in DuckDB.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
