"""The opN_<name> queries: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, idfile, images, langid, licences, minhash, mixing, suffix, vptree, wordpiece
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, pattern()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.known(spark)).select("doc_id", "text_digest", "licence_id")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH known(licence_id, text) AS (VALUES {", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licences.titled())}),
digests(licence_id, text_digest) AS (VALUES {", ".join(f"({quoted(i)}, {quoted(d)})" for i, d in licences.DIGESTS)}),
by_digest AS (
  SELECT text_digest, min(licence_id) AS licence_id FROM (
    SELECT licence_id, sha256({licences.canonical_sql("text")}) AS text_digest FROM known WHERE {licences.canonical_sql("text")} <> '' UNION ALL SELECT licence_id, text_digest FROM digests
  ) GROUP BY 1
),
scanned AS (SELECT doc_id, sha256({licences.canonical_sql("text")}) AS text_digest FROM documents)
SELECT doc_id, text_digest, licence_id FROM scanned LEFT JOIN by_digest USING (text_digest)
"""


#: Target weights of op2 and the pipeline: whole numbers, shared out at each level.
MIX = {"domain": {"web": 50, "books": 30, "forum": 20}, "language": {"en": 60, "de": 15, "fr": 15, "es": 10}}
SHARE, EPOCHS, SEED = 0.8, 4, 1


def domain_of_source():
    """The documents have no domain; sources are numbered, and numbers stand for domains: 0-9 web, 10-14 books, 15 on forum."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as int)")
    return F.when(n < 10, "web").when(n < 15, "books").when(n >= 15, "forum")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix_sources(docs, domain_of_source(), F.col("lang"), F.col("source"), MIX, share=SHARE, max_epochs=EPOCHS, seed=SEED)
    return mixed.select("doc_id", "domain", "language", "origin", "tokens", "epoch", "taken")


def _weights(name: str, level: str) -> str:
    return "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX.get(level, {}).items()) + " ELSE 1 END" if level in MIX else "1"


def _share_out(name: str, parent: str, rows: str) -> str:
    """Budgets of the children in rows (name, parent columns, weight, capacity, given), by the same whole-number rules."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""(SELECT *, CAST(CASE WHEN filled THEN capacity WHEN opened > 0 THEN (rest * upto) // total - (rest * (upto - opened)) // total ELSE 0 END AS BIGINT) AS budget FROM (
      SELECT *, sum(opened) OVER ({part}) AS total, sum(opened) OVER ({part} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) AS upto FROM (
        SELECT *, CASE WHEN filled THEN 0 ELSE weight END AS opened, given - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({part}) AS rest FROM (
          SELECT *, weight > 0 AND capacity * after_w <= (given - before_c) * weight AS filled FROM (
            SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_c,
                   sum(weight) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_w
            FROM (SELECT *, capacity / weight AS ratio FROM {rows}))))))"""


OP2_SQL = f"""
WITH docs AS (
  SELECT doc_id, text, CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'books' WHEN n >= 15 THEN 'forum' ELSE 'unknown' END AS domain,
         coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n FROM documents)),
kept AS (SELECT * FROM docs WHERE tokens > 0),
leaves AS (SELECT domain, language, origin, sum(tokens) AS tokens, sum(tokens) * {EPOCHS} AS capacity, {_weights("origin", "origin")} AS weight FROM kept GROUP BY 1, 2, 3),
tops AS (SELECT domain, sum(capacity) AS capacity, {_weights("domain", "domain")} AS weight,
         least(CAST(floor((SELECT sum(tokens) FROM leaves) * CAST({SHARE} AS DOUBLE)) AS BIGINT), (SELECT sum(capacity) FROM leaves)) AS given FROM leaves GROUP BY 1),
top AS (SELECT * FROM {_share_out("domain", "", "tops")}),
mids AS (SELECT l.domain, l.language, sum(l.capacity) AS capacity, {_weights("l.language", "language")} AS weight, any_value(t.budget) AS given FROM leaves l JOIN top t USING (domain) GROUP BY 1, 2),
mid AS (SELECT * FROM {_share_out("language", "domain", "mids")}),
ends AS (SELECT l.*, m.budget AS given FROM leaves l JOIN mid m USING (domain, language)),
plan AS (SELECT domain, language, origin, budget // tokens AS whole, budget % tokens AS rest FROM {_share_out("origin", "domain, language", "ends")} WHERE budget > 0),
placed AS (SELECT k.*, p.whole, p.rest, md5('{SEED}:' || CAST(p.whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM kept k JOIN plan p USING (domain, language, origin)),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY place, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM placed),
each AS (SELECT *, unnest(range(CAST(whole AS BIGINT) + 1)) AS epoch FROM run)
SELECT doc_id, domain, language, origin, tokens, CAST(epoch AS INTEGER) AS epoch,
       CAST(CASE WHEN epoch < whole THEN tokens ELSE greatest(0, least(tokens, rest - so_far)) END AS BIGINT) AS taken
FROM each WHERE (CASE WHEN epoch < whole THEN tokens ELSE greatest(0, least(tokens, rest - so_far)) END) > 0
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def source_address():
    """Documents have no address: their source as a host of its kind, `src3.documents.web`, stands for one."""
    return F.concat(F.col("source"), F.lit(".documents."), domain_of_source())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: their catalogue's language is the declaration, their source and its kind the address."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    models = langid.models_for(docs, "doc_id", "text", "lang")
    found = langid.identify(docs, "doc_id", "text", models, F.col("lang"), source_address())
    return found.select("doc_id", "language", "text_language", F.round("confidence", 6).alias("confidence"), F.col("accepted").alias("kept"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup's declaration, the address's host and suffix, and the text between the tags; models fitted on documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("body", body)
    declared = F.nullif(F.regexp_extract("html", r"<html[^>]*\blang=[\"']?([A-Za-z]{2})", 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    found = langid.identify(pages, "page_id", "body", langid.models_for(docs, "doc_id", "text", "lang"), declared, host)
    return found.select("page_id", "language", "text_language", F.round("confidence", 6).alias("confidence"), F.col("accepted").alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=3, share=(85, 100))


def op7_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20, factor=1.0)


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each document is one: its bytes as grey pixels, in rows of 64."""
    docs = table(spark, sf_dir, "documents").select("doc_id", images.text_as_image(F.col("text")).alias("image"))
    return images.find_copies(docs, "doc_id", "image")


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return idfile.round_trip(docs, vocabulary("byte_bpe_50k.json"))


QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_vantage_point_search": op7_vantage_point_search,
    "op8_image_copies": op8_image_copies,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_token_id_files": op10_token_id_files,
    "page_languages": page_languages,
}
ORACLE: dict = {"op1_licence_scan": OP1_SQL, "op2_mix_sources": OP2_SQL}
