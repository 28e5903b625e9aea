"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import importlib
import sys

import duckdb
import pytest

from vectriage.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


NAMES = [n for n in catalog.QUERIES if n in catalog.ORACLE]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    rel = con.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()


def test_reports_are_whole(spark, sf_dir):
    texts = {r.conv_id: r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0").collect()}
    found = {r.doc_id: r.report for r in catalog.QUERIES["labels_with_whole_reports"](spark, sf_dir).collect()}
    assert any(len(t or "") > 20 for t in found.values()) and all(t == texts.get(k) for k, t in found.items())


def test_evaluation_has_all_models_and_a_thousand_resamples(spark, sf_dir, monkeypatch):
    from vectriage.operators import bootstrap

    asked, whole = [], bootstrap.fast_evaluate
    monkeypatch.setattr(bootstrap, "fast_evaluate", lambda df, units, unit, keys, n_boot=1000, seed=42: asked.append(n_boot) or whole(df, units, unit, keys, 5, seed))
    found = {r.model for r in catalog.QUERIES["evaluate_model"](spark, sf_dir).collect()}
    assert found == set(catalog.MODELS) and asked == [1000]


def test_entry_without_the_training_data_operators(spark, monkeypatch):
    sys.modules.pop("__spark_entry__", None)
    for m in [m for m in sys.modules if m.startswith("vectriage.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "vectriage.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "perclass_fact" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and "pipeline" not in entry.queries()
    assert entry.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__", None)
