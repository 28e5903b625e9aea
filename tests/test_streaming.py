"""Score files that arrive one after another."""

from vectriage.streaming import ingest_pools
from vectriage.streaming.incremental import SCHEMA, latest


def test_cells_are_counted_once(spark, tmp_path):
    source, pools, facts, mark = (f"{tmp_path}/{n}" for n in ("in", "pools", "facts", "mark"))
    rows = [("c", "m", "knn", str(i), "l", i % 2, i / 10) for i in range(10)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    ingest_pools(spark, source, pools, facts, mark).awaitTermination(120)
    assert spark.read.parquet(facts).first().n_samples == 10
    spark.createDataFrame(rows + [("c", "n", "knn", "1", "l", 1, 0.5), ("c", "n", "knn", "2", "l", 0, 0.1)], SCHEMA).write.mode("append").parquet(source)
    ingest_pools(spark, source, pools, facts, mark).awaitTermination(120)
    assert {(r.model, r.n_samples) for r in spark.read.parquet(facts).collect()} == {("m", 10), ("n", 2)}


def test_a_cell_grows_over_files(spark, tmp_path):
    source, pools, facts, mark = (f"{tmp_path}/{n}" for n in ("in", "pools", "facts", "mark"))
    cell = ("c", "m", "knn")
    spark.createDataFrame([(*cell, str(i), "l", i % 2, i / 10) for i in range(10)], SCHEMA).write.parquet(source)
    ingest_pools(spark, source, pools, facts, mark).awaitTermination(120)
    # ten others, one that is sent again with another score, and one that comes twice
    more = [(*cell, str(i), "l", i % 2, i / 10) for i in range(10, 20)] + [(*cell, "3", "l", 1, 0.95), (*cell, "10", "l", 0, 5.0)]
    spark.createDataFrame(more, SCHEMA).write.mode("append").parquet(source)
    ingest_pools(spark, source, pools, facts, mark).awaitTermination(120)
    assert spark.read.parquet(facts).first().n_samples == 20
    found = {r.id: r.score for r in latest(spark.read.schema(SCHEMA + ", batch long").parquet(pools)).collect()}
    assert len(found) == 20 and found["3"] == 0.95 and found["10"] == 5.0 and found["5"] == 0.5
