"""Score files arrive one by one; each (cohort, model, readout) cell is counted once, however often a file is resent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.writers import CELL

SCHEMA = "cohort string, model string, readout string, id string, label string, y int, score double"


def latest(pools: DataFrame) -> DataFrame:
    """Of each cell's id and label the row that came last; of several in one batch the one with the greatest score."""
    newest = F.max(F.struct("batch", "score", "y")).alias("__x")
    return pools.groupBy(*CELL, "id", "label").agg(newest).select(*CELL, "id", "label", "__x.y", "__x.score")


def fold_in(pools_path: str, facts_path: str):
    """What a batch does: add its rows to its cells' pools, and recompute these cells' facts.

    A batch writes partitions of its own, so a cell whose rows arrive in several files keeps them all, and a batch that
    runs again after a failure replaces only what it wrote itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        own = latest(batch.withColumn("batch", F.lit(number).cast("long")))
        own.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL, "batch").parquet(pools_path)
        stored = batch.sparkSession.read.schema(SCHEMA + ", batch long").parquet(pools_path)
        pools = latest(stored.join(batch.select(*CELL).distinct(), CELL, "left_semi"))
        facts = metrics.per_class(pools, CELL)
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL).parquet(facts_path)

    return run


def ingest_pools(spark: SparkSession, source: str, pools_path: str, facts_path: str, checkpoint: str):
    """A query over new parquet files of scores; started, it runs until all that is there is done."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(fold_in(pools_path, facts_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, kind: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) over tumbling windows, for streams and tables alike."""
    grouped = stream.withWatermark(time, late) if stream.isStreaming else stream
    return grouped.groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
