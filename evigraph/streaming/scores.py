"""An extension: structural scores that arrive as files are upserted into the pair cache, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.pairs import upsert
from evigraph.sources.state import StateStore

SCHEMA = "node_a string, node_b string, metric string, score double, seq long"
KEYS = ["node_a", "node_b", "metric"]


def score_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return rows.where("score BETWEEN 0 AND 1").select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "metric", "score", "seq")


def keep_cache(stream: DataFrame, store: StateStore, name: str, checkpoint: str):
    """Starts a query that replaces the cache's version after each batch; a batch that is run again changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old = store.read(name)
        store.replace(name, upsert(old if old is not None else batch.where("false"), batch, KEYS))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, folder: str, schema: str, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark over an event stream."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
