"""Reconciliation over a stream of file drops.

Every micro-batch brings newer versions of some files; the batch's plan against
the current chunks is applied and published as a generation, so the state after
all batches is that of one batch with each file's last version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.contracts import CHUNKING_VERSION
from searchloom.operators.chunking import chunk_files
from searchloom.sources.index import ORDER, buckets_for, path_bucket, publication
from searchloom.sources.store import Store

#: The embedder that needs no model.
FINGERPRINT = {"embedding_model": "hash", "pooling": "count"}


def apply_batch(store: Store, files: DataFrame, order: str = "version", fingerprint: dict | None = None) -> str:
    """Publishes the index with files (path, section, text, schema_version and
    order) applied: of a path's rows the highest order counts, a null text
    deletes the path, and paths whose chunks are complete already stay. The
    vectors of new chunks are made by the fingerprint's embedder."""
    fingerprint = fingerprint or FINGERPRINT
    last = files.withColumn("__n", F.row_number().over(W.partitionBy("path").orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    fresh = chunk_files(last.where("text IS NOT NULL")).withColumn("chunking_version", F.lit(CHUNKING_VERSION))
    if store.table("chunks") is None:
        buckets = buckets_for(last)
        return store.publish(publication(store, fresh, fingerprint, buckets=buckets), fingerprint, "bucket", order=ORDER, buckets=buckets)
    touched = [r[0] for r in last.select(path_bucket(F.col("path"), store.buckets()).alias("b")).distinct().collect()]  # at most the number of parts
    held = store.table("chunks", touched).drop("bucket")
    same = held.select("path", F.col("file_hash").alias("h")).distinct().join(last.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("h")), ["path", "h"])
    moved = last.select("path").join(same.select("path"), "path", "left_anti")
    merged = held.join(moved, "path", "left_anti").unionByName(fresh.join(moved, "path", "left_semi").select(held.columns))
    return store.publish(publication(store, merged, fingerprint, touched), fingerprint, "bucket", replaced=touched, order=ORDER)


def stream(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str):
    """A running query that applies each new Parquet file of source."""
    store = Store(spark, root)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return reader.writeStream.foreachBatch(lambda df, _: apply_batch(store, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of event time, with a watermark: an addition
    beside the engine's own operators."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
