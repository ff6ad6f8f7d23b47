"""Freshness of an index against its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"ok": 0, "degraded": 1, "error": 2}


def indexed_hashes(chunks: DataFrame, contract_id: str = "freshness", version: str = "1") -> DataFrame:
    """(path, chunks, stored_hash) of chunks (path, file_content_hash,
    content_hash, contract_id, contract_version); stored_hash is null unless all
    rows agree on one hash of 64 characters under the current contract."""
    h = F.coalesce("file_content_hash", "content_hash")
    g = chunks.groupBy("path").agg(
        F.count(F.lit(1)).alias("chunks"), F.min(h).alias("lo"), F.max(h).alias("hi"), F.count(h).alias("with_hash"),
        F.bool_and(F.coalesce((F.col("contract_id") == contract_id) & (F.col("contract_version") == version), F.lit(False))).alias("current"),
    )
    good = F.col("current") & (F.col("lo") == F.col("hi")) & (F.col("with_hash") == F.col("chunks")) & (F.length("lo") == 64)
    return g.select("path", "chunks", F.when(good, F.col("lo")).alias("stored_hash"))


def report(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status, chunks) of live (path, live_hash, chunk_status, excluded)
    and indexed_hashes. chunk_status is what the chunker says of the file."""
    j = live.join(indexed, "path", "full_outer")
    absent = F.col("chunks").isNull()
    unindexed = F.when(F.col("chunk_status") == "ok", "unindexed").when(F.col("chunk_status").isin("empty", "too_large"), "no_chunks").otherwise("error")
    state = F.when(F.col("live_hash").isNull(), "missing").when(F.col("excluded"), "excluded").when(absent, unindexed).when(F.col("stored_hash").isNull(), "unknown").when(F.col("stored_hash") == F.col("live_hash"), "fresh").otherwise("stale")
    return j.select("path", state.alias("status"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def index_status(rows: DataFrame) -> DataFrame:
    """One row: error, degraded or ok for a report's rows."""
    bad = F.col("status").isin("stale", "missing", "unknown", "unindexed")
    return rows.agg(F.when(F.count_if(F.col("status") == "error") > 0, "error").when(F.count_if(bad) > 0, "degraded").otherwise("ok").alias("index_status"))


def ingestion_report(manifest: DataFrame, discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status) of a generation: manifest (path), discovered (path,
    live_hash) and indexed_hashes. A manifest document that isn't there is an
    error, an indexed path outside the manifest is missing."""
    m = manifest.select("path", F.lit(True).alias("expected"))
    j = m.join(discovered, "path", "left").join(indexed, "path", "full_outer")
    state = F.when(F.col("expected").isNull(), "missing").when(F.col("live_hash").isNull(), "error").when(F.col("chunks").isNull(), "unindexed").when(F.col("stored_hash").isNull(), "unknown").when(F.col("stored_hash") == F.col("live_hash"), "fresh").otherwise("stale")
    return j.select("path", state.alias("status"))


def worst(*statuses: Column) -> Column:
    """The worst of statuses; what isn't known counts as error."""
    level = lambda c: F.when(c == "ok", 0).when(c == "degraded", 1).otherwise(2)
    top = F.greatest(*[level(c) for c in statuses]) if len(statuses) > 1 else level(statuses[0])
    return F.when(top == 0, "ok").when(top == 1, "degraded").otherwise("error")


def annotate(hits: DataFrame, live: DataFrame, available: bool = True) -> DataFrame:
    """hits (path, file_hash and more) with freshness, by one lookup a distinct path."""
    if not available:
        return hits.withColumn("freshness", F.lit("unavailable"))
    paths = hits.select("path").distinct()
    known = paths.join(live.select("path", "live_hash"), "path", "left")
    rows = hits.join(known, "path", "left")
    return rows.withColumn("freshness", F.when(F.col("live_hash").isNull(), "missing").when(F.col("file_hash").isNull(), "unknown").when(F.col("live_hash") == F.col("file_hash"), "fresh").otherwise("stale")).drop("live_hash")


def substitute_stale(hits: DataFrame, live_texts: DataFrame) -> DataFrame:
    """Annotated hits (final_rank, path, freshness, chunk): a stale path's first
    hit carries the live text, its later ones go."""
    from pyspark.sql import Window as W

    rows = hits.withColumn("__nth", F.row_number().over(W.partitionBy("path").orderBy("final_rank")))
    rows = rows.where((F.col("freshness") != "stale") | (F.col("__nth") == 1)).join(live_texts.select("path", F.col("text").alias("__live")), "path", "left")
    return rows.withColumn("content", F.when(F.col("freshness") == "stale", F.col("__live")).otherwise(F.col("chunk"))).drop("__nth", "__live")
