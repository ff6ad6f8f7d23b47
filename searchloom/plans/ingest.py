"""One run of a remote source: convert, check, step, publish."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.operators import convert, generations
from searchloom.sources.generation import Generations
from searchloom.sources.scratch import written


class Refused(RuntimeError):
    """An attempt that must not be published; the generation before stays."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def run(spark: SparkSession, root: str, pages: DataFrame, complete: bool = True, failures: float = 0.2, keep: int = 3, before: Callable[[str], None] = lambda step: None) -> dict:
    """Publishes the generation that follows from pages, all those that were seen
    (source_uid, path, html), and returns its counts with generation_id.

    Pages that fail keep the text they had, stale; those not seen become tombstones
    if the enumeration was complete. An attempt with repeated pages, with two pages
    of one path, or with a rate of failures over `failures` is Refused. Each run
    leaves its health (status, error_code, counts) in health.json, refused ones too.
    Null source_uids are refused as repeated ones are. Texts meet their rows by two
    joins on source_uid; nothing but counts comes to the driver.
    """
    store = Generations(spark, root)
    base = store.current() or ""
    try:
        found = _attempt(store, base, pages, complete, failures, keep, before)
    except Exception as error:
        store._write("health.json", {"status": "error", "error_code": getattr(error, "code", type(error).__name__), "at": time.time()})
        raise
    store._write("health.json", {"error_code": None, "at": time.time(), **found})
    return found


def _attempt(store: Generations, base: str, pages: DataFrame, complete: bool, failures: float, keep: int, before: Callable[[str], None]) -> dict:
    converted = written(convert.convert(pages.select("source_uid", "path", "html")), "converted")
    attempt, previous = convert.attempt(converted), written(store.previous(), "previous")
    if bad := converted.groupBy("source_uid").count().where("count > 1 OR source_uid IS NULL").agg(F.count(F.lit(1)).alias("n"), F.min("source_uid").alias("first")).head():
        if bad.n:
            raise Refused("duplicate", f"{bad.n} pages are repeated or have no id, the first is {bad.first}")
    rate = generations.failure_threshold(attempt, failures).head()
    if rate.exceeded:
        raise Refused("failure_threshold", f"{rate.failed} of {rate.total} pages failed")
    step = written(generations.step(previous, attempt.drop("text"), complete), "step")
    now = converted.where("outcome = 'ok'").select("source_uid", F.col("path").alias("__path"), F.col("text").alias("__text"))
    old = store.rows("documents").select("source_uid", F.col("path").alias("__old_path"), F.col("text").alias("__old_text"))
    kept = step.where("kind = 'document'").join(now, "source_uid", "left").join(old, "source_uid", "left")
    fresh = F.col("status") == "fresh"
    documents = kept.select("source_uid", F.when(fresh, F.coalesce("__path", "__old_path")).otherwise(F.col("__old_path")).alias("path"), "status", "content_hash", F.when(fresh, F.coalesce("__text", "__old_text")).otherwise(F.col("__old_text")).alias("text"))
    documents = written(documents, "documents")
    if twice := generations.path_collisions(documents).orderBy("path").head():
        raise Refused("path_collision", f"{twice.owners} pages are at {twice.path}")
    name = store.put(documents, step.where("kind <> 'document'"), keep, before=before, base=base)
    return generations.counts(step, attempt).head().asDict() | {"generation_id": name, "documents": documents.count()}
