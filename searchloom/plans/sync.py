"""One synchronisation: plan, publish, verify, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import CHUNKING_VERSION, ERROR_SAMPLE
from searchloom.operators import reconcile
from searchloom.operators.chunking import chunk_files
from searchloom.sources.index import ORDER, buckets_for, path_bucket, publication
from searchloom.sources.store import Locked, PublicationError, Store

#: What a report says when nothing could be counted.
EMPTY = {"published_files": 0, "removed_files": 0, "skipped_files": 0, "added_chunks": 0, "deleted_chunks": 0, "errors": 0}
ERRORS = "section string, path string, error string"


def sync(store: Store, files: DataFrame, fingerprint: dict, sections_available: list[str] | None = None, text: str = "text", readable: str | None = None, wait: float | None = None) -> DataFrame:
    """Brings the store in line with files and returns one report row: counters,
    status, changed, recommendation, errors (the first by path) and whether more
    were left out.

    The chunks of published paths replace the old ones, with vectors by the
    embedder that the fingerprint names, and removed paths go. Only texts that the
    parts had no vector for are embedded. Only the parts of the tables with such paths are written; the others stay where
    they are. Files whose chunks break the contract aren't published, a section
    outside sections_available keeps all it has, and both are errors. Nothing is
    published when nothing moved; when what was written doesn't read back, the
    store stays as it was and the index is named as the error. A store that
    another writer holds gives the status locked.
    """
    spark = files.sparkSession
    old = store.table("chunks")
    files = files.withColumnRenamed(text, "text") if text != "text" else files
    fresh = chunk_files(files).withColumn("chunking_version", F.lit(CHUNKING_VERSION))
    indexed = reconcile.indexed_state(old if old is not None else fresh.limit(0))
    errors = spark.createDataFrame([], ERRORS)
    if sections_available is not None:
        errors = reconcile.unavailable(indexed, sections_available)
        indexed = indexed.where(F.col("section").isin(*sections_available))
    plan = reconcile.plan(reconcile.live_state(files, "text", readable), indexed)
    new = fresh.join(plan.where("action = 'publish'").select("path"), "path", "left_semi")
    broken = reconcile.validate(new).where("problem NOT IN ('ok', 'schema_version')").select("path")
    failed = plan.join(broken, "path", "left_semi").select("section", "path", F.lit("publication_failed").alias("error"))
    plan = plan.join(broken, "path", "left_anti").unionByName(plan.join(broken, "path", "left_semi").withColumns({"action": F.lit("keep"), "added": F.lit(0).cast("long"), "deleted": F.lit(0).cast("long"), "error": F.lit(None).cast("string")}))
    errors = errors.unionByName(failed).unionByName(plan.where("error IS NOT NULL").select("section", "path", "error"))
    counts = reconcile.counters(plan).drop("errors").crossJoin(errors.agg(F.count(F.lit(1)).alias("errors"))).head().asDict()
    sample = [r.asDict() for r in errors.orderBy("path", "section").limit(ERROR_SAMPLE).collect()]
    vector = lexical = "ok"
    if counts["published_files"] or counts["removed_files"] or old is None:
        moved = plan.where("action IN ('publish', 'remove')").select("path")
        buckets = buckets_for(files) if old is None else store.buckets()
        touched = [r[0] for r in moved.select(path_bucket(F.col("path"), buckets).alias("b")).distinct().collect()]  # at most the number of parts
        new = new.join(broken, "path", "left_anti")
        if old is None:
            merged, touched = new, list(range(buckets))
        else:
            kept = store.table("chunks", touched).drop("bucket").join(moved, "path", "left_anti")
            merged = kept.unionByName(new.select(kept.columns))
        try:
            tables = publication(store, merged, fingerprint, touched, buckets)
            store.publish(tables, fingerprint, "bucket", replaced=touched, order=ORDER, buckets=buckets, **({} if wait is None else {"wait": wait}))
        except Locked:
            return _report(spark, EMPTY, [], "locked", "ok", "ok")
        except PublicationError as error:
            lexical = "error" if "chunks" not in str(error) else "ok"
            vector = "ok" if lexical == "error" else "error"
            sample = [{"section": None, "path": None, "error": str(error)}, *sample][:ERROR_SAMPLE]
            counts |= {k: 0 for k in EMPTY if k not in ("skipped_files", "errors")} | {"errors": counts["errors"] + 1}
    return _report(spark, counts, sample, None, vector, lexical)


def _report(spark, counts: dict, sample: list[dict], status: str | None, vector: str, lexical: str) -> DataFrame:
    one = spark.createDataFrame([tuple(counts[k] for k in EMPTY)], ", ".join(f"{k} long" for k in EMPTY))
    out = reconcile.status(one, F.lit(vector), F.lit(lexical))
    if status:
        out = out.withColumn("status", F.lit(status)).withColumn("recommendation", F.lit("retry_sync"))
    found = spark.createDataFrame([(sample,)], f"error_sample array<struct<{ERRORS.replace(' string', ':string')}>>".replace(", ", ","))
    return out.crossJoin(found).withColumn("errors_truncated", F.col("errors") > F.size("error_sample"))  # one row each
