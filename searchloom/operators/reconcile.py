"""Hash-aware reconciliation of live files with an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import CHUNKING_VERSION, EMPTY_CHARS, ERROR_SAMPLE, MARKDOWN_BYTES, METADATA_VERSION
from searchloom.functions.text import content_hash, strip
from searchloom.operators.chunking import body, file_chunks

KEYS = ["domain", "section", "path"]
#: The domain of files of a vault, and that of documents that a generation brings.
VAULT, INGESTION = "vault", "ingestion"


def domain_of(kind: Column) -> Column:
    """The domain that owns a chunk of a source kind; null for kinds of neither."""
    return F.when(kind.isNull() | (kind == "note"), VAULT).when(kind == "doc", INGESTION)


def _domain(rows: DataFrame) -> Column:
    """Column domain, if there is one; else all is the vault's."""
    return F.col("domain") if "domain" in rows.columns else F.lit(VAULT).alias("domain")


def live_state(files: DataFrame, text: str = "text", readable: str | None = None, cap: int = MARKDOWN_BYTES) -> DataFrame:
    """files (path, section, text) as (domain, section, path, status, live_hash,
    live_chunks); status is ok, empty, too_large or read_error."""
    t = F.col(text)
    ok = F.lit(True) if readable is None else F.col(readable)
    status = F.when(F.octet_length(t) > cap, "too_large").when(~ok, "read_error").when(F.length(strip(body(t))) < EMPTY_CHARS, "empty").otherwise("ok")
    rows = files.withColumn("status", status)
    return rows.select(_domain(rows), "section", "path", "status", content_hash(t).alias("live_hash"), F.when(F.col("status") == "ok", F.size(file_chunks(text))).otherwise(0).alias("live_chunks"))


def indexed_state(chunks: DataFrame) -> DataFrame:
    """One row a path of chunks (path, section, id, file_hash, chunking_version,
    expected_chunk_count, schema_version): (domain, section, path, old_chunks,
    old_hash, complete, current). complete: one hash, the current contracts, and as many
    distinct ids as each row expects. current: the ids are of the chunking version."""
    g = chunks.groupBy(_domain(chunks), "section", "path").agg(
        F.count(F.lit(1)).alias("old_chunks"),
        F.countDistinct("id").alias("ids"),
        F.min("file_hash").alias("old_hash"),
        F.max("file_hash").alias("other_hash"),
        F.bool_and((F.col("chunking_version") == CHUNKING_VERSION) & (F.col("schema_version") == METADATA_VERSION)).alias("current"),
        F.bool_and(F.col("chunking_version") == CHUNKING_VERSION).alias("same_ids"),
        F.min("expected_chunk_count").alias("least"),
        F.max("expected_chunk_count").alias("most"),
    )
    complete = (F.col("old_hash") == F.col("other_hash")) & F.col("current") & (F.col("least") == F.col("most")) & (F.col("ids") == F.col("least")) & (F.col("old_chunks") == F.col("least"))
    return g.select(*KEYS, "old_chunks", "old_hash", complete.alias("complete"), F.coalesce("same_ids", F.lit(False)).alias("current"))


def plan(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """(KEYS, action, added, deleted, error): one row a path. Paths meet in one
    full outer join on the ownership key.

    skip: nothing to do. publish: write all chunks, verify, delete the others.
    remove: delete what is indexed. keep: unreadable, the old version stays.
    """
    j = live.join(indexed, KEYS, "full_outer")
    has = F.col("old_chunks").isNotNull()
    same = F.coalesce((F.col("old_hash") == F.col("live_hash")) & F.col("complete") & (F.col("old_chunks") == F.col("live_chunks")), F.lit(False))
    action = (
        F.when(F.col("status").isNull(), "remove")
        .when(F.col("status").isin("read_error", "extraction_error"), "keep")
        .when(F.col("status") == "ok", F.when(same, "skip").otherwise("publish"))
        .otherwise(F.when(has, "remove").otherwise("skip"))
    )
    rows = j.withColumn("action", action)
    added = F.when(F.col("action") == "publish", F.col("live_chunks")).otherwise(0)
    deleted = F.when(F.col("action") == "remove", F.col("old_chunks")).when((F.col("action") == "publish") & has & ((F.col("old_hash") != F.col("live_hash")) | ~F.col("current")), F.col("old_chunks")).otherwise(0)
    return rows.select(*KEYS, "action", added.cast("long").alias("added"), deleted.cast("long").alias("deleted"), F.when(F.col("action") == "keep", "extraction_failed").alias("error"))


def counters(plan_rows: DataFrame) -> DataFrame:
    """One row of counts over a plan."""
    n = lambda a: F.count_if(F.col("action") == a)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return plan_rows.agg(n("publish").alias("published_files"), n("remove").alias("removed_files"), n("skip").alias("skipped_files"), zero("added").alias("added_chunks"), zero("deleted").alias("deleted_chunks"), F.count("error").alias("errors"))


def status(counts: DataFrame, vector: Column, lexical: Column) -> DataFrame:
    """counts with status, changed and recommendation; vector and lexical are the
    indexes' states, ok if all is well."""
    moved = F.col("published_files") + F.col("removed_files")
    fine = (vector == "ok") & (lexical == "ok")
    s = F.when((moved == 0) & (F.col("errors") > 0), "failed").when((moved > 0) & ((F.col("errors") > 0) | ~fine), "partial").when((F.col("errors") == 0) & fine, "succeeded").otherwise("failed")
    advice = F.when(lexical != "ok", "repair_lexical").when(F.col("errors") > 0, "retry_sync").otherwise("none")
    return counts.withColumn("status", s).withColumn("changed", moved + F.col("added_chunks") + F.col("deleted_chunks") > 0).withColumn("recommendation", advice)


def unavailable(indexed: DataFrame, available: list[str]) -> DataFrame:
    """(section, path, error): an error for each indexed section that can't be read."""
    gone = indexed.select("section").distinct().where(~F.col("section").isin(*available) if available else F.lit(True))
    return gone.select("section", F.lit(None).cast("string").alias("path"), F.lit("section_unavailable").alias("error"))


def error_sample(plan_rows: DataFrame, limit: int = ERROR_SAMPLE) -> DataFrame:
    """The first errors by path, a report's sample, each with the number of all."""
    found = plan_rows.where("error IS NOT NULL").select("section", "path", "error")
    return found.orderBy("path").limit(limit).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("errors"))))  # one row


def validate(chunks: DataFrame) -> DataFrame:
    """(path, problem) of each path's chunk set, the first rule it breaks, or ok."""
    one = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) == 1
    g = chunks.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), one("file_hash").alias("one_hash"), F.bool_and(F.col("file_hash").isNotNull()).alias("hashed"),
        F.bool_and(F.coalesce(F.col("chunking_version") == CHUNKING_VERSION, F.lit(False))).alias("version"),
        F.bool_and(F.col("schema_version") == METADATA_VERSION).alias("schema"), F.min("expected_chunk_count").alias("least"), F.max("expected_chunk_count").alias("most"),
    )
    problem = (
        F.when(F.col("ids") != F.col("n"), "duplicate_ids").when(~F.col("one_hash") | ~F.col("hashed"), "content_hash").when(~F.col("version"), "chunking_version")
        .when(~F.coalesce("schema", F.lit(True)), "schema_version").when((F.col("least") != F.col("n")) | (F.col("most") != F.col("n")), "expected_count").otherwise("ok")
    )
    return g.select("path", problem.alias("problem"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner in right."""
    return left.join(right.select(*keys), keys, "left_anti")


def parity(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many keys are only in a, only in b, and whether the derived
    index b is ready (some keys, and none missing)."""
    j = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full_outer")
    return j.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count("in_b").alias("n_b")).select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("n_b") > 0)).alias("ready"))
