"""Retrieval, drift and fragmentation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.functions.json import canonical


def retrieval(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row over (query_id, rank), rank null if not found within k: queries,
    mrr, hit1, hits."""
    r = F.when(F.col("rank") <= k, F.col("rank"))
    return ranks.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce((r == 1).cast("double"), F.lit(0.0))), 6).alias("hit1"), F.count(r).alias("hits"))


def drift(truth: DataFrame, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1) of truth (expected, actual); an empty
    denominator gives 1."""
    rows = truth.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    e, a = F.col("expected") == F.col("label"), F.coalesce(F.col("actual") == F.col("label"), F.lit(False))
    g = rows.groupBy("label").agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"))
    ratio = lambda n, d: F.when(d == 0, 1.0).otherwise(n / d)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6).alias("f1"))


def false_stale_rate(truth: DataFrame) -> DataFrame:
    fresh = truth.where("expected = 'fresh'")
    return fresh.agg(F.round(F.coalesce(F.avg((F.col("actual") == "stale").cast("double")), F.lit(0.0)), 6).alias("false_stale_rate"), F.count(F.lit(1)).alias("fresh_files"))


def fragmentation(chunks: DataFrame, by: str, small: int, text: str = "chunk") -> DataFrame:
    """(by, chunks, files, chunks_per_file, median_chars, pct_small); the median is exact."""
    n = F.length(text)
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"), F.round(F.count(F.lit(1)) / F.countDistinct("path"), 3).alias("chunks_per_file"),
        F.round(F.percentile(n, F.lit(0.5)), 3).alias("median_chars"), F.round(100.0 * F.count_if(n < small) / F.count(F.lit(1)), 3).alias("pct_small"),
    )


def small_kinds(chunks: DataFrame, small: int, text: str = "chunk") -> DataFrame:
    """(kind, chunks) of small chunks: whole_section, split_tail or split_body, by
    their place among the chunks of (path, section_no)."""
    over = W.partitionBy("path", "section_no")
    rows = chunks.withColumn("n", F.count(F.lit(1)).over(over)).withColumn("last", F.max("chunk_index").over(over) == F.col("chunk_index"))
    kind = F.when(F.col("n") == 1, "whole_section").when(F.col("last"), "split_tail").otherwise("split_body")
    return rows.where(F.length(text) < small).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("chunks"))


def work_avoided(plan_rows: DataFrame, done: str, full: str) -> DataFrame:
    return plan_rows.agg(F.sum(done).alias("selective"), F.sum(full).alias("full"), F.round(100 * (1 - F.sum(done) / F.sum(full)), 3).alias("avoided_pct"))


def churn(ranks: DataFrame, baseline: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, change) of queries whose answer entered or left the first k."""
    now, then = ranks.select("query_id", F.when(F.col("rank") <= k, F.col("rank")).alias("now")), baseline.select("query_id", F.when(F.col("rank") <= k, F.col("rank")).alias("then"))
    j = now.join(then, "query_id", "full_outer")
    return j.select("query_id", F.when(F.col("now").isNotNull() & F.col("then").isNull(), "entered").when(F.col("now").isNull() & F.col("then").isNotNull(), "left").alias("change")).where("change IS NOT NULL")


def ids_digest(df: DataFrame, by: str, id_: str = "id") -> DataFrame:
    """(by, ids, digest): SHA-256 of each group's sorted ids, one a line. A group
    is a table's partition such as a section; at scale give smaller ones."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list(id_)), "\n").cast("binary"), 256).alias("digest"))


def members_digest(df: DataFrame, by: str) -> DataFrame:
    """(by, members, digest): SHA-256 of the canonical JSON list of each role's
    members (path, bytes, sha256), ordered by the bytes of their paths."""
    member = canonical(path=F.col("path"), bytes=F.col("bytes"), sha256=F.col("sha256"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", member.alias("m")))), lambda x: x["m"])
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).cast("binary"), 256).alias("digest"))


def status_counts(checks: DataFrame, status: str = "status") -> DataFrame:
    """(status, checks)."""
    return checks.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("checks"))


def snapshot(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct files, and rows of the current and other metadata versions."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"), F.count_if(F.col("schema_version") == 2).alias("v2"), F.count_if(~F.col("schema_version").eqNullSafe(F.lit(2))).alias("other"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of two manifests (path, sha): added, removed, changed or same."""
    j = old.select("path", F.col("sha").alias("a")).join(new.select("path", F.col("sha").alias("b")), "path", "full_outer")
    return j.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))
