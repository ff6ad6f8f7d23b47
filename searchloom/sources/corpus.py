"""The driver's tables as sources: files, Markdown, pages and their versions.

documents are vault files, conversations Markdown files with front matter,
pages remote pages. Metadata comes from the key by fixed rules, and a second
version mutates, drops and adds rows by the key's remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS, HOUR_MS = 1_704_067_200_000, 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, section, text, source_kind, author, occurred_ms, updated_ms, schema_version."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.concat("source", F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"),
        F.col("source").alias("section"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(k % 3 == 0, "note").when(k % 3 == 1, "doc").otherwise("message").alias("source_kind"),
        F.upper("lang").alias("author"),
        F.when(k % 19 != 0, F.lit(EPOCH_MS) + k * HOUR_MS).alias("occurred_ms"),
        F.when(k % 19 != 0, F.lit(EPOCH_MS) + k * HOUR_MS + (k % 5) * 24 * HOUR_MS).alias("updated_ms"),
        F.when(k % 10 == 9, 1).otherwise(2).alias("schema_version"),
    )


def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that the index was built from."""
    return files(spark, sf_dir).where("doc_id % 13 <> 0")


def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk now: some files changed, gone, new or unreadable."""
    f = files(spark, sf_dir).where("doc_id % 11 <> 0")
    return f.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))).withColumn("readable", F.col("doc_id") % 17 != 0)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each conversation: front matter, a title, a heading for
    each turn. conv_id, path, text."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    k = F.col("conv_id").cast("string")
    head = F.concat(F.lit('---\ntitle: "Conversation '), k, F.lit('"\nauthor: user '), k, F.lit("\ndate: 2024-05-06\ntitle: \"Talk "), k, F.lit('"\n---\n\n# Conversation '), k, F.lit("\n"))
    return g.select("conv_id", F.concat(F.lit("talks/"), k, F.lit(".md")).alias("path"), F.concat(head, F.array_join(F.transform("ts", lambda x: x["t"]), "")).alias("text"))
