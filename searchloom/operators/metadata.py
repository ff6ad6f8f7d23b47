"""The public metadata of chunks, and its renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import METADATA_FIELDS, METADATA_VERSION, SOURCE_KINDS
from searchloom.functions.dates import epoch_ms, first_date, rfc3339
from searchloom.functions.text import clean, content_hash, newlines
from searchloom.operators.chunking import chunk_id, scalar


def contract(front: Column, path: Column, section: Column, fallback_title: Column, file_hash: Column, captured_at: Column, default_kind: str = "note") -> list[Column]:
    """The 15 fields with their fallbacks, chunk_index being null. A content_hash
    in the front matter counts if it has 64 hex digits."""
    get = lambda k: scalar(front[k])
    kind = clean(get("source_kind"))
    told = get("content_hash")
    fields = {
        "schema_version": F.lit(METADATA_VERSION),
        "source_kind": F.when(kind.isin(*SOURCE_KINDS), kind).otherwise(default_kind),
        "source_system": F.coalesce(clean(get("source_system")), F.lit("vault")),
        "source_uid": F.coalesce(clean(get("source_uid")), path),
        "container_uid": F.coalesce(clean(get("container_uid")), section),
        "title": F.coalesce(clean(get("title")), fallback_title),
        "author": clean(get("author")),
        "occurred_at": first_date(get("occurred_at"), get("date"), get("created")),
        "updated_at": first_date(get("updated_at"), get("updated")),
        "canonical_uri": F.coalesce(clean(get("canonical_uri")), clean(get("url"))),
        "path": path,
        "section": section,
        "captured_at": F.coalesce(rfc3339(get("captured_at")), rfc3339(captured_at)),
        "content_hash": F.when(told.rlike("^[0-9a-f]{64}$"), told).otherwise(file_hash),
        "chunk_index": F.lit(None).cast("int"),
    }
    return [fields[k].alias(k) for k in METADATA_FIELDS]


def storage(df: DataFrame) -> DataFrame:
    """df with the numeric projections of its two times."""
    return df.withColumn("occurred_at_epoch_ms", epoch_ms(F.col("occurred_at"))).withColumn("updated_at_epoch_ms", epoch_ms(F.col("updated_at")))


def from_id(id_: Column) -> list[Column]:
    """path, content_hash, chunking_version and chunk_index of a chunk id; nulls
    for ids of another form."""
    p = F.split(id_, "::")
    n = F.size(p)
    good = (n >= 4) & (F.length(F.element_at(p, F.greatest(n - 2, F.lit(1)))) == 64)
    return [F.when(good, F.array_join(F.slice(p, F.lit(1), F.greatest(n - 3, F.lit(0))), "::")).alias("path"), F.when(good, F.element_at(p, F.greatest(n - 2, F.lit(1)))).alias("content_hash"), F.when(good, F.element_at(p, F.greatest(n - 1, F.lit(1)))).alias("chunking_version"), F.when(good, F.element_at(p, -1).try_cast("int")).alias("chunk_index")]


def rebase(chunks: DataFrame, path: Column, section: Column) -> DataFrame:
    """Chunks of generation documents under their own path and section, with ids to
    match; a chunk of another kind than doc, or without its parts, is an error."""
    good = F.coalesce((F.col("source_kind") == "doc") & F.col("chunk_index").isNotNull() & F.col("file_hash").isNotNull() & path.isNotNull(), F.lit(False))
    at = F.when(good, path).otherwise(F.raise_error(F.lit("a generation's chunk isn't of kind doc or lacks its identity")))
    return chunks.withColumns({"path": at, "section": section}).withColumn("id", chunk_id(F.col("path"), F.col("file_hash"), F.col("chunk_index")))


def override_section(chunks: DataFrame, section: str) -> DataFrame:
    """Chunks as those of the section that is reconciled, whatever they say."""
    return chunks.withColumn("section", F.lit(section))


def eav_pivot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row an id of (id, key, string_value, int_value, float_value, bool_value):
    a text column for each key, from whichever value is set."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    return rows.groupBy("id").agg(*[F.max(F.when(F.col("key") == k, value)).alias(k) for k in keys])


def _json(c: Column) -> Column:
    """A JSON string; the two escapes that to_json and others share, and controls."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")


def render_document(fields: dict[str, Column], body: Column) -> Column:
    """Front matter of JSON scalars above the body, whose line ends are line
    feeds and which ends in one; content_hash is the body's."""
    text = F.concat(F.regexp_replace(newlines(body), r"^\n+|\n+$", ""), F.lit("\n"))
    value = lambda k: content_hash(text) if k == "content_hash" else fields.get(k)
    line = lambda k: F.concat(F.lit(f"{k}: "), F.lit("null") if value(k) is None else F.coalesce(value(k).cast("string") if k == "schema_version" else F.when(value(k).isNotNull(), _json(value(k))), F.lit("null")))
    return F.concat_ws("\n", F.lit("---"), *[line(k) for k in METADATA_FIELDS], F.lit("---"), text)


def render_hits(hits: DataFrame) -> Column:
    """A hit's Markdown block: heading, section, relevance, source, times, citation,
    freshness and text; columns that hits lack are unknown."""
    get = lambda k: F.col(k) if k in hits.columns else F.lit(None).cast("string")
    title = F.coalesce(get("title"), get("path"), F.lit("Unknown"))
    header = F.when(F.coalesce(get("header"), F.lit("")) != "", F.concat(F.lit(" > "), get("header"))).otherwise("")
    percent = F.concat(F.bround((1 - F.col("distance")) * 100, 0).cast("int").cast("string"), F.lit("%"))
    relevance = F.when(F.col("distance").isNotNull(), percent).when(F.col("lexical_only"), "lexical-only")
    linked = F.concat(F.lit("**Citation:** ["), title, F.lit("]("), get("canonical_uri"), F.lit(")"))
    cite = F.coalesce(linked, F.concat(F.lit("**Citation:** `"), get("path"), F.lit("`")))
    line = lambda name, value: F.concat(F.lit(f"**{name}:** "), value)
    known = lambda k: F.coalesce(get(k), F.lit("unknown"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### ["), F.col("final_rank").cast("string"), F.lit("] "), title),
        line("Section", F.concat(F.coalesce(get("section"), F.lit("")), header)),
        line("Relevance", relevance),
        line("Source", F.concat(known("source_kind"), F.lit(" / "), known("source_system"))),
        line("Occurred", known("occurred_at")),
        line("Updated", known("updated_at")),
        cite,
        line("Freshness", known("freshness")),
        F.lit(""),
        F.coalesce(get("chunk"), F.lit("")),
        F.lit(""),
    )
