"""What a search and a synchronisation answer: structures and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import ERROR_SAMPLE, METADATA_FIELDS
from searchloom.functions.json import canonical
from searchloom.operators import freshness, metadata
from searchloom.plans.search import SearchResults

FILTERS = ("section", "source_kinds", "authors", "occurred_at_from", "occurred_at_to", "updated_at_from", "updated_at_to")


def annotated(hits: DataFrame, live: DataFrame | None) -> DataFrame:
    """hits, some tens of rows, with freshness; of live (path, live_hash) only the
    hits' paths are read. Without live it is unavailable."""
    if live is None:
        return freshness.annotate(hits, hits, available=False)
    paths = [r[0] for r in hits.select("path").distinct().collect()]
    return freshness.annotate(hits, live.where(F.col("path").isin(paths)))


def structured(hits: DataFrame) -> DataFrame:
    """final_rank, id, text, metadata (the contract's fields), citation, relevance
    (one minus the distance), lexical_only and freshness of annotated hits; fields
    that they lack are null."""
    field = lambda k: F.col(k) if k in hits.columns else F.lit(None).cast("string")
    meta = F.struct(*[field(k).alias(k) for k in METADATA_FIELDS])
    return hits.select("final_rank", "id", F.col("chunk").alias("text"), meta.alias("metadata"), F.coalesce(field("canonical_uri"), field("path")).alias("citation"), (1 - F.col("distance")).alias("relevance"), "lexical_only", "freshness")


def respond(found: SearchResults, query: str, live: DataFrame | None = None, filters: dict | None = None) -> DataFrame:
    """One row: schema_version, query, mode, fallback_reason, filters, results (an
    array in order) and the Markdown of all. Hits are at most ten."""
    spark = found.hits.sparkSession
    hits = annotated(found.hits, live)
    rows = structured(hits).join(hits.select("id", metadata.render_hits(hits).alias("block")), "id")
    head = [f"## Search: `{query}`\n", f"**Mode:** {found.mode}", *([f"**Fallback reason:** {found.reason}"] if found.reason else []), ""]
    cells = ["final_rank", "id", "text", "metadata", "citation", "relevance", "lexical_only", "freshness"]
    one = rows.agg(F.sort_array(F.collect_list(F.struct(*cells, "block"))).alias("r"))
    given = {k: (filters or {}).get(k) for k in FILTERS}
    told = spark.createDataFrame([(2, query, found.mode, found.reason, {k: None if v is None else str(v) for k, v in given.items()})], "schema_version int, query string, mode string, fallback_reason string, filters map<string,string>")
    markdown = F.concat_ws("\n", F.lit("\n".join(head)), F.transform("r", lambda x: x["block"]))
    return told.crossJoin(one).select(*told.columns, F.transform("r", lambda x: x.dropFields("block")).alias("results"), markdown.alias("markdown"))  # one row each


def entries(report: DataFrame, by: str = "path") -> DataFrame:
    """A report's rows in the order of their paths' bytes."""
    return report.orderBy(by)


def manifest(generation: DataFrame) -> DataFrame:
    """A generation's documents in the order of their ids, then its tombstones in
    that of their kinds and ids."""
    return generation.orderBy(F.col("kind") != "document", "kind", "source_uid")


def sync_json(counts: DataFrame, vector: Column, lexical: Column, scope: str = "all") -> DataFrame:
    """A synchronisation's report as one JSON document: counts is its row of
    counters, status and errors."""
    n = ["published_files", "removed_files", "skipped_files", "added_chunks", "deleted_chunks", "errors"]
    sample = F.col("error_sample") if "error_sample" in counts.columns else F.expr("CAST(array() AS array<struct<error:string,path:string,section:string>>)")
    doc = canonical(
        contract_version=F.lit(1), operation=F.lit("sync"), status=F.col("status"), changed=F.col("changed"), scope=F.lit(scope),
        counters=F.struct(*[F.col(c) for c in sorted(n)]), indexes=F.struct(lexical.alias("lexical"), vector.alias("vector")),
        errors=F.slice(sample, 1, ERROR_SAMPLE), errors_truncated=F.col("errors") > F.least(F.size(sample), F.lit(ERROR_SAMPLE)), recommendation=F.col("recommendation"),
    )
    return counts.select(doc.alias("report"))
