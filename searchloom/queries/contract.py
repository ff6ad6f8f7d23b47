"""Reports, manifests, identities and canonical forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.functions import dates, paths
from searchloom.functions.json import canonical
from searchloom.functions.text import content_hash
from searchloom.operators import metadata, metrics, reconcile
from searchloom.plans import response
from searchloom.queries import base, state
from searchloom.queries.base import FILES, INDEXED, chunks_sql, with_sql
from searchloom.sources import corpus
from searchloom.sources.corpus import table

Q: dict = {}
SQL: dict[str, str] = {}

# canonical forms and digests
Q["canonical_json"] = lambda s, d: corpus.files(s, d).select("doc_id", canonical(path=F.col("path"), author=F.col("author"), occurred_ms=F.col("occurred_ms"), schema_version=F.col("schema_version")).alias("json"))
SQL["canonical_json"] = with_sql(FILES) + """SELECT doc_id, '{"author":' || to_json(author) || ',"occurred_ms":' || coalesce(occurred_ms::VARCHAR, 'null') || ',"path":' || to_json(path) || ',"schema_version":' || schema_version || '}' AS json FROM files"""


def _members(s, d):
    return corpus.files(s, d).select("section", "path", F.octet_length("text").alias("bytes"), content_hash(F.col("text")).alias("sha256"))


Q["members_digest"] = lambda s, d: metrics.members_digest(_members(s, d), "section")
SQL["members_digest"] = with_sql(FILES, """m AS (SELECT section, path, '{"bytes":' || strlen(text) || ',"path":' || to_json(path) || ',"sha256":"' || sha256(text) || '"}' AS j FROM files)""") + "SELECT section, count(*) AS members, sha256('[' || string_agg(j, ',' ORDER BY path) || ']') AS digest FROM m GROUP BY section"
Q["status_counts"] = lambda s, d: metrics.status_counts(reconcile.live_state(corpus.live_files(s, d), readable="readable"))
SQL["status_counts"] = with_sql(state.STATE) + "SELECT st AS status, count(*) AS checks FROM lv GROUP BY st"

# reports in order
LEVELS = "PARTITION BY section ORDER BY path"


def _entries(s, d):
    """Each section's plan as its report lists it, with the entries' places."""
    p = response.entries(state._plan(s, d).select("section", "path", "action"))
    return p.withColumn("n", F.row_number().over(W.partitionBy("section").orderBy("path")))


Q["report_entries"] = _entries
SQL["report_entries"] = with_sql(state.STATE) + f"SELECT section, path, action, row_number() OVER ({LEVELS})::INTEGER AS n FROM done"


def _manifest(s, d):
    from searchloom.operators import generations

    g = response.manifest(generations.step(state._previous(s, d), state._attempt(s, d), True))
    return g.select("source_uid", "kind", F.row_number().over(W.partitionBy("kind").orderBy("source_uid")).alias("n"))


Q["manifest_order"] = _manifest
SQL["manifest_order"] = with_sql(state.GEN) + "SELECT source_uid, kind, row_number() OVER (PARTITION BY kind ORDER BY source_uid)::INTEGER AS n FROM gen WHERE kind IS NOT NULL"


def _sync_json(s, d):
    row = reconcile.status(reconcile.counters(state._plan(s, d)), F.lit("ok"), F.lit("ok"))
    return response.sync_json(row, F.lit("ok"), F.lit("ok"))


Q["sync_report"] = _sync_json
SQL["sync_report"] = with_sql(state.STATE, state.COUNTS) + """SELECT '{"changed":true,"contract_version":1,"counters":{"added_chunks":' || added_chunks || ',"deleted_chunks":' || deleted_chunks || ',"errors":' || errors || ',"published_files":' || published_files || ',"removed_files":' || removed_files || ',"skipped_files":' || skipped_files
    || '},"errors":[],"errors_truncated":' || (errors > 0) || ',"indexes":{"lexical":"ok","vector":"ok"},"operation":"sync","recommendation":"' || CASE WHEN errors > 0 THEN 'retry_sync' ELSE 'none' END || '","scope":"all","status":"' || CASE WHEN errors > 0 THEN 'partial' ELSE 'succeeded' END || '"}' AS report FROM n"""

# identities
Q["rebase_chunks"] = lambda s, d: metadata.rebase(base.chunks(s, d).where("source_kind = 'doc'"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")), F.lit("sources")).select("id", "path", "section", "chunk_index")
SQL["rebase_chunks"] = with_sql(FILES, chunks_sql()) + "SELECT 'documents/' || doc_id || '.md::' || file_hash || '::v3::' || chunk_index AS id, 'documents/' || doc_id || '.md' AS path, 'sources' AS section, chunk_index::INTEGER AS chunk_index FROM chunks WHERE source_kind = 'doc'"
Q["section_override"] = lambda s, d: metadata.override_section(base.chunks(s, d), "operations").select("id", "section")
SQL["section_override"] = with_sql(FILES, chunks_sql()) + "SELECT id, 'operations' AS section FROM chunks"


def _owned(s, d):
    kind = F.when(F.col("doc_id") % 4 != 0, F.col("source_kind"))
    return base.indexed_chunks(s, d).withColumn("domain", reconcile.domain_of(kind)).where("domain IS NOT NULL")


Q["owned_chunks"] = lambda s, d: reconcile.indexed_state(_owned(s, d)).select("domain", "section", "path", "old_chunks")
SQL["owned_chunks"] = with_sql(FILES, INDEXED, chunks_sql("indexed", "i_")) + """SELECT CASE WHEN doc_id % 4 = 0 OR source_kind = 'note' THEN 'vault' ELSE 'ingestion' END AS domain, section, path, count(*) AS old_chunks
    FROM i_chunks WHERE doc_id % 4 = 0 OR source_kind IN ('note', 'doc') GROUP BY ALL"""


def _read_back(s, d):
    """The ids that the index should have against those it has."""
    return reconcile.parity(base.chunks(s, d), base.index(s, d, "forward").table("forward"))


Q["read_back"] = _read_back
SQL["read_back"] = "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, true AS ready"

# remote pages
Q["latest_update"] = lambda s, d: corpus.files(s, d).select("path", dates.latest(F.when(F.col("doc_id") % 2 == 0, F.col("occurred_ms")), F.when(F.col("doc_id") % 3 != 0, F.col("updated_ms"))).alias("updated_ms"))
SQL["latest_update"] = with_sql(FILES) + "SELECT path, greatest(CASE WHEN doc_id % 2 = 0 THEN occurred_ms END, CASE WHEN doc_id % 3 <> 0 THEN updated_ms END) AS updated_ms FROM files"
NAME = "CASE page_id % 4 WHEN 0 THEN page_id || '.DRAWIO' WHEN 1 THEN page_id || '.xml' WHEN 2 THEN page_id || '.drawio.png' ELSE page_id || '.txt' END"
Q["diagram_flags"] = lambda s, d: table(s, d, "pages").select("page_id", paths.is_diagram(F.expr(NAME)).alias("is_diagram"))
SQL["diagram_flags"] = "SELECT page_id, page_id % 4 < 2 AS is_diagram FROM pages"
Q["flatten_paths"] = lambda s, d: corpus.files(s, d).select("path", paths.flatten(F.col("path")).alias("name"))
SQL["flatten_paths"] = with_sql(FILES) + "SELECT path, replace(path, '/', '__') AS name FROM files"
