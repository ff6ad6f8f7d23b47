"""Reconciliation, freshness, generations and metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.contracts import JOB_BYTES, JOB_PAGES, MARKDOWN_BYTES
from searchloom.functions.text import content_hash
from searchloom.operators import chunking, freshness, generations, metrics, reconcile
from searchloom.queries import base, search, text
from searchloom.queries.base import FILES, INDEXED, LIVE, chunks_sql, kept_sql, rows, spans_sql, strip_sql, values_sql, with_sql
from searchloom.sources import corpus
from searchloom.sources.corpus import table
from searchloom.sources.scratch import written

Q: dict = {}
SQL: dict[str, str] = {}
def _live(s, d):
    return reconcile.live_state(corpus.live_files(s, d), readable="readable")


def _plan(s, d):
    return reconcile.plan(_live(s, d), reconcile.indexed_state(base.indexed_chunks(s, d)))


def _counts(source: str, prefix: str, name: str) -> str:
    return f"{spans_sql(f'(SELECT * FROM {source} WHERE {kept_sql("text")})', prefix=prefix)}, {name} AS (SELECT path, count(*) AS chunks FROM (SELECT path, {strip_sql('substr(text, s + 1, e - s)')} AS c FROM {prefix}spans) WHERE c <> '' GROUP BY path)"


STATE = f"""{FILES}, {INDEXED}, {LIVE}, {_counts('indexed', 'i_', 'oldn')}, {_counts('live', 'l_', 'newn')},
    lv AS (SELECT l.section, l.path, sha256(l.text) AS h, n.chunks AS c, CASE WHEN strlen(l.text) > {MARKDOWN_BYTES} THEN 'too_large' WHEN NOT readable THEN 'read_error' WHEN length({strip_sql('l.text')}) < 20 THEN 'empty' ELSE 'ok' END AS st FROM live l LEFT JOIN newn n USING (path)),
    ix AS (SELECT i.section, i.path, sha256(i.text) AS oh, o.chunks AS oc, i.schema_version = 2 AS cur FROM indexed i JOIN oldn o USING (path)),
    pl AS (SELECT coalesce(lv.section, ix.section) AS section, coalesce(lv.path, ix.path) AS path, lv.path IS NULL AS gone, ix.path IS NOT NULL AS has, st, h, c, oh, oc, cur FROM lv FULL JOIN ix ON lv.path = ix.path),
    plan AS (SELECT 'vault' AS domain, section, path, has, st, h, c, oh, oc, CASE WHEN gone THEN 'remove' WHEN st = 'read_error' THEN 'keep' WHEN st = 'ok' THEN CASE WHEN has AND oh = h AND cur AND oc = c THEN 'skip' ELSE 'publish' END WHEN has THEN 'remove' ELSE 'skip' END AS action FROM pl),
    done AS (SELECT domain, section, path, action, (CASE WHEN action = 'publish' THEN c ELSE 0 END)::BIGINT AS added, (CASE WHEN action = 'remove' THEN oc WHEN action = 'publish' AND has AND oh <> h THEN oc ELSE 0 END)::BIGINT AS deleted, CASE WHEN action = 'keep' THEN 'extraction_failed' END AS error FROM plan)"""
COUNTS = "n AS (SELECT count(*) FILTER (action = 'publish') AS published_files, count(*) FILTER (action = 'remove') AS removed_files, count(*) FILTER (action = 'skip') AS skipped_files, sum(added)::BIGINT AS added_chunks, sum(deleted)::BIGINT AS deleted_chunks, count(error) AS errors FROM done)"
Q["reconcile_plan"] = _plan
SQL["reconcile_plan"] = with_sql(STATE) + "SELECT * FROM done"
Q["sync_counters"] = lambda s, d: reconcile.counters(_plan(s, d))
SQL["sync_counters"] = with_sql(STATE, COUNTS) + "SELECT * FROM n"
Q["sync_status"] = lambda s, d: reconcile.status(reconcile.counters(_plan(s, d)), F.lit("ok"), F.lit("ok")).select("status", "changed", "recommendation")
SQL["sync_status"] = with_sql(STATE, COUNTS) + "SELECT CASE WHEN errors > 0 THEN 'partial' ELSE 'succeeded' END AS status, true AS changed, CASE WHEN errors > 0 THEN 'retry_sync' ELSE 'none' END AS recommendation FROM n"
Q["error_sample"] = lambda s, d: reconcile.error_sample(_plan(s, d))
SQL["error_sample"] = with_sql(STATE) + "SELECT section, path, error, count(*) OVER () AS errors FROM done WHERE error IS NOT NULL ORDER BY path LIMIT 50"
Q["removed_paths"] = lambda s, d: reconcile.difference(corpus.indexed_files(s, d).select("path"), corpus.live_files(s, d), ["path"])
SQL["removed_paths"] = with_sql(FILES) + "SELECT path FROM files WHERE doc_id % 13 <> 0 AND doc_id % 11 = 0"


def _live_chunks(s, d):
    return chunking.chunk_files(corpus.live_files(s, d))


Q["obsolete_ids"] = lambda s, d: reconcile.difference(base.indexed_chunks(s, d).select("id"), _live_chunks(s, d), ["id"])
SQL["obsolete_ids"] = with_sql(FILES, INDEXED, LIVE, chunks_sql("indexed", "i_"), chunks_sql("live", "l_")) + "SELECT id FROM i_chunks WHERE id NOT IN (SELECT id FROM l_chunks)"
Q["validate_chunks"] = lambda s, d: reconcile.validate(base.indexed_chunks(s, d).withColumn("expected_chunk_count", F.when(F.col("doc_id") % 23 == 0, F.col("expected_chunk_count") + 1).otherwise(F.col("expected_chunk_count"))).withColumn("chunking_version", F.when(F.col("doc_id") % 29 == 0, "v2").otherwise(F.col("chunking_version"))))
SQL["validate_chunks"] = with_sql(FILES, INDEXED, chunks_sql("indexed", "i_")) + "SELECT path, CASE WHEN doc_id % 29 = 0 THEN 'chunking_version' WHEN doc_id % 10 = 9 THEN 'schema_version' WHEN doc_id % 23 = 0 THEN 'expected_count' ELSE 'ok' END AS problem FROM i_chunks GROUP BY path, doc_id"
Q["complete_versions"] = lambda s, d: reconcile.indexed_state(base.indexed_chunks(s, d)).select("path", "old_chunks", "complete")
SQL["complete_versions"] = with_sql(FILES, INDEXED, chunks_sql("indexed", "i_")) + "SELECT path, count(*) AS old_chunks, doc_id % 10 <> 9 AS complete FROM i_chunks GROUP BY path, doc_id"
Q["index_parity"] = lambda s, d: reconcile.parity(base.indexed_chunks(s, d), base.indexed_chunks(s, d).where("doc_id % 5 <> 0"))
SQL["index_parity"] = with_sql(FILES, INDEXED, chunks_sql("indexed", "i_")) + "SELECT count(*) AS only_a, 0::BIGINT AS only_b, false AS ready FROM i_chunks WHERE doc_id % 5 = 0"
Q["duplicate_ids"] = lambda s, d: corpus.files(s, d).groupBy(content_hash(F.col("text")).alias("sha256")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
SQL["duplicate_ids"] = with_sql(FILES) + "SELECT sha256(text) AS sha256, count(*) AS files FROM files GROUP BY 1 HAVING count(*) > 1"
Q["collection_snapshot"] = lambda s, d: metrics.snapshot(base.chunks(s, d))
SQL["collection_snapshot"] = with_sql(FILES, chunks_sql()) + "SELECT count(*) AS chunks, count(DISTINCT path) AS files, count(*) FILTER (schema_version = 2) AS v2, count(*) FILTER (schema_version <> 2) AS other FROM chunks"
Q["ids_digest"] = lambda s, d: metrics.ids_digest(base.chunks(s, d), "section")
SQL["ids_digest"] = with_sql(FILES, chunks_sql()) + "SELECT section, count(*) AS ids, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM chunks GROUP BY section"


def _manifest(f):
    return f.select("path", content_hash(F.col("text")).alias("sha"))


Q["manifest_diff"] = lambda s, d: metrics.manifest_diff(_manifest(corpus.indexed_files(s, d)), _manifest(corpus.live_files(s, d)))
SQL["manifest_diff"] = with_sql(FILES) + "SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM files WHERE doc_id % 13 <> 0 OR doc_id % 11 <> 0"

# freshness


def _stored(s, d):
    """Chunk metadata as stored: some without hash, some of an old contract."""
    c = base.indexed_chunks(s, d)
    k = F.col("doc_id")
    return c.select("path", F.when(k % 31 != 0, F.col("file_hash")).alias("file_content_hash"), F.lit(None).cast("string").alias("content_hash"), F.lit("freshness").alias("contract_id"), F.when(k % 37 == 0, "0").otherwise("1").alias("contract_version"))


def _live_files(s, d):
    f = _live(s, d)
    return f.select("path", "live_hash", F.col("status").alias("chunk_status"), (F.col("section") == "src4").alias("excluded"))


def _report(s, d):
    return freshness.report(_live_files(s, d), freshness.indexed_hashes(_stored(s, d)))


FRESH = f"""{STATE}, rep AS (SELECT coalesce(lv.path, ix.path) AS path, CASE WHEN lv.path IS NULL THEN 'missing' WHEN lv.section = 'src4' THEN 'excluded'
        WHEN ix.path IS NULL THEN CASE WHEN st = 'ok' THEN 'unindexed' WHEN st IN ('empty', 'too_large') THEN 'no_chunks' ELSE 'error' END
        WHEN regexp_extract(ix.path, '/([0-9]+)', 1)::BIGINT % 31 = 0 OR regexp_extract(ix.path, '/([0-9]+)', 1)::BIGINT % 37 = 0 THEN 'unknown' WHEN h = oh THEN 'fresh' ELSE 'stale' END AS status, coalesce(oc, 0) AS chunks FROM lv FULL JOIN ix ON lv.path = ix.path)"""
Q["classify_hash"] = lambda s, d: freshness.indexed_hashes(_stored(s, d)).select("path", "chunks", "stored_hash")
SQL["classify_hash"] = with_sql(FILES, INDEXED, chunks_sql("indexed", "i_")) + "SELECT path, count(*) AS chunks, CASE WHEN doc_id % 31 <> 0 AND doc_id % 37 <> 0 THEN any_value(file_hash) END AS stored_hash FROM i_chunks GROUP BY path, doc_id"
Q["freshness_report"] = _report
SQL["freshness_report"] = with_sql(FRESH) + "SELECT path, status, chunks FROM rep"
Q["freshness_summary"] = lambda s, d: freshness.summary(_report(s, d))
SQL["freshness_summary"] = with_sql(FRESH) + "SELECT status, count(*) AS files FROM rep GROUP BY status"
STAGES = [(1, "ok"), (2, "degraded"), (3, "error"), (4, "odd")]
Q["two_stage_status"] = lambda s, d: rows(s, STAGES, "n int, source_status string").join(F.broadcast(freshness.index_status(_report(s, d))), how="cross").select("n", freshness.worst(F.col("source_status"), F.col("index_status")).alias("status"))
SQL["two_stage_status"] = with_sql(FRESH, "ixs AS (SELECT CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 2 WHEN count(*) FILTER (status IN ('stale', 'missing', 'unknown', 'unindexed')) > 0 THEN 1 ELSE 0 END AS lv FROM rep)") + f"SELECT n::INTEGER AS n, ['ok', 'degraded', 'error'][greatest(lv, CASE source_status WHEN 'ok' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END) + 1] AS status FROM {values_sql(STAGES, 'n, source_status')}, ixs"


def _ingestion(s, d):
    live = corpus.files(s, d)
    manifest = live.where("doc_id % 3 <> 0").select("path")
    found = _manifest(live.where("doc_id % 8 <> 0")).withColumnRenamed("sha", "live_hash")
    return freshness.ingestion_report(manifest, found, freshness.indexed_hashes(_stored(s, d).where("path IS NOT NULL")))


Q["ingestion_freshness"] = _ingestion
SQL["ingestion_freshness"] = with_sql(FILES, f"ic AS (SELECT path FROM files WHERE doc_id % 13 <> 0 AND {kept_sql('text')})") + """SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 8 = 0 THEN 'error' WHEN path NOT IN (SELECT path FROM ic) THEN 'unindexed' WHEN doc_id % 31 = 0 OR doc_id % 37 = 0 THEN 'unknown' ELSE 'fresh' END AS status
    FROM files WHERE doc_id % 3 <> 0 OR path IN (SELECT path FROM ic)"""


def _hits(s, d):
    c = base.indexed_chunks(s, d)
    return c.withColumn("final_rank", F.row_number().over(W.partitionBy("section").orderBy("id"))).select("section", "id", "path", "file_hash", "chunk", "final_rank")


def _annotated(s, d):
    return freshness.annotate(_hits(s, d), _manifest(corpus.live_files(s, d)).withColumnRenamed("sha", "live_hash"))


Q["annotate_hits"] = lambda s, d: _annotated(s, d).select("id", "final_rank", "freshness")
HITS = "hit AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY id) AS final_rank, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'fresh' END AS freshness, row_number() OVER (PARTITION BY path ORDER BY id) = 1 AS first FROM i_chunks)"
SQL["annotate_hits"] = with_sql(FILES, INDEXED, chunks_sql("indexed", "i_"), HITS) + "SELECT id, final_rank::INTEGER AS final_rank, freshness FROM hit"
Q["stale_substitution"] = lambda s, d: freshness.substitute_stale(_annotated(s, d), corpus.live_files(s, d)).select("id", "freshness", F.md5(F.col("content").cast("binary")).alias("md5"))
SQL["stale_substitution"] = with_sql(FILES, INDEXED, LIVE, chunks_sql("indexed", "i_"), HITS) + "SELECT h.id, h.freshness, md5(CASE WHEN h.freshness = 'stale' THEN l.text ELSE h.chunk END) AS md5 FROM hit h LEFT JOIN live l USING (path) WHERE h.freshness <> 'stale' OR h.first"

# generations


def _previous(s, d):
    p = table(s, d, "pages")
    k = F.col("page_id")
    return p.where(k % 6 != 0).select(k.cast("string").alias("source_uid"), F.when(k % 5 == 0, "stale").otherwise("fresh").alias("status"), F.sha2(F.col("url").cast("binary"), 256).alias("content_hash"), F.when(k % 9 == 0, "tombstone").otherwise("document").alias("kind"))


def _attempt(s, d):
    p = table(s, d, "pages")
    k = F.col("page_id")
    outcome = F.when(k % 4 == 0, "ok").when(k % 4 == 1, "failed")
    return p.where(k % 10 != 0).select(k.cast("string").alias("source_uid"), outcome.alias("outcome"), (k % 7 != 0).alias("seen"), F.when(k % 4 == 0, F.sha2(F.concat("url", F.lit("#2")).cast("binary"), 256)).alias("content_hash"))


GEN = """prev AS (SELECT page_id AS k, CASE WHEN page_id % 5 = 0 THEN 'stale' ELSE 'fresh' END AS os, sha256(url) AS oh, page_id % 9 <> 0 AS doc FROM pages WHERE page_id % 6 <> 0),
    att AS (SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' END AS oc, page_id % 7 <> 0 AS seen, CASE WHEN page_id % 4 = 0 THEN sha256(url || '#2') END AS nh FROM pages WHERE page_id % 10 <> 0),
    j AS (SELECT coalesce(p.k, a.k) AS k, os, oh, p.k IS NOT NULL AND doc AS was, p.k IS NOT NULL AND NOT doc AS buried, coalesce(oc, '') AS oc, coalesce(seen, false) AS seen, nh FROM prev p FULL JOIN att a ON p.k = a.k),
    gen AS (SELECT k::VARCHAR AS source_uid, CASE WHEN oc = 'ok' OR (was AND seen) THEN 'document' WHEN was OR (buried AND NOT seen) THEN 'tombstone' END AS kind,
        CASE WHEN oc = 'ok' THEN 'fresh' WHEN was AND seen THEN CASE WHEN oc = 'failed' THEN 'stale' ELSE os END END AS status, CASE WHEN oc = 'ok' THEN nh WHEN was AND seen THEN oh END AS content_hash,
        oc <> 'ok' AND was AND seen AND (oc = 'failed' OR os = 'stale') AS carried FROM j)"""
Q["generation_next"] = lambda s, d: generations.step(_previous(s, d), _attempt(s, d), True)
SQL["generation_next"] = with_sql(GEN) + "SELECT * FROM gen WHERE kind IS NOT NULL"
Q["generation_counts"] = lambda s, d: generations.counts(generations.step(_previous(s, d), _attempt(s, d), True), _attempt(s, d))
SQL["generation_counts"] = with_sql(GEN) + """SELECT (SELECT count(*) FROM att WHERE seen) AS seen, (SELECT count(*) FROM att WHERE oc = 'ok') AS converted, (SELECT count(*) FROM att WHERE oc = 'failed') AS failed,
    (SELECT count(*) FROM gen WHERE kind IS NOT NULL AND carried) AS carry_forward, (SELECT count(*) FROM gen WHERE kind = 'tombstone') AS tombstones, 'degraded' AS status"""
Q["generation_incomplete"] = lambda s, d: generations.step(_previous(s, d), _attempt(s, d), False).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("rows"))
SQL["generation_incomplete"] = with_sql(GEN) + "SELECT CASE WHEN oc = 'ok' OR was THEN 'document' ELSE 'tombstone' END AS kind, CASE WHEN oc = 'ok' THEN 'fresh' WHEN was THEN 'stale' END AS status, count(*) AS rows FROM j WHERE oc = 'ok' OR was OR (buried AND NOT seen) GROUP BY ALL"
Q["generation_disabled"] = lambda s, d: generations.step(_previous(s, d), _attempt(s, d), True, source_disabled=True)
SQL["generation_disabled"] = "SELECT 'wiki' AS source_uid, 'source_tombstone' AS kind, NULL::VARCHAR AS status, NULL::VARCHAR AS content_hash, false AS carried"
Q["contract_violations"] = lambda s, d: generations.violations(_attempt(s, d).unionByName(_attempt(s, d).where("CAST(source_uid AS INT) % 44 = 0")).unionByName(_attempt(s, d).where("CAST(source_uid AS INT) % 45 = 1").withColumn("outcome", F.lit("ok"))), _previous(s, d))
SQL["contract_violations"] = with_sql(GEN, "more AS (SELECT * FROM att UNION ALL SELECT * FROM att WHERE k % 44 = 0 UNION ALL SELECT k, 'ok', seen, nh FROM att WHERE k % 45 = 1)", "g AS (SELECT k, count(*) FILTER (oc = 'ok') AS a, count(*) FILTER (oc = 'failed') AS f, bool_or(seen) AS seen FROM more GROUP BY k)") + """SELECT source_uid, violation FROM (SELECT g.k::VARCHAR AS source_uid, CASE WHEN a > 1 THEN 'duplicate' WHEN a > 0 AND f > 0 THEN 'ok_and_failed' WHEN a + f > 0 AND NOT seen THEN 'not_seen' WHEN seen AND a + f = 0 AND (p.k IS NULL OR NOT p.doc) THEN 'unhandled_new' END AS violation FROM g LEFT JOIN prev p ON p.k = g.k) WHERE violation IS NOT NULL"""
Q["path_collisions"] = lambda s, d: generations.path_collisions(table(s, d, "pages").select(F.col("page_id").alias("source_uid"), F.concat(F.try_parse_url("url", F.lit("HOST")), F.lit(".md")).alias("path")))
SQL["path_collisions"] = "SELECT path, count(DISTINCT page_id) AS owners FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) || '.md' AS path FROM pages) GROUP BY path HAVING count(DISTINCT page_id) > 1"
Q["retention"] = lambda s, d: generations.retention(table(s, d, "events").groupBy(F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("generation_id")).agg(F.max("event_id").alias("mtime")), 3, "g1").select("generation_id")
SQL["retention"] = "WITH g AS (SELECT 'g' || user_id AS generation_id, max(event_id) AS mtime FROM events GROUP BY 1) SELECT generation_id FROM (SELECT *, row_number() OVER (ORDER BY mtime DESC, generation_id DESC) AS n FROM g) WHERE n > 3 AND generation_id <> 'g1'"


def _revisions(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", generations.revision_key(F.col("url"), F.lit(None).cast("string")).alias("revision"))


Q["changed_pages"] = lambda s, d: generations.changed_pages(_revisions(s, d), _revisions(s, d).where("page_id % 8 <> 0").withColumn("revision", F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.col("revision"))))
SQL["changed_pages"] = "SELECT page_id, url || '|null' AS revision, CASE WHEN page_id % 8 = 0 THEN 'new' ELSE 'changed' END AS change FROM pages WHERE page_id % 8 = 0 OR page_id % 3 = 0"
Q["failure_threshold"] = lambda s, d: generations.failure_threshold(_attempt(s, d), 0.5)
SQL["failure_threshold"] = with_sql(GEN) + "SELECT count(oc) AS total, count(*) FILTER (oc = 'failed') AS failed, round(count(*) FILTER (oc = 'failed') / count(oc), 6) AS rate, count(*) FILTER (oc = 'failed') / count(oc) > 0.5 AS exceeded FROM att"
Q["job_batches"] = lambda s, d: generations.job_batches(table(s, d, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.pmod("page_id", F.lit(4)).alias("space")), "space", "page_id", "bytes")
SQL["job_batches"] = f"""WITH RECURSIVE p AS (SELECT page_id % 4 AS space, page_id, octet_length(encode(coalesce(html, ''))) AS z, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS r FROM pages),
    w AS (SELECT space, 0::BIGINT AS r, 0::BIGINT AS page_id, 0 AS b, 0 AS n, 0::BIGINT AS run, false AS over FROM (SELECT DISTINCT space FROM p)
        UNION ALL SELECT p.space, p.r, p.page_id, CASE WHEN p.z > {JOB_BYTES} THEN w.b WHEN w.n > 0 AND (w.n + 1 > {JOB_PAGES} OR w.run + p.z > {JOB_BYTES}) THEN w.b + 1 ELSE w.b END,
            CASE WHEN p.z > {JOB_BYTES} THEN w.n WHEN w.n > 0 AND (w.n + 1 > {JOB_PAGES} OR w.run + p.z > {JOB_BYTES}) THEN 1 ELSE w.n + 1 END, CASE WHEN p.z > {JOB_BYTES} THEN w.run WHEN w.n > 0 AND (w.n + 1 > {JOB_PAGES} OR w.run + p.z > {JOB_BYTES}) THEN p.z ELSE w.run + p.z END, p.z > {JOB_BYTES}
        FROM w JOIN p ON p.space = w.space AND p.r = w.r + 1)
    SELECT space, page_id, CASE WHEN NOT over THEN b END AS batch FROM w WHERE r > 0"""


def _remote(s, d):
    """pages as remote pages, some repeated, some with another form of id."""
    p = table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 12 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("S"), (F.col("page_id") % 4).cast("string")).alias("space"))
    return p.unionByName(p.where("page_id % 9 = 1")).select(F.col("id").alias("page_id"), "space")


Q["page_eligibility"] = lambda s, d: generations.eligibility(_remote(s, d), ["S0", "S1", "S2"])
SQL["page_eligibility"] = "SELECT CASE WHEN page_id % 12 = 0 THEN 'x' ELSE '' END || page_id AS page_id, 'S' || page_id % 4 AS space, CASE WHEN page_id % 12 = 0 THEN 'bad_id' WHEN page_id % 4 = 3 THEN 'outside' WHEN page_id % 9 = 1 THEN 'duplicate' ELSE 'eligible' END AS state FROM pages"
Q["attachment_collisions"] = lambda s, d: generations.attachment_collisions(table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name")))
SQL["attachment_collisions"] = """SELECT page_id, lower(name) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages) GROUP BY page_id, lower(name) HAVING count(*) > 1"""


def _users(s, d):
    """Each user's last event, and the last of all."""
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp"))).alias("last")).crossJoin(F.broadcast(e.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))))  # one row


Q["catch_up_due"] = lambda s, d: _users(s, d).select("user_id", generations.catch_up_due(F.col("now"), F.col("last"), F.lit(86400)).alias("due"))
SQL["catch_up_due"] = "SELECT user_id, coalesce(floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts) FILTER (event_type <> 'error'))) >= 86400, true) AS due FROM events GROUP BY user_id"
Q["backoff_schedule"] = lambda s, d: table(s, d, "events").where("event_type = 'error'").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("attempt")).select("event_id", "attempt", F.round(generations.backoff(F.col("attempt"), 1.5, 2.0, 60.0), 6).alias("seconds"))
SQL["backoff_schedule"] = "SELECT event_id, attempt::INTEGER AS attempt, round(least(60.0::DOUBLE, 1.5::DOUBLE * pow(2.0::DOUBLE, attempt - 1)), 6) AS seconds FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events WHERE event_type = 'error')"
Q["credential_state"] = lambda s, d: table(s, d, "events").select("event_id", generations.credential_state(F.col("event_type") != "error", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")), F.to_timestamp(F.lit("2024-01-10 00:00:00")), 7 * 86400).alias("state"))
SQL["credential_state"] = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 10 = 0 THEN 'ok' WHEN floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-10') THEN 'error' WHEN floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-17') THEN 'degraded' ELSE 'ok' END AS state FROM events"
Q["index_location"] = lambda s, d: table(s, d, "pages").select("page_id", generations.index_location(F.col("url").startswith("http://"), F.contains("url", F.lit("?")), F.contains("url", F.lit("#"))).alias("state"))
SQL["index_location"] = "SELECT page_id, CASE WHEN contains(url, '#') THEN 'configured_legacy' WHEN url LIKE 'http://%' AND contains(url, '?') THEN 'conflict' WHEN url LIKE 'http://%' THEN 'required' WHEN contains(url, '?') THEN 'ready' ELSE 'empty' END AS state FROM pages"


def _configured(s, d):
    """Configured pages with the titles that the published documents give them."""
    pages = table(s, d, "pages").where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("page_id"))
    known = table(s, d, "pages").select(F.col("page_id").cast("string").alias("source_uid"), F.when(F.col("page_id") % 3 == 0, "vault").otherwise("wiki").alias("source_system"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    good = known.where("source_system = 'wiki' AND title <> ''").select(F.col("source_uid").alias("page_id"), "title")
    return pages.join(good, "page_id", "left")


Q["configured_pages"] = _configured
SQL["configured_pages"] = "SELECT page_id::VARCHAR AS page_id, CASE WHEN page_id % 3 <> 0 THEN nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') END AS title FROM pages WHERE page_id % 2 = 0"

# metrics


def _ranks(s, d, hits):
    """The rank of each benchmark passage's first hit (query_id, id, rank) whose
    document holds the passage; null without one."""
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    hits = written(hits.withColumn("path", F.split_part("id", F.lit("::"), F.lit(1))).select("query_id", "path", "rank"), "hits")
    docs = corpus.files(s, d).select("path", "text").join(F.broadcast(hits.select("path").distinct()), "path", "left_semi")  # at most 40 paths a query
    found = hits.join(b, "query_id").join(docs, "path").where(F.contains("text", F.col("passage")))
    return b.select("query_id").join(found.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def _vector_ranks(s, d):
    return _ranks(s, d, search.vector_batch(s, d).select("query_id", "id", "rank"))


def _hybrid_ranks(s, d):
    return _ranks(s, d, search.fused_batch(s, d).where("fused_rank <= 40").select("query_id", "id", F.col("fused_rank").alias("rank")))


RANKS = f"""{search.BATCH}, {search.FUSED},
    lr AS (SELECT query_id, min(rank) AS r FROM vecb JOIN benchmark b ON b.item_id = query_id JOIN files f ON f.path = split_part(id, '::', 1) WHERE contains(f.text, b.text) GROUP BY query_id),
    hr AS (SELECT query_id, min(fused_rank) AS r FROM fused JOIN benchmark b ON b.item_id = query_id JOIN files f USING (path) WHERE fused_rank <= 40 AND contains(f.text, b.text) GROUP BY query_id),
    then_ AS (SELECT item_id AS query_id, r FROM benchmark LEFT JOIN lr ON query_id = item_id), now AS (SELECT item_id AS query_id, r FROM benchmark LEFT JOIN hr ON query_id = item_id)"""
Q["retrieval_metrics"] = lambda s, d: metrics.retrieval(_hybrid_ranks(s, d))
SQL["retrieval_metrics"] = with_sql(FILES, chunks_sql(), RANKS) + "SELECT count(*) AS queries, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit1, count(*) FILTER (r <= 5) AS hits FROM now"
Q["topk_churn"] = lambda s, d: metrics.churn(_hybrid_ranks(s, d), _vector_ranks(s, d))
SQL["topk_churn"] = with_sql(FILES, chunks_sql(), RANKS) + "SELECT query_id, CASE WHEN n.r <= 5 THEN 'entered' ELSE 'left' END AS change FROM now n JOIN then_ t USING (query_id) WHERE coalesce(n.r <= 5, false) <> coalesce(t.r <= 5, false)"


def _truth(s, d):
    """What was done to each indexed file, and what the report says of it."""
    k = F.col("doc_id")
    done = corpus.indexed_files(s, d).select("path", F.when(k % 11 == 0, "missing").when(k % 7 == 0, "stale").otherwise("fresh").alias("expected"))
    return done.join(_report(s, d).select("path", F.col("status").alias("actual")), "path", "left").select("expected", "actual")


TRUTH = f"{FRESH}, tr AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'fresh' END AS expected, coalesce(r.status, '') AS actual FROM indexed LEFT JOIN rep r USING (path))"
Q["drift_prf"] = lambda s, d: metrics.drift(_truth(s, d), ["fresh", "stale", "missing", "unknown"])
SQL["drift_prf"] = with_sql(TRUTH, """l AS (SELECT unnest(['fresh', 'stale', 'missing', 'unknown']) AS label), c AS (SELECT label, count(*) FILTER (expected = label AND actual = label) AS tp, count(*) FILTER (expected <> label AND actual = label) AS fp, count(*) FILTER (expected = label AND actual <> label) AS fn FROM tr, l GROUP BY label),
    pr AS (SELECT label, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM c)""") + "SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr"
Q["false_stale_rate"] = lambda s, d: metrics.false_stale_rate(_truth(s, d))
SQL["false_stale_rate"] = with_sql(TRUTH) + "SELECT round(coalesce(avg(CASE WHEN actual = 'stale' THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS false_stale_rate, count(*) AS fresh_files FROM tr WHERE expected = 'fresh'"
Q["fragmentation"] = lambda s, d: metrics.fragmentation(base.chunks(s, d), "section", 300)
SQL["fragmentation"] = with_sql(FILES, chunks_sql()) + "SELECT section, count(*) AS chunks, count(DISTINCT path) AS files, round(count(*) / count(DISTINCT path), 3) AS chunks_per_file, round(median(length(chunk)), 3) AS median_chars, round(100.0::DOUBLE * count(*) FILTER (length(chunk) < 300) / count(*), 3) AS pct_small FROM chunks GROUP BY section"


Q["small_chunk_kinds"] = lambda s, d: metrics.small_kinds(text.talk_chunks(s, d), 300)
SQL["small_chunk_kinds"] = with_sql(text.MD, text.SECTIONS_SQL, text.MERGED_SQL, spans_sql("merged", key="k", prefix="m_"), text.PIECES_SQL, "p AS (SELECT *, count(*) OVER w AS n, max(chunk_index) OVER w AS last FROM pieces WINDOW w AS (PARTITION BY path, section_no))") + """SELECT CASE WHEN n = 1 THEN 'whole_section' WHEN chunk_index = last THEN 'split_tail' ELSE 'split_body' END AS kind, count(*) AS chunks FROM p WHERE length(chunk) < 300 GROUP BY 1"""
Q["work_avoided"] = lambda s, d: metrics.work_avoided(_plan(s, d).join(base.indexed_chunks(s, d).groupBy("path").agg(F.count(F.lit(1)).alias("full_chunks")), "path", "inner"), "added", "full_chunks")
SQL["work_avoided"] = with_sql(STATE) + "SELECT sum(added)::BIGINT AS selective, sum(o.chunks)::BIGINT AS \"full\", round(100 * (1 - sum(added)::DOUBLE / sum(o.chunks)), 3) AS avoided_pct FROM done JOIN oldn o USING (path)"
