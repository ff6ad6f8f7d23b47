"""Remote pages converted and published; a store's backup."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchloom.contracts import JOB_BYTES
from searchloom.operators import convert
from searchloom.plans import backup, ingest, repair
from searchloom.queries import base, state
from searchloom.queries.base import FILES, chunks_sql, with_sql
from searchloom.sources.corpus import table
from searchloom.sources.generation import Generations
from searchloom.sources.scratch import file_system, shared_path, swept, written

Q: dict = {}
SQL: dict[str, str] = {}


def converted_sql(source: str, name: str) -> str:
    """A CTE {name} (k, outcome, error_code, title, text) of source (k, html), for the
    tags and entities that pages have."""
    entities = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    body = r"regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')"
    linked = rf"""regexp_replace({body}, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g')"""
    marked = f"replace(replace({linked}, '<li>', chr(1) || '- '), '<h1>', chr(1) || '# ')"
    cut = f"regexp_replace({marked}, '</?(html|body|nav|ul|li|div|article|h1|p|footer)( [^>]*)?>', chr(1), 'g')"
    plain = entities(f"regexp_replace(replace({cut}, '<br>', chr(2)), '</?b>', '', 'g')")
    title = entities(r"regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[ \t\n\r\f]+', ' ', 'g')")
    return f"""{name} AS (SELECT k, CASE WHEN html IS NOT NULL AND strlen(html) <= {JOB_BYTES} AND t <> '' THEN 'ok' ELSE 'failed' END AS outcome,
        CASE WHEN html IS NULL THEN 'no_content' WHEN strlen(html) > {JOB_BYTES} THEN 'too_large' WHEN t = '' THEN 'empty' END AS error_code,
        CASE WHEN strlen(html) <= {JOB_BYTES} THEN nullif(trim({title}), '') END AS title, CASE WHEN strlen(html) <= {JOB_BYTES} THEN nullif(t, '') END AS text
        FROM (SELECT k, html, array_to_string(list_transform(b, lambda x, i: CASE WHEN i = 1 THEN '' WHEN starts_with(x, '- ') AND starts_with(b[i - 1], '- ') THEN chr(10) ELSE chr(10) || chr(10) END || x), '') AS t
            FROM (SELECT k, html, list_filter(list_transform(string_split({plain}, chr(1)), lambda x: trim(regexp_replace(x, ' *' || chr(2) || ' *', chr(10), 'g'), ' ' || chr(10))), lambda x: x NOT IN ('', '-', '#')) AS b FROM {source})))"""


def _digest(c: str):
    return F.md5(F.col(c).cast("binary")).alias("md5")


def _converted(s, d):
    return convert.convert(table(s, d, "pages").select("page_id", "html"))


Q["converted_pages"] = lambda s, d: _converted(s, d).select("page_id", "outcome", "error_code", "title", _digest("text"))
SQL["converted_pages"] = with_sql(converted_sql("(SELECT page_id AS k, html FROM pages)", "conv")) + "SELECT k AS page_id, outcome, error_code, title, md5(text) AS md5 FROM conv"


def _jobs(s, d):
    pages = table(s, d, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.pmod("page_id", F.lit(4)).alias("space"))
    return convert.job_report(pages, written(_converted(s, d).select("page_id", "outcome", "error_code"), "outcomes"), "space", "page_id", "bytes")


Q["conversion_jobs"] = _jobs
SQL["conversion_jobs"] = state.SQL["job_batches"].replace("SELECT space, page_id, CASE WHEN NOT over THEN b END AS batch FROM w WHERE r > 0", "").rstrip() + f""",
    {converted_sql("(SELECT page_id AS k, html FROM pages)", "conv")}
    SELECT space, CASE WHEN NOT over THEN b END AS batch, count(*) AS pages, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'failed') AS failed, min(error_code) AS first_error
    FROM w JOIN conv ON conv.k = w.page_id WHERE r > 0 GROUP BY ALL"""


def _published(s, d):
    """Two runs of a source: some pages appear, some change, fail or go."""
    k = F.col("page_id")
    pages = table(s, d, "pages").where("page_id IS NOT NULL").select("page_id", k.cast("string").alias("source_uid"), F.concat(F.lit("wiki/"), k.cast("string"), F.lit(".md")).alias("path"), "html")
    root = shared_path(s, "generations")
    ingest.run(s, root, pages.where(k % 6 != 0))
    ingest.run(s, root, pages.where(k % 10 != 0).withColumn("html", F.when(k % 4 == 0, F.concat("html", F.lit("<p>more</p>"))).when(k % 11 != 1, F.col("html"))))
    found = Generations(s, root)
    documents = found.rows("documents").select("source_uid", F.lit("document").alias("kind"), "path", "status", _digest("text"))
    return documents.unionByName(found.rows("tombstones"), allowMissingColumns=True)


Q["published_generation"] = _published
SQL["published_generation"] = with_sql(
    converted_sql("(SELECT page_id AS k, html FROM pages WHERE page_id % 6 <> 0)", "c1"),
    converted_sql("(SELECT page_id AS k, CASE WHEN page_id % 4 = 0 THEN html || '<p>more</p>' WHEN page_id % 11 <> 1 THEN html END AS html FROM pages WHERE page_id % 10 <> 0)", "c2"),
    "old AS (SELECT * FROM c1 WHERE outcome = 'ok')",
) + """SELECT coalesce(o.k, n.k)::VARCHAR AS source_uid, CASE WHEN n.k IS NULL THEN 'tombstone' ELSE 'document' END AS kind, CASE WHEN n.k IS NOT NULL THEN 'wiki/' || n.k || '.md' END AS path,
    CASE n.outcome WHEN 'ok' THEN 'fresh' WHEN 'failed' THEN 'stale' END AS status, CASE n.outcome WHEN 'ok' THEN md5(n.text) WHEN 'failed' THEN md5(o.text) END AS md5
    FROM old o FULL JOIN c2 n ON o.k = n.k WHERE o.k IS NOT NULL OR n.outcome = 'ok'"""


def _restored(s, d):
    """The index's chunks as they are in a store restored from a backup of it."""
    copy = shared_path(s, "backup")
    backup.backup(base.index(s, d).store, copy)
    store = backup.restore(s, copy, shared_path(s, "restored"))
    path, fs = file_system(s, copy)
    fs.delete(path, True)
    return store.table("chunks").groupBy("section").agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


Q["restored_index"] = _restored
SQL["restored_index"] = with_sql(FILES, chunks_sql()) + "SELECT section, count(DISTINCT path) AS files, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM chunks GROUP BY section"


def _health(s, d):
    """The index's tables of one row a chunk, with their parts that are damaged or
    whose ids diverge. The ids of one table after the other are told apart, so that
    the disk holds one table's at a time."""
    names = ("chunks", "forward", "vectors")
    store = base.index(s, d, *names).store
    damaged, tables = store.damaged(), []
    for n in names:
        ids = store.table(n).agg(F.count_distinct("id")).head()[0]
        swept(s)
        tables.append((n, store.meta()["tables"][n]["rows"], ids, len(damaged.get(n, ()))))
    apart = repair.diverging(store).groupBy("table").agg(F.count(F.lit(1)).alias("diverging"))
    told = base.rows(s, tables, "table string, rows long, ids long, damaged long")
    return told.join(apart, "table", "left").select("table", "rows", "ids", "damaged", F.coalesce("diverging", F.lit(0)).alias("diverging"))


Q["index_health"] = _health
SQL["index_health"] = with_sql(FILES, chunks_sql()) + "SELECT t AS table, count(*) AS rows, count(DISTINCT id) AS ids, 0::BIGINT AS damaged, 0::BIGINT AS diverging FROM chunks, (SELECT unnest(['chunks', 'forward', 'vectors']) AS t) GROUP BY t"
