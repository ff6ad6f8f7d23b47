"""Sources, policy, hashing, dates, chunking and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchloom.contracts import EXCLUDED_DIRS, EXCLUDED_FILES, METADATA_FIELDS
from searchloom.functions import dates, paths, text
from searchloom.operators import chunking, metadata, pdf
from searchloom.queries import base
from searchloom.queries.base import FILES, chunks_sql, rows, spans_sql, strip_sql, values_sql, with_sql
from searchloom.sources import corpus
from searchloom.sources.corpus import table

Q: dict = {}
SQL: dict[str, str] = {}

# sections and policy
SECTIONS = ("src0", "src1", "src2", "src3")
IN_LIST = ", ".join(f"'{s}'" for s in SECTIONS)
Q["list_sections"] = lambda s, d: corpus.files(s, d).where(F.col("section").isin(*SECTIONS)).select("section").distinct()
SQL["list_sections"] = with_sql(FILES) + f"SELECT DISTINCT section FROM files WHERE section IN ({IN_LIST})"
Q["section_counts"] = lambda s, d: base.chunks(s, d).groupBy("section").agg(F.count(F.lit(1)).alias("chunks"))
SQL["section_counts"] = with_sql(FILES, chunks_sql()) + "SELECT section, count(*) AS chunks FROM chunks GROUP BY section"
Q["out_of_policy"] = lambda s, d: corpus.files(s, d).select("section").distinct().join(rows(s, [(x,) for x in SECTIONS], "section string"), "section", "left_anti").where(~paths.excluded(F.concat("section", F.lit("/_probe"))))
SQL["out_of_policy"] = with_sql(FILES) + f"SELECT DISTINCT section FROM files WHERE section NOT IN ({IN_LIST})"

DIRS = ("knowledge", "_archive", ".git", "projects", "_inbox", "zzz_Corbeille")


def _odd_paths(s, d):
    """Paths under included, excluded and dot folders, by the key."""
    k = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in DIRS]), (k % len(DIRS) + 1).cast("int"))
    name = F.when(k % 9 == 0, "00_INDEX.md").otherwise(F.concat(k.cast("string"), F.lit(".md")))
    return table(s, d, "documents").select("doc_id", F.concat(folder, F.lit("/a/"), name).alias("path"))


ODD = f"odd AS (SELECT doc_id, [{', '.join(repr(x) for x in DIRS)}][doc_id % {len(DIRS)} + 1] || '/a/' || CASE WHEN doc_id % 9 = 0 THEN '00_INDEX.md' ELSE doc_id || '.md' END AS path FROM documents)"
Q["excluded_paths"] = lambda s, d: _odd_paths(s, d).where(paths.excluded(F.col("path"))).select("doc_id", "path")
SQL["excluded_paths"] = with_sql(ODD) + f"""SELECT doc_id, path FROM odd WHERE regexp_extract(path, '[^/]*$') IN ({', '.join(repr(x) for x in EXCLUDED_FILES)})
    OR split_part(path, '/', 1) IN ({', '.join(repr(x) for x in EXCLUDED_DIRS)}) OR path LIKE '.%' OR path LIKE '%/.%/%'"""
#: Expressions that both engines read: the host and path of a page's address, and paths made of them in the forms that occur.
HOST, PLACE = ("regexp_extract(url, '^https?://([^/?#]+)([^?#]*)', %d)" % i for i in (1, 2))
GIVEN = f"""CASE page_id % 9 WHEN 0 THEN {PLACE} WHEN 1 THEN concat({HOST}, {PLACE}) WHEN 2 THEN replace(concat({HOST}, {PLACE}), '/', chr(92)) WHEN 3 THEN concat('..', {PLACE})
    WHEN 4 THEN concat({HOST}, '/./', {PLACE}, '//x.md') WHEN 5 THEN concat('C:', {PLACE}) WHEN 6 THEN concat({HOST}, '/..', {PLACE}) WHEN 7 THEN '' ELSE concat({HOST}, '/.', '.b', {PLACE}, '/.') END"""


def _given(s, d, value, name, of="pages", key="page_id"):
    return table(s, d, of).select(F.col(key).alias("n"), F.expr(value).alias(name))


Q["normalize_paths"] = lambda s, d: _given(s, d, GIVEN, "given").select("n", paths.index_path(F.col("given")).alias("path"))
SQL["normalize_paths"] = f"""WITH g AS (SELECT page_id AS n, {GIVEN} AS given FROM pages), p AS (SELECT n, replace(given, '\\', '/') AS p FROM g),
    l AS (SELECT n, p, list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p)
    SELECT n, CASE WHEN p = '' OR p LIKE '/%' OR list_contains(parts, '..') THEN NULL WHEN len(parts) = 0 THEN '.' ELSE array_to_string(parts, '/') END AS path FROM l"""
Q["safe_paths"] = lambda s, d: _given(s, d, GIVEN, "given").select("n", paths.safe(F.col("given")).alias("safe"))
SQL["safe_paths"] = f"""WITH g AS (SELECT page_id AS n, {GIVEN} AS given FROM pages) SELECT n, given <> '' AND len(list_filter(string_split(given, '/'), lambda x: x IN ('', '.', '..'))) = 0
    AND NOT regexp_matches(given, '^[A-Za-z]:') AND NOT contains(given, '\\') AS safe FROM g"""
WIKI = "https://wiki.example.com"
REFERENCE = f"""CASE page_id % 8 WHEN 0 THEN cast(page_id AS varchar(20)) WHEN 1 THEN concat('{WIKI}/pages/viewpage.action?pageId=', page_id) WHEN 2 THEN concat('{WIKI}/display/S', page_id % 4, '/', {HOST}, '+Notes%20A')
    WHEN 3 THEN concat('{WIKI}/x/', {HOST}) WHEN 4 THEN url WHEN 5 THEN concat('{WIKI}/pages/viewpage.action?pageId=x', page_id) WHEN 6 THEN concat('{WIKI}/display/', {HOST}) ELSE concat('{WIKI}/x/', {HOST}, '?a=1') END"""
Q["parse_page_refs"] = lambda s, d: _given(s, d, REFERENCE, "u").select("n", paths.page_reference(F.col("u"), "https://wiki.example.com").alias("r")).select("n", "r.*")
SQL["parse_page_refs"] = f"""WITH g AS (SELECT page_id AS n, {REFERENCE} AS u FROM pages), p AS (SELECT n, u, u LIKE 'https://wiki.example.com/%' AS here, regexp_extract(u, '^https?://[^/]+([^?#]*)', 1) AS path, regexp_extract(u, '\\?(.*)$', 1) AS q FROM g),
    k AS (SELECT *, regexp_extract(q, '(?:^|&)pageId=([^&]*)', 1) AS pid, regexp_extract(path, '/display/(.*)$', 1) AS rest,
        CASE WHEN regexp_matches(u, '^[0-9]+$') THEN 'id' WHEN NOT here THEN 'invalid'
             WHEN path LIKE '%/pages/viewpage.action' THEN CASE WHEN regexp_matches(regexp_extract(q, '(?:^|&)pageId=([^&]*)', 1), '^[0-9]+$') THEN 'id' ELSE 'invalid' END
             WHEN contains(path, '/display/') THEN CASE WHEN regexp_matches(path, '/display/[^/]+/.+') THEN 'display' ELSE 'invalid' END
             WHEN regexp_matches(path, '/x/[^/]+$') AND q = '' THEN 'tiny' ELSE 'invalid' END AS kind FROM p)
    SELECT n, kind, CASE WHEN kind = 'id' THEN coalesce(nullif(regexp_extract(u, '^[0-9]+$'), ''), pid) END AS page_id,
        CASE WHEN kind = 'display' THEN url_decode(split_part(rest, '/', 1)) END AS space_key,
        CASE WHEN kind = 'display' THEN replace(url_decode(regexp_extract(rest, '^[^/]*/(.*)$', 1)), '+', ' ') END AS title FROM k"""
NAME = "concat(CASE page_id % 11 WHEN 0 THEN 'con' WHEN 1 THEN repeat('x', 300) WHEN 2 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN ':b?.txt' WHEN 2 THEN ' . ' WHEN 3 THEN '.drawio' ELSE '' END)"
Q["staged_names"] = lambda s, d: _given(s, d, NAME, "name").select("n", paths.staged_name(F.concat(F.lit("att"), F.col("n").cast("string")), F.col("name")).alias("staged"))
SQL["staged_names"] = f"""WITH g AS (SELECT page_id AS n, {NAME} AS name FROM pages), s AS (SELECT n, rtrim(regexp_replace(name, '[\\x00-\\x1f<>:"/\\\\|?*]', '_', 'g'), ' .') AS s FROM g),
    t AS (SELECT n, CASE WHEN s = '' THEN 'attachment' ELSE s END AS s FROM s), r AS (SELECT n, CASE WHEN regexp_matches(lower(split_part(s, '.', 1)), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN '_' || s ELSE s END AS s FROM t),
    e AS (SELECT n, s, regexp_extract(s, '[^.](\\.[^.]+)$', 1) AS x FROM r)
    SELECT n, 'att' || n || '-' || left(left(s, length(s) - length(x)), greatest(1, 255 - length('att' || n) - 1 - length(x))) || x AS staged FROM e"""

# hashes, dates, ids
Q["content_hashes"] = lambda s, d: corpus.files(s, d).select("path", text.content_hash(F.col("text")).alias("sha256"), text.legacy_hash(F.col("text")).alias("md5"))
SQL["content_hashes"] = with_sql(FILES) + "SELECT path, sha256(text) AS sha256, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS md5 FROM files"
DAY, CLOCK = "left(cast(ts AS varchar(30)), 10)", "concat(left(cast(ts AS varchar(30)), 10), 'T', substring(cast(ts AS varchar(30)), 12, 8))"
STAMP = f"""CASE event_id % 9 WHEN 0 THEN {DAY} WHEN 1 THEN concat({CLOCK}, 'Z') WHEN 2 THEN concat({CLOCK}, '+02:00') WHEN 3 THEN concat({CLOCK}, '.250-05:30') WHEN 4 THEN {CLOCK}
    WHEN 5 THEN event_type WHEN 6 THEN '' WHEN 7 THEN concat(left({DAY}, 5), '13-', right({DAY}, 2)) ELSE concat(' ', {DAY}, ' ') END"""
Q["normalize_dates"] = lambda s, d: _given(s, d, STAMP, "v", "events", "event_id").select("n", dates.rfc3339(F.col("v")).alias("utc"), dates.epoch_ms(dates.rfc3339(F.col("v"))).alias("epoch_ms"))
SQL["normalize_dates"] = f"""WITH g AS (SELECT event_id AS n, {STAMP} AS v FROM events), t AS (SELECT n, trim(v) AS v FROM g),
    p AS (SELECT n, CASE WHEN regexp_matches(v, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN TRY_CAST(v || ' 00:00:00+00' AS TIMESTAMPTZ) WHEN regexp_matches(v, 'T.*(Z|[+-]\\d\\d:\\d\\d)$') THEN TRY_CAST(v AS TIMESTAMPTZ) END AS ts FROM t)
    SELECT n, strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || 'Z' AS utc, epoch_ms(ts) AS epoch_ms FROM p"""
Q["chunk_ids"] = lambda s, d: base.chunks(s, d).select("id", "chunk_index", "expected_chunk_count")
SQL["chunk_ids"] = with_sql(FILES, chunks_sql()) + "SELECT id, chunk_index::INTEGER AS chunk_index, expected_chunk_count::INTEGER AS expected_chunk_count FROM chunks"
Q["id_metadata"] = lambda s, d: base.chunks(s, d).select("id", *metadata.from_id(F.col("id")))
SQL["id_metadata"] = with_sql(FILES, chunks_sql()) + "SELECT id, path, file_hash AS content_hash, 'v3' AS chunking_version, chunk_index::INTEGER AS chunk_index FROM chunks"

# chunking
Q["chunk_spans"] = lambda s, d: corpus.files(s, d).select("path", F.posexplode(chunking.spans("text")).alias("n", "x")).select("path", "n", "x.s", "x.e")
SQL["chunk_spans"] = with_sql(FILES, spans_sql("files")) + "SELECT path, i::INTEGER AS n, s::INTEGER AS s, e::INTEGER AS e FROM raw"
Q["chunk_spans_rebalanced"] = lambda s, d: corpus.files(s, d).select("path", F.posexplode(chunking.spans("text", tail=300)).alias("n", "x")).select("path", "n", "x.s", "x.e")
SQL["chunk_spans_rebalanced"] = with_sql(FILES, spans_sql("files")) + "SELECT path, i::INTEGER AS n, s::INTEGER AS s, e::INTEGER AS e FROM spans"
Q["chunk_texts"] = lambda s, d: base.chunks(s, d).select("path", "chunk_index", F.length("chunk").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("md5"))
SQL["chunk_texts"] = with_sql(FILES, chunks_sql()) + "SELECT path, chunk_index::INTEGER AS chunk_index, length(chunk)::INTEGER AS chars, md5(chunk) AS md5 FROM chunks"
Q["chunk_ordinals"] = lambda s, d: base.chunks(s, d).groupBy("path").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count(F.lit(1)).alias("chunks"))
SQL["chunk_ordinals"] = with_sql(FILES, chunks_sql()) + "SELECT path, min(chunk_index)::INTEGER AS first, max(chunk_index)::INTEGER AS last, count(*) AS chunks FROM chunks GROUP BY path"


def _coverage(s, d):
    x = F.col("x")
    sp = corpus.files(s, d).select("path", F.length("text").alias("n"), chunking.spans("text", tail=300).alias("x"))
    gaps = F.exists(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: F.coalesce((F.get(x, i)["s"] > F.get(x, i - 1)["e"]) | (F.get(x, i)["s"] <= F.get(x, i - 1)["s"]), F.lit(False)))
    return sp.agg(F.count(F.lit(1)).alias("files"), F.count_if((F.size(x) > 0) & ((x[0]["s"] != 0) | (F.element_at(x, -1)["e"] != F.col("n")) | gaps)).alias("broken"))


Q["span_coverage"] = _coverage
SQL["span_coverage"] = with_sql(FILES) + "SELECT count(*) AS files, 0::BIGINT AS broken FROM files"
MD = """md AS (SELECT conv_id, 'talks/' || conv_id || '.md' AS path, '---' || chr(10) || 'title: "Conversation ' || conv_id || '"' || chr(10) || 'author: user ' || conv_id || chr(10) || 'date: 2024-05-06' || chr(10) || 'title: "Talk ' || conv_id || '"' || chr(10) || '---' || chr(10) || chr(10) || '# Conversation ' || conv_id || chr(10)
    || string_agg('## turn ' || turn || ' ' || role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
Q["frontmatter_map"] = lambda s, d: corpus.markdown(s, d).select("path", F.explode(chunking.front_matter(F.col("text"))).alias("key", "raw")).select("path", "key", chunking.scalar(F.col("raw")).alias("value"))
SQL["frontmatter_map"] = with_sql(MD) + "SELECT path, k AS key, CASE k WHEN 'title' THEN 'Talk ' || conv_id WHEN 'author' THEN 'user ' || conv_id ELSE '2024-05-06' END AS value FROM md, (SELECT unnest(['title', 'author', 'date']) AS k)"
Q["header_sections"] = lambda s, d: corpus.markdown(s, d).select("path", F.posexplode(chunking.header_sections(chunking.body(F.col("text")))).alias("n", "x")).select("path", "n", "x.header", F.md5(F.col("x.span").cast("binary")).alias("span_md5"))
SECTIONS_SQL = """body AS (SELECT path, conv_id, substr(text, strpos(text, chr(10) || '---') + 6) AS b FROM md),
    lines AS (SELECT path, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS ln, len(string_split(b, chr(10))) AS total FROM body),
    marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3} .') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) - 1 AS n FROM lines),
    sections AS (SELECT path, n, trim(first(line ORDER BY ln)) AS header, string_agg(line || CASE WHEN ln < total THEN chr(10) ELSE '' END, '' ORDER BY ln) AS span FROM marked GROUP BY path, n)"""
SQL["header_sections"] = with_sql(MD, SECTIONS_SQL) + "SELECT path, n, header, md5(span) AS span_md5 FROM sections"
Q["merge_sections"] = lambda s, d: corpus.markdown(s, d).select("path", F.posexplode(chunking.merge_sections(chunking.header_sections(chunking.body(F.col("text"))))).alias("n", "x")).select("path", "n", "x.header", F.length("x.span").alias("chars"))
SQL["merge_sections"] = with_sql(MD, SECTIONS_SQL, """walk AS (SELECT path, n, 0::BIGINT AS g, length(span)::BIGINT AS run FROM sections WHERE n = 0
        UNION ALL SELECT s.path, s.n, CASE WHEN w.run >= 300 THEN w.g + 1 ELSE w.g END, CASE WHEN w.run >= 300 THEN length(s.span) ELSE w.run + length(s.span) END FROM walk w JOIN sections s ON s.path = w.path AND s.n = w.n + 1),
    ends AS (SELECT path, g, max(run) AS total FROM walk GROUP BY path, g),
    fixed AS (SELECT w.path, w.n, CASE WHEN e.total < 300 AND w.g > 0 THEN w.g - 1 ELSE w.g END AS g FROM walk w JOIN ends e USING (path, g)),
    heads AS (SELECT f.path, f.g, s.header, min(f.n) AS first_n FROM fixed f JOIN sections s USING (path, n) WHERE s.header <> '' GROUP BY ALL),
    sizes AS (SELECT f.path, f.g, sum(length(s.span)) AS chars FROM fixed f JOIN sections s USING (path, n) GROUP BY ALL)""") + """SELECT path, g::INTEGER AS n, left((SELECT string_agg(header, ' | ' ORDER BY first_n) FROM heads h WHERE h.path = z.path AND h.g = z.g), 300) AS header, chars::INTEGER AS chars FROM sizes z"""

#: Each merged section's text, its spans, and the files' chunks in order.
MERGED_SQL = """walk AS (SELECT path, n, 0::BIGINT AS g, length(span)::BIGINT AS run FROM sections WHERE n = 0
        UNION ALL SELECT s.path, s.n, CASE WHEN w.run >= 300 THEN w.g + 1 ELSE w.g END, CASE WHEN w.run >= 300 THEN length(s.span) ELSE w.run + length(s.span) END FROM walk w JOIN sections s ON s.path = w.path AND s.n = w.n + 1),
    ends AS (SELECT path, g, max(run) AS total FROM walk GROUP BY path, g),
    fixed AS (SELECT w.path, w.n, CASE WHEN e.total < 300 AND w.g > 0 THEN w.g - 1 ELSE w.g END AS g FROM walk w JOIN ends e USING (path, g)),
    firsts AS (SELECT f.path, f.g, s.header, min(f.n) AS n FROM fixed f JOIN sections s USING (path, n) WHERE s.header <> '' GROUP BY ALL),
    heads AS (SELECT path, g, left(string_agg(header, ' | ' ORDER BY n), 300) AS header FROM firsts GROUP BY ALL),
    merged AS (SELECT f.path, f.g, f.path || '#' || f.g AS k, string_agg(s.span, '' ORDER BY f.n) AS text FROM fixed f JOIN sections s USING (path, n) GROUP BY ALL)"""
PIECES_SQL = f"""cutm AS (SELECT k, i, {strip_sql('substr(text, s + 1, e - s)')} AS chunk FROM m_spans),
    pieces AS (SELECT m.path, m.g AS section_no, h.header, chunk, row_number() OVER (PARTITION BY m.path ORDER BY m.g, i) - 1 AS chunk_index FROM cutm JOIN merged m USING (k) LEFT JOIN heads h ON h.path = m.path AND h.g = m.g WHERE chunk <> '')"""


def talk_chunks(s, d):
    return chunking.chunk_files(corpus.markdown(s, d))


Q["markdown_chunks"] = lambda s, d: talk_chunks(s, d).select("path", "section_no", "chunk_index", "header", F.md5(F.col("chunk").cast("binary")).alias("md5"))
SQL["markdown_chunks"] = with_sql(MD, SECTIONS_SQL, MERGED_SQL, spans_sql("merged", key="k", prefix="m_"), PIECES_SQL) + "SELECT path, section_no::INTEGER AS section_no, chunk_index::INTEGER AS chunk_index, coalesce(header, '') AS header, md5(chunk) AS md5 FROM pieces"

# metadata
CAPTURED = "2024-07-01T00:00:00Z"


def _contract(s, d):
    m = corpus.markdown(s, d)
    fields = metadata.contract(chunking.front_matter(F.col("text")), F.col("path"), paths.section_of(F.col("path")), F.lit("untitled"), text.content_hash(F.col("text")), F.lit(CAPTURED))
    return m.select(*fields)


Q["contract_metadata"] = _contract
SQL["contract_metadata"] = with_sql(MD) + f"""SELECT 2 AS schema_version, 'note' AS source_kind, 'vault' AS source_system, path AS source_uid, 'talks' AS container_uid, 'Talk ' || conv_id AS title, 'user ' || conv_id AS author,
    '2024-05-06T00:00:00Z' AS occurred_at, NULL::VARCHAR AS updated_at, NULL::VARCHAR AS canonical_uri, path, 'talks' AS section, '{CAPTURED}' AS captured_at, sha256(text) AS content_hash, NULL::INTEGER AS chunk_index FROM md"""


def _rendered(s, d):
    p = table(s, d, "pages").select(F.col("page_id").cast("string").alias("k"), "url", F.coalesce("html", F.lit("")).alias("html"))
    f = {"schema_version": F.lit(2), "source_kind": F.lit("doc"), "source_system": F.lit("wiki"), "source_uid": F.col("k"), "container_uid": F.lit("ENG"), "title": F.concat(F.lit('Page "'), F.col("k"), F.lit('"')), "canonical_uri": F.lit(None).cast("string"), "path": F.concat(F.col("k"), F.lit(".md")), "captured_at": F.lit(CAPTURED)}
    return p.select("k", F.md5(metadata.render_document(f, F.col("html")).cast("binary")).alias("md5"))


Q["render_frontmatter"] = _rendered
SQL["render_frontmatter"] = f"""WITH p AS (SELECT page_id::VARCHAR AS k, regexp_replace(replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\n+|\\n+$', '', 'g') || chr(10) AS b FROM pages)
    SELECT k, md5(array_to_string(['---', 'schema_version: 2', 'source_kind: "doc"', 'source_system: "wiki"', 'source_uid: "' || k || '"', 'container_uid: "ENG"', 'title: "Page \\"' || k || '\\""', 'author: null', 'occurred_at: null', 'updated_at: null',
        'canonical_uri: null', 'path: "' || k || '.md"', 'section: null', 'captured_at: "{CAPTURED}"', 'content_hash: "' || sha256(b) || '"', 'chunk_index: null', '---', b], chr(10))) AS md5 FROM p"""
Q["storage_metadata"] = lambda s, d: metadata.storage(_contract(s, d)).select("path", "occurred_at_epoch_ms", "updated_at_epoch_ms")
SQL["storage_metadata"] = with_sql(MD) + "SELECT path, 1714953600000::BIGINT AS occurred_at_epoch_ms, NULL::BIGINT AS updated_at_epoch_ms FROM md"


def _eav(s, d):
    f = corpus.files(s, d)
    none = lambda k: F.lit(None).cast(k)
    one = lambda key, sv=None, iv=None, bv=None: f.select(F.col("doc_id").alias("id"), F.lit(key).alias("key"), (sv if sv is not None else none("string")).alias("string_value"), (iv if iv is not None else none("long")).alias("int_value"), none("double").alias("float_value"), (bv if bv is not None else none("boolean")).alias("bool_value"))
    stored = base.union([one("path", F.col("path")), one("schema_version", None, F.col("schema_version").cast("long")), one("even", None, None, F.col("doc_id") % 2 == 0)])
    return metadata.eav_pivot(stored, ["path", "schema_version", "even"])


Q["eav_pivot"] = _eav
SQL["eav_pivot"] = with_sql(FILES) + "SELECT doc_id AS id, path, schema_version::VARCHAR AS schema_version, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM files"
assert len(METADATA_FIELDS) == 15 and strip_sql


def _as_pdf(s, d):
    """documents as files of pages, one a line."""
    return corpus.files(s, d).select(F.regexp_replace("path", r"\.md$", ".pdf").alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").alias("size_bytes"))


Q["pdf_chunks"] = lambda s, d: pdf.pdf_chunks(_as_pdf(s, d), lambda raw: raw.decode().split("\n"), F.lit(CAPTURED)).select("path", "status", "title", "source_kind", "content_hash", "file_hash", "header", "chunk_index", "expected_chunk_count", "id", F.md5(F.col("chunk").cast("binary")).alias("md5"))
SQL["pdf_chunks"] = with_sql(
    FILES,
    "pdfs AS (SELECT doc_id, regexp_replace(path, '[.]md$', '.pdf') AS path, text FROM files)",
    f"pages_ AS (SELECT path, page, path || '#' || page AS k, {strip_sql('t')} AS text FROM (SELECT path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM pdfs) WHERE {strip_sql('t')} <> '')",
    spans_sql("pages_", key="k", prefix="p_"),
    f"cutp AS (SELECT path, page, i, {strip_sql('substr(s.text, s + 1, e - s)')} AS chunk FROM p_spans s JOIN pages_ USING (k))",
    "numbered AS (SELECT path, page, chunk, row_number() OVER (PARTITION BY path ORDER BY page, i) - 1 AS n, count(*) OVER (PARTITION BY path) AS total FROM cutp WHERE chunk <> '')",
    "whole AS (SELECT path, md5(string_agg(text, chr(10) ORDER BY page)) AS file_hash FROM pages_ GROUP BY path)",
) + """SELECT f.path, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status, CASE WHEN n IS NOT NULL THEN f.doc_id::VARCHAR END AS title, 'doc' AS source_kind,
    CASE WHEN n IS NOT NULL THEN sha256(f.text) END AS content_hash, file_hash, 'Page ' || page AS header, n::INTEGER AS chunk_index, total::INTEGER AS expected_chunk_count, f.path || '::' || sha256(f.text) || '::v3::' || n AS id, md5(chunk) AS md5
    FROM pdfs f LEFT JOIN numbered USING (path) LEFT JOIN whole USING (path)"""
