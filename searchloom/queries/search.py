"""Filters, lexical and vector search, fusion and the hybrid plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchloom.contracts import CANDIDATES
from searchloom.functions.text import content_hash, index_tokens, query_tokens
from searchloom.operators import filters, fusion, lexical, metadata, vector
from searchloom.plans import response
from searchloom.plans import search as plans
from searchloom.queries import base
from searchloom.queries.base import FILES, QUERY, QUERY_VECTOR_ID, chunks_sql, embedding_sql, rows, tokens_sql, values_sql, with_sql
from searchloom.sources import corpus
from searchloom.sources.corpus import table

Q: dict = {}
SQL: dict[str, str] = {}

# filters
CASES = {
    "filter_section_kind": (dict(section="src3", source_kinds=["note", " note", "doc"]), "section = 'src3' AND source_kind IN ('note', 'doc') AND schema_version = 2"),
    "filter_author": (dict(authors=["FR", "ES"]), "author IN ('FR', 'ES') AND schema_version = 2"),
    "filter_time_range": (dict(occurred_from="2024-01-05", occurred_to="2024-01-20T12:00:00+00:00"), "occurred_ms BETWEEN 1704412800000 AND 1705752000000 AND schema_version = 2"),
    "filter_all": (dict(section="src1", source_kinds=["message"], authors=["EN"], occurred_from="2024-01-02", updated_to="2024-03-01T00:00:00Z"), "section = 'src1' AND source_kind = 'message' AND author = 'EN' AND occurred_ms >= 1704153600000 AND updated_ms <= 1709251200000 AND schema_version = 2"),
}


def _filter_query(given):
    return lambda s, d: corpus.files(s, d).where(filters.plan(**given)).select("path", "source_kind", "author", "occurred_ms", "updated_ms")


for _name, (_given, _sql) in CASES.items():
    Q[_name] = _filter_query(_given)
    SQL[_name] = with_sql(FILES) + f"SELECT path, source_kind, author, occurred_ms, updated_ms FROM files WHERE {_sql}"

# lexical
ASKS = "concat(chr(34), text, chr(34), ' * NEAR(', item_id, '_x) - caf', chr(233), ' ', CASE WHEN item_id % 7 = 0 THEN '' ELSE '*-' END)"
Q["query_tokens"] = lambda s, d: table(s, d, "benchmark").select("item_id", F.expr(ASKS).alias("q")).select("item_id", F.concat_ws(" OR ", F.transform(query_tokens(F.col("q")), lambda t: F.concat(F.lit('"'), t, F.lit('"')))).alias("match"))
SQL["query_tokens"] = f"""WITH g AS (SELECT item_id, {ASKS} AS q FROM benchmark) SELECT item_id, array_to_string(list_transform(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda t: '"' || t || '"'), ' OR ') AS match FROM g"""
Q["postings_stats"] = lambda s, d: base.index(s, d, "terms").terms()
SQL["postings_stats"] = with_sql(FILES, chunks_sql(), f"t AS (SELECT id, unnest({tokens_sql('chunk')}) AS term FROM chunks)") + "SELECT term, count(DISTINCT id) AS chunks, count(*)::BIGINT AS occurrences FROM t GROUP BY term"


def bm25_sql(phrases: list[list[str]], where: str = "true", limit: int = CANDIDATES) -> str:
    """CTEs up to lex: (id, bm25, rank) and the chunks' columns."""
    def count(p):
        if len(p) == 1:
            return f"len(list_filter(t, lambda x: x = '{p[0]}'))"
        tests = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len(t) + 1), lambda i: coalesce({tests}, false)))"

    distinct = list(dict.fromkeys(map(tuple, phrases)))
    tf = ", ".join(f"{count(p)} AS tf{i}" for i, p in enumerate(distinct))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(distinct)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) * {sum(tuple(q) == p for q in phrases)}" for i, p in enumerate(distinct))
    return f"""toks AS (SELECT *, {tokens_sql('chunk')} AS t FROM chunks), tfs AS (SELECT * EXCLUDE (t), len(t) AS dl, {tf} FROM toks), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM tfs),
    scored AS (SELECT tfs.*, -({score}) AS bm25 FROM tfs, stats WHERE ({' OR '.join(f'tf{i} > 0' for i in range(len(distinct)))}) AND {where}),
    lex AS (SELECT *, row_number() OVER (ORDER BY round(bm25, 9), id) AS rank FROM scored QUALIFY rank <= {limit})"""


PHRASES = [[w] for w in QUERY.split()]
Q["bm25_topk"] = lambda s, d: base.index(s, d, *base.LEXICAL).lexical(PHRASES).select("id", F.round("bm25", 6).alias("bm25"))
SQL["bm25_topk"] = with_sql(FILES, chunks_sql(), bm25_sql(PHRASES)) + "SELECT id, round(bm25, 6) AS bm25 FROM lex"
Q["bm25_filtered"] = lambda s, d: base.index(s, d, *base.LEXICAL).lexical(PHRASES, filters.plan(source_kinds=["note"])).select("id", F.round("bm25", 6).alias("bm25"))
SQL["bm25_filtered"] = with_sql(FILES, chunks_sql(), bm25_sql(PHRASES, "source_kind = 'note' AND schema_version = 2")) + "SELECT id, round(bm25, 6) AS bm25 FROM lex"
PHRASE = [["of", "the"], ["idiot"], ["idiot"]]
Q["bm25_phrase"] = lambda s, d: base.index(s, d, *base.LEXICAL).lexical(PHRASE).select("id", F.round("bm25", 6).alias("bm25"))
SQL["bm25_phrase"] = with_sql(FILES, chunks_sql(), bm25_sql(PHRASE)) + "SELECT id, round(bm25, 6) AS bm25 FROM lex"


def _batch_terms(s, d):
    """The tokens of each benchmark passage as a query."""
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), index_tokens(F.col("text")).alias("t"))
    return b.select("query_id", F.explode("t").alias("term"))


def lexical_batch(s, d):
    x = base.index(s, d, "forward", "terms", "sizes")
    return lexical.bm25_batch(x.table("forward"), x.terms(), x.stats(), _batch_terms(s, d))


BATCH = f"""terms AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark), wanted AS (SELECT query_id, term, count(*) AS times FROM terms GROUP BY ALL),
    occ AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM (SELECT id, {tokens_sql('chunk')} AS t FROM chunks)), tf AS (SELECT term, id, dl, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len({tokens_sql('chunk')})) AS avgdl FROM chunks), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    wt AS (SELECT query_id, term, times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS w, avgdl FROM wanted JOIN df USING (term), st),
    sc AS (SELECT query_id, id, -sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN wt USING (term) GROUP BY ALL),
    lexb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), id) AS rank FROM sc QUALIFY rank <= 40)"""
Q["bm25_batched"] = lambda s, d: lexical_batch(s, d).select("query_id", "id", "rank", F.round("bm25", 6).alias("bm25"))
SQL["bm25_batched"] = with_sql(FILES, chunks_sql(), BATCH) + "SELECT query_id, id, rank::INTEGER AS rank, round(bm25, 6) AS bm25 FROM lexb"

# vectors


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(s, d) -> list[float]:
    """One row: a search's own query vector."""
    row = table(s, d, "embeddings").where(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").head()
    return [float(x) for x in row[0]]


VEC = "SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
DIST = f"vec AS ({VEC}), qv AS (SELECT v AS q FROM vec WHERE id = {QUERY_VECTOR_ID}), dist AS (SELECT id, label, 1 - list_cosine_similarity(v, q) AS distance FROM vec, qv)"
Q["vector_topk"] = lambda s, d: vector.topk(_vectors(s, d), _query_vector(s, d)).select("id", F.round("distance", 6).alias("distance"))
SQL["vector_topk"] = f"WITH {DIST} SELECT id, round(distance, 6) AS distance FROM dist ORDER BY round(distance, 9), id LIMIT 40"
Q["vector_filtered"] = lambda s, d: vector.topk(_vectors(s, d), _query_vector(s, d), F.col("label") == 1).select("id", F.round("distance", 6).alias("distance"))
SQL["vector_filtered"] = f"WITH {DIST} SELECT id, round(distance, 6) AS distance FROM dist WHERE label = 1 ORDER BY round(distance, 9), id LIMIT 40"
Q["vector_batched"] = lambda s, d: vector.topk_batch(_vectors(s, d), _vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))
SQL["vector_batched"] = f"""WITH vec AS ({VEC}), dist AS (SELECT q.id AS query_id, v.id AS id, 1 - list_cosine_similarity(v.v, q.v) AS distance FROM vec v, vec q WHERE q.id % 100 = 0)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id)::INTEGER AS rank, round(distance, 6) AS distance FROM dist QUALIFY rank <= 10"""
# approximate: the cells that a query has to probe for a recall of 0.95 are measured when they are laid out
Q["vector_probed"] = lambda s, d: base.vector_index(s, d).vector_batch(_vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10, base.vector_index(s, d).probes()).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))
Q["chunk_vectors"] = lambda s, d: base.index(s, d, "vectors").table("vectors").select("id", "chunk_hash", F.transform("vector", lambda x: x.cast("int")).alias("vector"))
SQL["chunk_vectors"] = with_sql(FILES, chunks_sql(), embedding_sql("chunks", "emb", "id", "chunk")) + "SELECT id, sha256(chunk) AS chunk_hash, list_transform(v, lambda x: x::INTEGER) AS vector FROM emb JOIN chunks USING (id)"
Q["hash_embedding"] = lambda s, d: table(s, d, "benchmark").select("item_id", F.posexplode(vector.hash_embedding(F.col("text"))).alias("slot", "weight"))
SQL["hash_embedding"] = f"""WITH t AS (SELECT item_id, unnest({tokens_sql('text')}) AS tok FROM benchmark), c AS (SELECT item_id, ('0x' || left(md5(tok), 8))::BIGINT % 16 AS slot, count(*) AS n FROM t GROUP BY ALL)
    SELECT b.item_id, s.slot::INTEGER AS slot, coalesce(c.n, 0)::DOUBLE AS weight FROM benchmark b CROSS JOIN (SELECT unnest(range(16)) AS slot) s LEFT JOIN c ON c.item_id = b.item_id AND c.slot = s.slot"""

# fusion


def _two_searches(s, d):
    """Two vectors' searches as the branches of one."""
    q = _vectors(s, d).where("id < 2").select(F.col("id").alias("query_id"), "vector")
    return vector.topk_batch(_vectors(s, d), q).select(F.when(F.col("query_id") == 0, "vector").otherwise("lexical").alias("branch"), "rank", "id")


Q["rrf_fusion"] = lambda s, d: fusion.rrf(_two_searches(s, d)).select("id", F.round("rrf", 9).alias("rrf"), "best_rank", "lexical_only", "fused_rank")
SQL["rrf_fusion"] = f"""WITH vec AS ({VEC}), di AS (SELECT q.id AS q, v.id AS id, 1 - list_cosine_similarity(v.v, q.v) AS distance FROM vec v, vec q WHERE q.id < 2),
    b AS (SELECT CASE q WHEN 0 THEN 'vector' ELSE 'lexical' END AS branch, id, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), id) AS rank FROM di QUALIFY rank <= 40),
    g AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank, NOT bool_or(branch = 'vector') AS lexical_only FROM b GROUP BY id)
    SELECT id, round(rrf, 9) AS rrf, best_rank::INTEGER AS best_rank, lexical_only, row_number() OVER (ORDER BY round(rrf, 12) DESC, best_rank, id)::INTEGER AS fused_rank FROM g"""


def vector_batch(s, d):
    """The nearest chunks of each benchmark passage as a query."""
    queries = vector.embed(table(s, d, "benchmark"), vector.HASH, "text").select(F.col("item_id").alias("query_id"), "vector")
    return base.index(s, d, "vectors").vector_batch(queries)


def _batched_branches(s, d):
    """Lexical and vector hits of each benchmark passage as a query, over all chunks."""
    v = vector_batch(s, d).select("query_id", F.lit("vector").alias("branch"), "rank", "id")
    return v.unionByName(lexical_batch(s, d).select("query_id", F.lit("lexical").alias("branch"), "rank", "id"))


def fused_batch(s, d):
    fused = fusion.rrf(_batched_branches(s, d), by=("query_id",))
    return fused.withColumn("path", F.split_part("id", F.lit("::"), F.lit(1)))


FUSED = f"""{embedding_sql('chunks', 'emb', 'id', 'chunk')}, {embedding_sql('benchmark', 'bq', 'item_id', 'text')},
    bd AS (SELECT item_id AS query_id, id, 1 - list_cosine_similarity(emb.v, bq.v) AS distance FROM emb, bq WHERE list_sum(emb.v) > 0 AND list_sum(bq.v) > 0),
    vecb AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM bd QUALIFY rank <= 40),
    both_ AS (SELECT query_id, 'vector' AS branch, rank, id FROM vecb UNION ALL SELECT query_id, 'lexical', rank, id FROM lexb),
    fg AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank FROM both_ GROUP BY ALL),
    fused AS (SELECT *, split_part(id, '::', 1) AS path, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, best_rank, id) AS fused_rank FROM fg)"""
Q["rrf_batched"] = lambda s, d: fused_batch(s, d).where("fused_rank <= 10").select("query_id", "id", "fused_rank", F.round("rrf", 9).alias("rrf"))
SQL["rrf_batched"] = with_sql(FILES, chunks_sql(), BATCH, FUSED) + "SELECT query_id, id, fused_rank::INTEGER AS fused_rank, round(rrf, 9) AS rrf FROM fused WHERE fused_rank <= 10"
Q["path_cap"] = lambda s, d: fusion.cap_per_path(fused_batch(s, d), 1, 10).select("query_id", "id", "capped_rank")
SQL["path_cap"] = with_sql(FILES, chunks_sql(), BATCH, FUSED, """pc AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY fused_rank) AS nth FROM fused),
    seats AS (SELECT query_id, id FROM pc WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) <= 10)""") + """SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY (s.id IS NULL), fused_rank)::INTEGER AS capped_rank
    FROM pc p LEFT JOIN seats s ON s.query_id = p.query_id AND s.id = p.id"""
Q["path_multiplicity"] = lambda s, d: fusion.multiplicity(fused_batch(s, d), 20)
SQL["path_multiplicity"] = with_sql(FILES, chunks_sql(), BATCH, FUSED) + "SELECT query_id, max(n) AS multiplicity FROM (SELECT query_id, path, count(*) AS n FROM fused WHERE fused_rank <= 20 GROUP BY ALL) GROUP BY query_id"

# the hybrid plan


def _hybrid(s, d, reranker=True, problem=None):
    score = fusion.overlap_score(QUERY.split()) if reranker else None
    x = base.index(s, d, *(base.NEAREST if problem else base.HYBRID))
    return plans.search(x, PHRASES, x.embed(QUERY), 10, None, score, problem)


HYBRID = bm25_sql(PHRASES) + f""", {embedding_sql('chunks', 'emb', 'id', 'chunk')}, {embedding_sql(f"(SELECT '{QUERY}' AS q)", 'qe', 'q', 'q')},
    hv AS (SELECT id, 1 - list_cosine_similarity(emb.v, qe.v) AS distance FROM emb, qe WHERE list_sum(emb.v) > 0),
    hvr AS (SELECT id, distance, row_number() OVER (ORDER BY round(distance, 9), id) AS rank FROM hv QUALIFY rank <= 40),
    hb AS (SELECT id, rank, distance, 1 AS v FROM hvr UNION ALL SELECT id, rank, NULL, 0 FROM lex),
    hg AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank, max(distance) AS distance, max(v) = 0 AS lexical_only FROM hb GROUP BY id),
    hf AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, best_rank, id) AS fused_rank FROM hg),
    hr AS (SELECT hf.*, c.path, c.section, c.source_kind, c.chunk, c.file_hash, len(list_intersect([{', '.join(repr(w) for w in QUERY.split())}], {tokens_sql('c.chunk')})) AS score FROM hf JOIN chunks c USING (id) WHERE fused_rank <= 20),
    hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, fused_rank) AS final_rank FROM hr QUALIFY final_rank <= 10)"""
Q["hybrid_search"] = lambda s, d: _hybrid(s, d).hits.select("id", "final_rank", "fused_rank", "lexical_only", F.round("rrf", 9).alias("rrf"), F.round("distance", 6).alias("distance"), F.col("rerank_score").cast("long").alias("score"))
SQL["hybrid_search"] = with_sql(FILES, chunks_sql(), HYBRID) + "SELECT id, final_rank::INTEGER AS final_rank, fused_rank::INTEGER AS fused_rank, lexical_only, round(rrf, 9) AS rrf, round(distance, 6) AS distance, score::BIGINT AS score FROM hits"
Q["hybrid_no_rerank"] = lambda s, d: _hybrid(s, d, reranker=False).hits.select("id", "final_rank")
SQL["hybrid_no_rerank"] = with_sql(FILES, chunks_sql(), HYBRID) + "SELECT id, fused_rank::INTEGER AS final_rank FROM hf WHERE fused_rank <= 10"
Q["vector_only_search"] = lambda s, d: _hybrid(s, d, problem="lexical index missing").hits.select("id", "final_rank")
SQL["vector_only_search"] = with_sql(FILES, chunks_sql(), HYBRID) + "SELECT id, rank::INTEGER AS final_rank FROM hvr WHERE rank <= 10"


def _live(s, d):
    return corpus.live_files(s, d).select("path", content_hash(F.col("text")).alias("live_hash"))


def _response(s, d):
    """The hybrid search with its hits' metadata, as a search answers."""
    found = _hybrid(s, d)
    stamp = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hits = found.hits.withColumns({"title": F.col("path"), "canonical_uri": F.lit(None).cast("string"), "source_system": F.lit("vault"), "occurred_at": stamp(F.col("occurred_ms")), "updated_at": stamp(F.col("updated_ms")), "content_hash": F.col("file_hash")})
    return plans.SearchResults(hits, found.mode, found.reason)


def _markdown(s, d):
    hits = response.annotated(_response(s, d).hits, _live(s, d))
    return hits.select("final_rank", metadata.render_hits(hits).alias("markdown"))


STAMP = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%SZ')"
RESPONSE = f"""shown AS (SELECT *, {STAMP.format('occurred_ms')} AS occurred_at, {STAMP.format('updated_ms')} AS updated_at, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM hits JOIN (SELECT path, doc_id, occurred_ms, updated_ms FROM files) USING (path)),
    blocks AS (SELECT *, concat_ws(chr(10), '### [' || final_rank || '] ' || path, '**Section:** ' || section,
        '**Relevance:** ' || CASE WHEN distance IS NOT NULL THEN round_even((1 - distance) * 100, 0)::INTEGER || '%' ELSE 'lexical-only' END, '**Source:** ' || source_kind || ' / vault',
        '**Occurred:** ' || coalesce(occurred_at, 'unknown'), '**Updated:** ' || coalesce(updated_at, 'unknown'), '**Citation:** `' || path || '`', '**Freshness:** ' || freshness, '', chunk, '') AS markdown FROM shown)"""
Q["search_markdown"] = _markdown
SQL["search_markdown"] = with_sql(FILES, chunks_sql(), HYBRID, RESPONSE) + "SELECT final_rank::INTEGER AS final_rank, markdown FROM blocks"


def _structured(s, d):
    rows_ = response.structured(response.annotated(_response(s, d).hits, _live(s, d)))
    return rows_.select("final_rank", "id", "text", "citation", F.round("relevance", 6).alias("relevance"), "lexical_only", "freshness", F.col("metadata.title").alias("title"), F.col("metadata.occurred_at").alias("occurred_at"), F.col("metadata.updated_at").alias("updated_at"), F.col("metadata.content_hash").alias("content_hash"))


Q["search_structured"] = _structured
SQL["search_structured"] = with_sql(FILES, chunks_sql(), HYBRID, RESPONSE) + "SELECT final_rank::INTEGER AS final_rank, id, chunk AS text, path AS citation, round(1 - distance, 6) AS relevance, lexical_only, freshness, path AS title, occurred_at, updated_at, file_hash AS content_hash FROM blocks"
Q["search_response"] = lambda s, d: response.respond(_response(s, d), QUERY, _live(s, d)).select("schema_version", "query", "mode", "fallback_reason", F.size("results").alias("hits"), "markdown")
SQL["search_response"] = with_sql(FILES, chunks_sql(), HYBRID, RESPONSE) + f"""SELECT 2 AS schema_version, '{QUERY}' AS query, 'hybrid+rerank' AS mode, NULL::VARCHAR AS fallback_reason, count(*)::INTEGER AS hits,
    '## Search: `{QUERY}`' || chr(10) || chr(10) || '**Mode:** hybrid+rerank' || chr(10) || chr(10) || string_agg(markdown, chr(10) ORDER BY final_rank) AS markdown FROM blocks"""


def _preview(s, d):
    h = _hybrid(s, d).hits
    return h.select("final_rank", F.regexp_replace(F.substring("chunk", 1, 300), r"\n", " ").alias("preview"))


Q["search_preview"] = _preview
SQL["search_preview"] = with_sql(FILES, chunks_sql(), HYBRID) + "SELECT final_rank::INTEGER AS final_rank, replace(left(chunk, 300), chr(10), ' ') AS preview FROM hits"
ASKED = [(1, "SRC3"), (2, "src0"), (3, "nowhere"), (4, None)]


def _sections(s, d):
    """The section that a request names, whatever its case; null if there is none."""
    known = corpus.files(s, d).select("section").distinct()
    asked = rows(s, ASKED, "n int, asked string")
    return asked.join(known, F.lower("asked") == F.lower("section"), "left").select("n", "section")


Q["resolve_sections"] = _sections
SQL["resolve_sections"] = with_sql(FILES) + f"SELECT n::INTEGER AS n, k.section FROM {values_sql(ASKED, 'n, asked')} LEFT JOIN (SELECT DISTINCT section FROM files) k ON lower(asked) = lower(k.section)"
