"""BM25 over chunk tables: by scanning, and over a postings table.

Scores are negative, the best being least. Corpus statistics are those of the
whole table, whatever the filters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.contracts import CANDIDATES
from searchloom.functions.text import index_tokens
from searchloom.operators.topk import Running
from searchloom.sources.scratch import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _idf(n: Column, rows: Column) -> Column:
    raw = F.log((n - rows + 0.5) / (rows + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw)


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def phrases(spark, query: str) -> list[list[str]]:
    """The query's phrases of index tokens, with repeats: one for each word token;
    a word token of several index tokens is an adjacent phrase."""
    import re

    words = re.findall(r"\w+", query)
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string") if words else None
    return [r.t for r in rows.select("i", index_tokens(F.col("w")).alias("t")).orderBy("i").collect() if r.t] if words else []


def _count(tokens: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    hit = lambda t, i: _all([F.get(tokens, i + k) == w for k, w in enumerate(phrase)])
    return F.size(F.filter(tokens, hit))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & F.coalesce(c, F.lit(False))
    return out


def bm25(chunks: DataFrame, query_phrases: list[list[str]], condition: Column | None = None, limit: int = CANDIDATES, text: str = "chunk") -> DataFrame:
    """The `limit` best chunks by (score, id): the table's columns and bm25.

    One scan counts each phrase in each chunk; the statistics are one row; nothing
    is exploded and no posting moves between tasks.
    """
    if not query_phrases or limit <= 0:
        return chunks.withColumn("bm25", F.lit(None).cast("double")).limit(0)
    distinct = list(dict.fromkeys(map(tuple, query_phrases)))
    tokens = F.col("__tokens")
    rows = chunks.withColumn("__tokens", index_tokens(F.col(text))).withColumn("__dl", F.size("__tokens"))
    for i, p in enumerate(distinct):
        rows = rows.withColumn(f"__tf{i}", _count(tokens, list(p)))
    rows = rows.drop("__tokens")
    stats = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avgdl"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(distinct))])
    times = {p: sum(tuple(q) == p for q in query_phrases) for p in distinct}
    score = sum((_idf(F.col("__n"), F.col(f"__df{i}")) * _weight(F.col(f"__tf{i}"), F.col("__dl"), F.col("__avgdl")) * times[p] for i, p in enumerate(distinct)), F.lit(0.0))
    hit = F.greatest(*[F.col(f"__tf{i}") for i in range(len(distinct))], F.lit(0)) > 0
    found = rows.where(hit)
    if condition is not None:
        found = found.where(condition)
    scored = found.crossJoin(F.broadcast(stats)).withColumn("bm25", -score)  # stats is one row
    return scored.orderBy("bm25", "id").limit(limit).select(*chunks.columns, "bm25")


#: Postings of a query's terms up to which all its blocks are scored at once, and blocks that are scored first beyond.
FEW, FIRST = 200_000, 24


def _named(rows: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Postings with ids and dl in place of their slots in blocks (block, ids, dl);
    the rows of a block meet in one task."""
    rows = rows.repartition("block")
    if blocks is None:
        return rows.drop("slots")
    held = rows.drop("ids", "dl").join(blocks.select("block", F.col("ids").alias("__ids"), F.col("dl").alias("__dl")), "block")
    at = lambda c: F.transform("slots", lambda i: F.get(F.col(c), i))
    return held.withColumns({"ids": at("__ids"), "dl": at("__dl")}).drop("slots", "__ids", "__dl")


def bm25_blocks(postings: DataFrame, df: DataFrame, sizes: DataFrame, terms: list[str], allowed: DataFrame | None = None, limit: int = CANDIDATES, blocks: DataFrame | None = None) -> DataFrame:
    """(id, bm25) like bm25 for single-token phrases, repeats counting, from
    postings by block (sources.index) of the query's terms. df has (term, chunks) by
    part and sizes (n, tokens) by part; allowed (id) is what filters leave. Postings
    that aren't named need their blocks (block, ids, dl).

    The terms' largest weights in a block bound its chunks' scores. Where the terms
    have many postings, the blocks of highest bound are scored first, and of the
    others only those that reach the `limit`-th score found, equal ones included, so
    the lists of other blocks aren't read at all. Exact. A block's rows meet in one
    task, which adds up its chunks' scores and sends on `limit` of them.
    """
    none = postings.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("bm25")).limit(0)
    if not terms or limit <= 0:
        return none
    facts = df.select(F.col("term"), F.col("chunks").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(sizes.select(F.lit(None).cast("string").alias("term"), F.col("n").alias("x"), F.col("tokens").cast("long").alias("y")))
    found = {r.term: (r.x, r.y) for r in facts.groupBy("term").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}  # one row a term
    n, tokens = found.pop(None, (0, 0))
    if not found or not n:
        return none
    avgdl = tokens / n
    idf = {t: max(math.log((n - x + 0.5) / (x + 0.5)), 0) or LEAST_IDF for t, (x, _) in found.items()}
    load = F.element_at(F.create_map(*[F.lit(v) for t in found for v in (t, idf[t] * terms.count(t))]), F.col("term"))
    weight = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))

    def scored(rows: DataFrame) -> DataFrame:
        rows = _named(rows.select("block", load.alias("w"), "slots", "ids", "tf", "dl"), blocks)
        each = rows.select("block", "w", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p"))
        out = each.groupBy("block", F.col("p.ids").alias("id")).agg((-F.sum(F.col("w") * weight(F.col("p.tf"), F.col("p.dl")))).alias("bm25")).drop("block")
        return out if allowed is None else out.join(allowed, "id", "left_semi")

    best = lambda rows: rows.orderBy(F.round("bm25", 9), "id").limit(limit)
    if sum(x for x, _ in found.values()) <= FEW:
        return best(scored(postings))
    top = F.array_max(F.zip_with("edge_tf", "edge_dl", weight))
    bounds = postings.groupBy("block").agg(F.sum(load * top).alias("bound"))
    first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    early = best(scored(postings.where(F.col("block").isin(first))))
    hits = early.toArrow()  # at most `limit` rows
    early = postings.sparkSession.createDataFrame(hits) if hits.num_rows else none
    late = bounds.where(~F.col("block").isin(first))
    if hits.num_rows >= limit:
        late = late.where(F.col("bound") >= -hits["bm25"][limit - 1].as_py() - 1e-8)
    chosen = postings.join(late.select("block"), "block", "left_semi")
    return best(early.unionByName(scored(chosen)))


def bm25_phrases(postings: DataFrame, stats: DataFrame, query_phrases: list[list[str]], allowed: DataFrame | None = None, limit: int = CANDIDATES, blocks: DataFrame | None = None) -> DataFrame:
    """(id, bm25) like bm25, from postings by block of the query's terms, with their
    places, and stats (n, avgdl), one row; allowed (id) is what filters leave. Postings
    that aren't named need their blocks (block, ids, dl). The rows of a block meet in
    one task."""
    if not query_phrases or limit <= 0:
        return postings.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("bm25")).limit(0)
    distinct = list(dict.fromkeys(map(tuple, query_phrases)))
    terms = list(dict.fromkeys(t for p in distinct for t in p))
    at = {t: f"__p{i}" for i, t in enumerate(terms)}
    spread = lambda c: F.flatten(F.zip_with(c, "tf", F.array_repeat))
    held = _named(postings.select("block", "term", "slots", "ids", "tf", "dl", "places"), blocks).withColumns({"ids": spread("ids"), "dl": spread("dl")})
    each = held.select("block", "term", F.explode(F.arrays_zip("ids", "dl", "places")).alias("p"))
    rows = each.groupBy("block", F.col("p.ids").alias("id")).agg(F.first("p.dl").alias("__dl"), *[F.collect_list(F.when(F.col("term") == t, F.col("p.places"))).alias(c) for t, c in at.items()])

    def count(p):
        hit = lambda i: _all([F.array_contains(at[w], i + k) for k, w in enumerate(p)]) if len(p) > 1 else F.lit(True)
        return F.coalesce(F.size(F.filter(F.col(at[p[0]]), hit)), F.lit(0))

    rows = rows.select("id", "__dl", *[count(p).alias(f"__tf{i}") for i, p in enumerate(distinct)])
    n_rows = rows.agg(*[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(distinct))])
    times = {p: sum(tuple(q) == p for q in query_phrases) for p in distinct}
    score = sum((_idf(F.col("n"), F.col(f"__df{i}")) * _weight(F.col(f"__tf{i}"), F.col("__dl"), F.col("avgdl")) * times[p] for i, p in enumerate(distinct)), F.lit(0.0))
    found = rows.where(F.greatest(*[F.col(f"__tf{i}") for i in range(len(distinct))], F.lit(0)) > 0)
    if allowed is not None:
        found = found.join(allowed, "id", "left_semi")
    scored = found.crossJoin(F.broadcast(n_rows)).crossJoin(F.broadcast(stats))  # one row each
    return scored.select("id", (-score).alias("bm25")).orderBy("bm25", "id").limit(limit)


#: (query, term) pairs, and queries, that a task holds at once; more are asked in turns.
BATCH_PAIRS, BATCH_QUERIES = 1_000_000, 16_384


def bm25_batch(forward: DataFrame, df: DataFrame, stats: DataFrame, terms: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, id, bm25, rank) for single-token queries given as rows
    (query_id, term), repeats counting.

    forward has (id, dl, tokens) of each chunk, df (term, chunks), stats one row
    (n, avgdl). A block of queries, of at most BATCH_PAIRS pairs, goes to all
    tasks; each scatters the postings of its own chunks into dense scores and
    keeps its best of each query over all its chunks, so at most tasks x queries x
    limit rows are shuffled, whatever a term's frequency.
    """
    kind = terms.schema["query_id"].dataType.simpleString()
    wanted = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weighed = wanted.join(df.select("term", F.col("chunks").alias("df")), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (_idf(F.col("n"), F.col("df")) * F.col("times")).alias("w"), "avgdl")
    weighed = written(weighed, "weights")  # one row of stats
    pairs, queries = weighed.agg(F.count(F.lit(1)), F.count_distinct("query_id")).head()
    turns = max(1, -(-pairs // BATCH_PAIRS), -(-queries // BATCH_QUERIES))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("bm25", 9), "id"))
    out = None
    for turn in range(turns):
        mine = weighed if turns == 1 else weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        part = task_best(forward, mine.toPandas(), limit, kind).withColumn("rank", rank).where(F.col("rank") <= limit)
        part = part if turns == 1 else written(part, "turn")
        out = part if out is None else out.unionByName(part)
    return out


def task_best(forward: DataFrame, weights, limit: int, kind: str) -> DataFrame:
    """(query_id, id, bm25): each task's best chunks of each query in weights
    (query_id, term, w, avgdl)."""
    import numpy as np

    queries = weights["query_id"].unique()
    place = {q: i for i, q in enumerate(queries)}
    by_term = {t: (g["query_id"].map(place).to_numpy(), g["w"].to_numpy()) for t, g in weights.groupby("term")}
    avgdl = float(weights["avgdl"].iloc[0]) if len(weights) else 1.0
    shared = forward.sparkSession.sparkContext.broadcast((queries, by_term, avgdl))

    def run(batches):
        import pyarrow as pa

        names, terms, mean = shared.value
        best = Running(len(names), limit)
        step = max(1, (1 << 22) // max(1, len(names)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                tokens = batch.column(2)
                flat = tokens.flatten().dictionary_encode()
                row = np.repeat(np.arange(batch.num_rows), np.asarray(tokens.value_lengths().fill_null(0)))
                codes = flat.indices.to_numpy(zero_copy_only=False)
                known = np.array([t in terms for t in flat.dictionary.to_pylist()], bool)
                use = known[codes] if len(codes) else np.zeros(0, bool)
                pairs, tf = np.unique(codes[use].astype(np.int64) * batch.num_rows + row[use], return_counts=True)
                term, at = pairs // max(1, batch.num_rows), pairs % max(1, batch.num_rows)
                dl = batch.column(1).to_numpy()
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / mean))
                scores, hit = np.zeros((batch.num_rows, len(names))), np.zeros((batch.num_rows, len(names)), bool)
                edges = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, int)
                for a, b in zip(edges, np.append(edges[1:], len(term)), strict=True):
                    q, w = terms[flat.dictionary[int(term[a])].as_py()]
                    cells = np.ix_(at[a:b], q)
                    scores[cells] -= gain[a:b, None] * w
                    hit[cells] = True
                scores[~hit] = np.inf
                best.add(scores, lambda r, ids=batch.column(0): np.array(ids.take(pa.array(r)).to_pylist(), object))
        found = best.rows()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(names[found[0]]), pa.array(found[2], pa.string()), pa.array(found[1])], names=["query_id", "id", "bm25"])

    return forward.select("id", "dl", "tokens").mapInArrow(run, f"query_id {kind}, id string, bm25 double")
