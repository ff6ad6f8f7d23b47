"""Fusion, caps, modes and filters."""

import random

import pytest
from pyspark.sql import functions as F

from searchloom.operators import filters, freshness, fusion, metrics, vector
from searchloom.operators.chunking import chunk_files
from searchloom.plans.search import search
from searchloom.sources.index import ORDER, Index, Scan, index_tables, lexical_ready
from searchloom.sources.store import Store


def test_rrf_order_and_ties(spark):
    b = spark.createDataFrame([("vector", 1, "a"), ("vector", 2, "b"), ("vector", 3, "c"), ("lexical", 1, "b"), ("lexical", 2, "d"), ("lexical", 3, "a")], "branch string, rank int, id string")
    assert [r.id for r in fusion.rrf(b).orderBy("fused_rank").collect()] == ["b", "a", "d", "c"]
    t = spark.createDataFrame([("vector", 1, "z"), ("lexical", 1, "y")], "branch string, rank int, id string")
    rows = fusion.rrf(t).orderBy("fused_rank").collect()
    assert [(r.id, r.lexical_only) for r in rows] == [("y", True), ("z", False)]


def test_cap_like_the_walk(spark):
    rng = random.Random(1)
    rows = [(q, i, rng.choice("abc")) for q in range(12) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "query_id int, fused_rank int, path string")
    for cap, window in ((1, 3), (2, 5), (3, 20), (None, 5)):
        got = {q: [] for q in range(12)}
        for r in fusion.cap_per_path(df, cap, window).orderBy("query_id", "capped_rank").collect():
            got[r.query_id].append(r.fused_rank)
        for q in range(12):
            first, rest, seen = [], [], {}
            for _, i, p in (r for r in rows if r[0] == q):
                ok = cap is None or (len(first) < window and seen.get(p, 0) < cap)
                (first if ok else rest).append(i)
                seen[p] = seen.get(p, 0) + ok
            assert got[q] == first + rest


def test_rerank_keeps_only_its_window_or_all_on_failure(spark):
    hits = spark.createDataFrame([(f"c{i}", i + 1, s) for i, s in enumerate([0.1, 0.9, 0.9, 0.5])], "id string, fused_rank int, s double")
    out, reason = fusion.rerank(hits, lambda h: h.withColumn("rerank_score", F.col("s")), first=3)
    assert reason is None and [r.id for r in out.orderBy("final_rank").collect()] == ["c1", "c2", "c0"]

    def broken(_):
        raise RuntimeError("down")

    out, reason = fusion.rerank(hits, broken)
    assert "down" in reason and [r.id for r in out.orderBy("final_rank").collect()] == ["c0", "c1", "c2", "c3"]


def test_modes(spark):
    chunks = spark.createDataFrame([("a", "x one"), ("b", "x two"), ("c", "three")], "id string, chunk string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "id string, vector array<double>")
    r = search(Scan(chunks, vectors), [["x"]], [1.0, 0.0], 2, lexical_problem=lexical_ready(None))
    assert r.mode == "vector-only" and [h.id for h in r.hits.orderBy("final_rank").collect()] == ["a", "c"]
    r = search(Scan(chunks, vectors), [["x"]], [1.0, 0.0], 50)
    assert r.mode == "hybrid" and {h.id for h in r.hits.collect()} == {"a", "b", "c"}
    r = search(Scan(chunks, vectors), [["x"]], [1.0, 0.0], 3, reranker=fusion.overlap_score(["two"]))
    assert r.mode == "hybrid+rerank" and r.hits.orderBy("final_rank").head().id == "b"
    assert lexical_ready({"version": "v1"}) and lexical_ready({"version": "v2"}) is None


def test_filter_plan(spark):
    ms = filters.bound_ms
    rows = [("doc", "docs", "doc", "Ana", ms("2026-08-03T08:15:00Z"), ms("2026-08-03T09:00:00Z"), 2), ("note", "docs", "note", "Other", 1700000000000, 1700000000000, 2), ("old", "docs", "doc", "Ana", ms("2026-08-03T08:15:00Z"), ms("2026-08-03T09:00:00Z"), 1), ("none", "docs", "doc", "Ana", None, None, 2)]
    df = spark.createDataFrame(rows, "id string, section string, source_kind string, author string, occurred_ms long, updated_ms long, schema_version int")
    c = filters.plan("docs", ["doc"], [" Ana "], "2026-08-03T08:00:00Z", "2026-08-03T08:30:00Z", "2026-08-03T08:30:00Z", "2026-08-03T09:30:00Z")
    assert [r.id for r in df.where(c).collect()] == ["doc"]
    assert filters.plan() is None and filters.clamp_k(99) == 10 and filters.clamp_k(0) == 1
    for bad in ("yesterday", "2026-08-03T08:00:00"):
        with pytest.raises(ValueError):
            filters.bound_ms(bad)
    with pytest.raises(ValueError):
        filters.plan(source_kinds=["mail"])


def test_pushdown(spark, tmp_path):
    """Filters and columns reach the scan."""
    df = spark.range(10).select(F.col("id"), F.lit("docs").alias("section"), F.lit("doc").alias("source_kind"), F.lit(2).alias("schema_version"), F.lit("x" * 50).alias("text"))
    df.write.parquet(str(tmp_path / "t"))
    q = spark.read.parquet(str(tmp_path / "t")).where(filters.plan("docs", ["doc"])).select("id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_kind,doc)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_embedder_registry(spark):
    vector.register_embedder("len", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("a", "xy")], "id string, chunk string")
    assert list(vector.embed(df, "len").head().vector) == [2.0, 1.0]


def test_metrics(spark):
    r = metrics.retrieval(spark.createDataFrame([("q1", 2), ("q2", None)], "query_id string, rank int")).head()
    assert (r.mrr, r.hit1, r.hits) == (0.25, 0.0, 1)
    f = freshness.indexed_hashes(spark.createDataFrame([("a", "h" * 64, None, "freshness", "1"), ("b", "short", None, "freshness", "1"), ("c", "h" * 64, None, None, "1")], "path string, file_content_hash string, content_hash string, contract_id string, contract_version string"))
    assert {x.path: x.stored_hash is not None for x in f.collect()} == {"a": True, "b": False, "c": False}


def test_a_reranker_that_fails_in_a_task_degrades_the_search(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 2)], "id string, fused_rank int")
    out, reason = fusion.rerank(hits, lambda h: h.withColumn("rerank_score", F.raise_error(F.lit("no model")).cast("double")))
    assert "no model" in reason and [r.final_rank for r in out.orderBy("id").collect()] == [1, 2]


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "eps"]
    rows = [(f"s/{i}.md", "s", " ".join(words[(i * k + k * k) % 7] for k in range(1, 40)), 2) for i in range(60)]
    chunks = chunk_files(spark.createDataFrame(rows, "path string, section string, text string, schema_version int"))
    vectors = chunks.where("chunk_index = 0").select("id", "section", F.array((F.xxhash64("id") % 7).cast("double"), F.lit(1.0)).alias("vector"))
    store = Store(spark, str(tmp_path))
    store.publish(index_tables(chunks) | {"vectors": vectors}, {"embedding_model": "x"}, "bucket", order=ORDER)
    for phrases in ([["alpha"]], [["of", "the"], ["gamma"], ["gamma"]], [["nothing"]], [["beta", "alpha", "beta"]], []):
        for condition in (None, F.col("path").endswith("1.md")):
            got, want = ({(r.id, round(r.bm25, 9)) for r in x.lexical(phrases, condition, 25).collect()} for x in (Index(store), Scan(chunks, vectors)))
            assert got == want
    a, b = (search(x, [["gamma"]], [1.0, 0.5], 10, reranker=fusion.overlap_score(["delta"])) for x in (Index(store), Scan(chunks, vectors)))
    assert a.mode == b.mode == "hybrid+rerank"
    assert [(r.id, r.final_rank, r.chunk) for r in a.hits.orderBy("final_rank").collect()] == [(r.id, r.final_rank, r.chunk) for r in b.hits.orderBy("final_rank").collect()]
