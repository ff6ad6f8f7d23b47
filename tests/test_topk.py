"""Batched searches: what leaves a task is bounded, and ties are exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom.operators import lexical, vector
from searchloom.operators.topk import Running


@pytest.mark.parametrize("strings", [False, True])
def test_running_selection_like_a_sort(strings):
    rng = np.random.default_rng(2)
    rows, queries, limit = 5000, 7, 9
    scores = rng.integers(0, 40, (rows, queries)).astype(float)  # many ties
    scores[rng.random(scores.shape) < 0.3] = np.inf
    ids = rng.permutation(rows)
    ids = np.array([f"c{i}" for i in ids], object) if strings else ids
    best = Running(queries, limit)
    for at in range(0, rows, 311):
        best.add(scores[at : at + 311], lambda r, at=at: ids[at + r])
    q, s, i = best.rows()
    for k in range(queries):
        want = sorted((scores[r, k], ids[r]) for r in range(rows) if np.isfinite(scores[r, k]))[:limit]
        assert sorted(zip(s[q == k].tolist(), i[q == k].tolist(), strict=True)) == want


def test_rows_that_leave_tasks_are_bounded(spark):
    n, m, limit, tasks = 3000, 400, 10, 3
    chunks = spark.range(0, n, 1, tasks).select(F.format_string("c%05d", "id").alias("id"), F.lit(3).alias("dl"), F.array(F.lit("all"), F.format_string("t%d", F.col("id") % 50), F.lit("x")).alias("tokens"))
    weights = spark.range(m).select(F.col("id").alias("query_id"), F.lit("all").alias("term"), F.lit(1.5).alias("w"), F.lit(3.0).alias("avgdl")).toPandas()
    out = lexical.task_best(chunks, weights, limit, "long")
    assert out.count() <= tasks * m * limit  # every chunk holds the term: pairs would be n * m
    terms = spark.range(m).select(F.col("id").alias("query_id"), F.lit("all").alias("term"))
    df, stats = spark.createDataFrame([("all", n)], "term string, chunks long"), spark.createDataFrame([(n, 3.0)], "n long, avgdl double")
    got = lexical.bm25_batch(chunks, df, stats, terms, limit)
    assert {(r.rank, r.id) for r in got.collect()} == {(i + 1, f"c{i:05d}") for i in range(limit)} and got.count() == m * limit

    vectors = spark.range(0, n, 1, tasks).select("id", F.array(F.lit(1.0), (F.col("id") % 5).cast("double")).alias("vector"))
    asked = spark.range(m).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("qv")).collect()
    assert vector.task_nearest(vectors, asked, limit, "vector", "long").count() <= tasks * m * limit
    queries = spark.range(m).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    for block in (4096, 100):
        got = vector.topk_batch(vectors, queries, limit, block=block)
        assert {(r.rank, r.id) for r in got.collect()} == {(i + 1, 5 * i) for i in range(limit)} and got.count() == m * limit


def test_batch_of_odd_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 0.0, 0.0]), ("e", [0.0, 1.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0, 1.0, 1.0])], "query_id string, vector array<double>")
    got = {(r.query_id, r.id, round(r.distance, 6), r.rank) for r in vector.topk_batch(rows, queries, 5).collect()}
    assert got == {("q", "a", 0.0, 1), ("q", "e", 1.0, 2), ("w", "d", round(1 - 1 / 3**0.5, 6), 1)}
    assert vector.topk_batch(rows.limit(0), queries, 5).count() == 0 and vector.topk_batch(rows, queries.limit(0), 5).count() == 0
