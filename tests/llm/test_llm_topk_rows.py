"""op1_exact_topk on rows that take no part, against its SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rows_not_finite_take_no_part(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, [nan, 9.0, 9.0, 9.0]), (201, [9.0, nan, -9.0, 9.0]), (202, [inf, 0.0, 0.0, 0.0]), (203, [0.0, -inf, 0.0, 0.0]), (204, [None, 9.0, 9.0, 9.0]), (205, None), (250, [nan] * 4), (None, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", F.col("embedding").cast(f"array<{kind}>"))
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    res = con.execute(ORACLES["op1_exact_topk"])
    cols = [c[0] for c in res.description]
    want = sorted(res.fetchall())
    assert len(want) == 15
    assert sorted(map(tuple, QUERIES["op1_exact_topk"](spark, str(tmp_path)).select(cols).collect())) == want


def test_one_large_norm_spoils_one_block(spark):
    """Blocks go by norm, so a row of a large norm makes no search exhaustive."""
    from searchloom.llm import vectors

    rng = np.random.default_rng(6)
    centers = rng.standard_normal((50, 32))
    x = centers[rng.integers(0, 50, 8000)] + 0.1 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[17] *= 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 200 = 1")
    got: dict = {}
    for r in vectors.nearest(df, q, 10, block=1000, turn=25).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids = [i for i in range(8000) if i % 200 == 1]
    exact = x[ids] @ x.T
    exact[np.arange(len(ids)), ids] = -np.inf
    want = {i: set(np.argsort(-e)[:10].tolist()) for i, e in zip(ids, exact, strict=True)}
    assert np.mean([len(got[i] & want[i]) / 10 for i in ids]) >= 0.9 and all(17 in got[i] for i in ids if x[i] @ x[17] > 900)
    held = vectors.trees(vectors.usable(df, "vec_id", "embedding", False), 1000).collect()
    assert len(held) == 8 and sum(t.top > 2 for t in held) == 1
    # a norm that all have: the tree alone, over rows that it doesn't spoil
    tree = vectors.ProjectionTree(np.delete(x, 17, 0))
    tree.search(x[ids], np.full(len(ids), -1), 10, 0.9)
    assert tree.verified < 0.3 * len(ids) * len(x)
