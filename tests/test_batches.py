"""Job batches against the plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from searchloom.operators.generations import job_batches


def walk(rows, max_pages, max_bytes):
    out = {}
    for g in {r[0] for r in rows}:
        b = n = run = 0
        for _, o, z in sorted(r for r in rows if r[0] == g):
            if z > max_bytes:
                out[g, o] = None
                continue
            if n and (n + 1 > max_pages or run + z > max_bytes):
                b, n, run = b + 1, 0, 0
            n, run = n + 1, run + z
            out[g, o] = b
    return out


@pytest.mark.parametrize("pages, size, stretch", [(5, 100, 5), (7, 60, 20), (3, 1000, 64), (40, 300, 16)])
def test_batches_like_a_walk(spark, pages, size, stretch):
    rng = random.Random(pages)
    rows = [(f"s{rng.choice([0, 0, 0, 0, 1, 2])}", o, rng.choice([0, 1, 10, 30, 59, 60, 61, 90, 100, 101, 400])) for o in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "space string, page long, bytes long").repartition(5)
    got = {(r.space, r.page): r.batch for r in job_batches(df, "space", "page", "bytes", pages, size, stretch).collect()}
    assert got == walk(rows, pages, size)
    assert job_batches(df.limit(0), "space", "page", "bytes").count() == 0


def test_one_space_of_many_pages(spark):
    n, m, z = 200_000, 50, 40_000
    df = spark.range(0, n, 1, 6).select(F.lit(1).alias("space"), F.col("id").alias("page"), (F.pmod(F.xxhash64("id"), F.lit(2000))).alias("bytes"))
    got = {(r.space, r.page): r.batch for r in job_batches(df, "space", "page", "bytes", m, z, 1000).collect()}
    assert got == walk([tuple(r) for r in df.collect()], m, z)
