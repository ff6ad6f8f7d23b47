"""Spans, sections and chunk rows against plain loops and fixed cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.operators import chunking


def plain_spans(text, size, overlap, tail):
    """Windows with late breaks, one at a time."""
    def late(lo, hi, other):
        at = text.rfind("\n", lo, hi)
        at = at if at >= 0 else text.rfind(". ", lo, hi)
        return at + 1 if at >= 0 else other

    out, s = [], 0
    while s < len(text):
        e = len(text) if s + size >= len(text) else late(s + size - overlap, s + size, s + size)
        out.append((s, e))
        if e == len(text):
            break
        s = max(e - overlap, s + max(1, size - 2 * overlap))
    if len(out) > 1 and out[-1][1] - out[-1][0] < tail:
        (a, _), (_, z) = out[-2:]
        mid = a + (z - a + overlap + 1) // 2
        mid = late(mid - overlap, mid, mid)
        out[-2:] = [(a, mid), (mid - overlap, z)]
    return out


def spark_spans(spark, texts, size=512, overlap=64, tail=300):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", chunking.spans("text", size, overlap, tail).alias("x")).orderBy("i").collect()
    return [[(p.s, p.e) for p in r.x] for r in rows]


def test_fixed_cases(spark):
    assert spark_spans(spark, ["x" * 600])[0] == [(0, 332), (268, 600)]
    assert spark_spans(spark, ["x" * 600], tail=0)[0] == [(0, 512), (448, 600)]
    assert spark_spans(spark, [""])[0] == []


@pytest.mark.parametrize("n", [1, 511, 512, 513, 536, 537, 600, 1024, 1537, 3000])
def test_lossless(spark, n):
    text = ("word. " * n)[:n]
    sp = spark_spans(spark, [text])[0]
    assert sp[0][0] == 0 and sp[-1][1] == n
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(sp, sp[1:]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.é \n", max_size=300), min_size=20, max_size=20))
def test_like_the_loop(spark, texts):
    assert spark_spans(spark, texts, 20, 5, 9) == [plain_spans(t, 20, 5, 9) for t in texts]


def test_documents_like_the_loop(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert spark_spans(spark, docs) == [plain_spans(t, 512, 64, 300) for t in docs]


def test_front_matter(spark):
    text = '---\ntitle: "A: b"\nn: 3\nplain: \'q\'\ntitle: "last"\nnone: null\n---\n\n\nbody'
    row = spark.createDataFrame([(text,)], "t string").select(chunking.front_matter(F.col("t")).alias("m"), chunking.body(F.col("t")).alias("b")).head()
    assert row.b == "body" and row.m == {"title": '"last"', "n": "3", "plain": "'q'", "none": "null"}
    no = spark.createDataFrame([("--- not closed",), ("plain",)], "t string").select(chunking.body(F.col("t")).alias("b")).collect()
    assert [r.b for r in no] == ["--- not closed", "plain"]


def test_sections_are_lossless_and_merge(spark):
    text = "pre\n# A\naa\r\n#### deep\n## B \nbb x\n### C\n" + "c" * 320
    rows = spark.createDataFrame([(text,)], "t string").select(chunking.header_sections(F.col("t")).alias("s"), chunking.merge_sections(chunking.header_sections(F.col("t")), 10).alias("m")).head()
    assert "".join(x.span for x in rows.s) == text
    assert [x.header for x in rows.s] == ["", "# A", "## B", "### C"]
    assert "".join(x.span for x in rows.m) == text and rows.m[0].header == "# A"
    small = "".join(f"## h{i}\n{'y' * 60}\n" for i in range(4))
    merged = spark.createDataFrame([(small,)], "t string").select(chunking.merge_sections(chunking.header_sections(F.col("t"))).alias("m")).head().m
    assert len(merged) == 1 and merged[0].header == "## h0 | ## h1 | ## h2 | ## h3"
