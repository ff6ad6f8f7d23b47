"""BM25 against SQLite's FTS5."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from searchloom.operators import lexical

TEXTS = ["alpha beta gamma", "alpha alpha café", "the 42 x is near", "42 y x", "the beta of the the", "ﬁne straße œuvre", "École cafe alpha beta", "", "gamma gamma gamma delta"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "id string, chunk string")


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE c USING fts5(id UNINDEXED, text, tokenize = \"unicode61 remove_diacritics 2\")")
    con.executemany("INSERT INTO c VALUES (?, ?)", [(f"c{i}", t) for i, t in enumerate(TEXTS)])
    return con


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "the", "alpha alpha", "cafe école", "42_x", "gamma delta nothing", "straße"])
def test_like_fts5(spark, chunks, fts, query):
    words = [w for w in query.split()]
    match = " OR ".join(f'"{w}"' for w in words)
    want = fts.execute("SELECT id, bm25(c) FROM c WHERE c MATCH ? ORDER BY bm25(c), id", (match,)).fetchall()
    got = [(r.id, r.bm25) for r in lexical.bm25(chunks, lexical.phrases(spark, query)).collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_nothing_to_search(spark, chunks):
    assert lexical.phrases(spark, '"*-') == []
    assert lexical.bm25(chunks, []).count() == 0
    assert lexical.bm25(chunks, [["alpha"]], limit=0).count() == 0


def test_filters_keep_statistics(chunks):
    full = {r.id: r.bm25 for r in lexical.bm25(chunks, [["alpha"]]).collect()}
    part = {r.id: r.bm25 for r in lexical.bm25(chunks, [["alpha"]], F.col("id") != "c0").collect()}
    assert part == {k: v for k, v in full.items() if k != "c0"}


@pytest.fixture(scope="module")
def stored(spark):
    """2,000 chunks whose words fall off by rank, and their postings in blocks of 32."""
    import numpy as np

    from searchloom.sources import index

    rng = np.random.default_rng(11)
    p = 1 / np.arange(1, 81)
    rows = [(i % 3, f"c{i:04d}", " ".join(rng.choice([f"w{k}" for k in range(80)], rng.integers(3, 60), p=p / p.sum()))) for i in range(1900)]
    rows += [(i % 3, f"d{i:04d}", "w1 w2 w70 w3") for i in range(100)]  # ties beyond the limit
    chunks = spark.createDataFrame(rows, "bucket int, id string, chunk string").repartition(4, "bucket")
    forward = chunks.select("bucket", "id", lexical.index_tokens(F.col("chunk")).alias("tokens")).select("bucket", "id", F.size("tokens").alias("dl"), "tokens").cache()
    postings = index.postings(forward, 32).cache()
    df = postings.groupBy("bucket", "term").agg(F.sum("n").alias("chunks"))
    sizes = forward.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"))
    return chunks, postings, df, sizes


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_blocks_find_what_a_scan_finds(stored, monkeypatch, few):
    chunks, postings, df, sizes = stored
    monkeypatch.setattr(lexical, "FEW", few)
    monkeypatch.setattr(lexical, "FIRST", 3)
    held = lambda terms: postings.where(F.col("term").isin(terms))
    for terms in (["w0"], ["w1", "w70"], ["w0", "w79", "w60", "w60"], ["w70", "nothing"], ["nothing"], []):
        for condition in (None, F.col("id").endswith("7")):
            allowed = None if condition is None else chunks.where(condition).select("id")
            got = lexical.bm25_blocks(held(terms), df.where(F.col("term").isin(terms)), sizes, terms, allowed, 20).collect()
            want = lexical.bm25(chunks, [[t] for t in terms], condition, 20).collect()
            assert [(r.id, round(r.bm25, 8)) for r in sorted(got, key=lambda r: (round(r.bm25, 9), r.id))] == [(r.id, round(r.bm25, 8)) for r in sorted(want, key=lambda r: (round(r.bm25, 9), r.id))]


def test_common_terms_are_read_where_they_matter(stored, monkeypatch):
    chunks, postings, df, sizes = stored
    monkeypatch.setattr(lexical, "FEW", 0)
    monkeypatch.setattr(lexical, "FIRST", 3)
    kept = postings.where("term IN ('w0', 'w78')")
    opened = chunks.sparkSession.sparkContext.accumulator(0)
    load, blocks = lexical.F.arrays_zip, kept.select("block").distinct().count()

    @F.udf("array<string>")
    def seen(ids):
        opened.add(1)
        return ids

    monkeypatch.setattr(lexical.F, "arrays_zip", lambda a, b, c: load(seen.asNondeterministic()(F.col(a)).alias(a), F.col(b), F.col(c)))
    out = lexical.bm25_blocks(kept, df.where("term IN ('w0', 'w78')"), sizes, ["w0", "w78"], None, 5)
    assert out.count() == 5 and blocks >= 60
    assert opened.value < kept.count() / 2
    monkeypatch.undo()
    plan = lexical.bm25_blocks(kept, df.where("term IN ('w0', 'w78')"), sizes, ["w0", "w78"], None, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(id" not in plan and "hashpartitioning(block#" in plan and ", id#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_stored_postings_name_a_chunk_once(spark, stored, tmp_path, monkeypatch):
    """The index's postings have no ids but one list a block; nothing that is made
    of a laid-out part is shuffled, and searches find what a scan finds."""
    from searchloom.sources import index
    from searchloom.sources.store import Store

    chunks = stored[0].withColumns({"path": F.substring("id", 1, 3), "section": F.lit("s"), "chunk_index": F.lit(0)}).drop("bucket")
    moved = []
    kept = Store._table
    monkeypatch.setattr(Store, "_table", lambda self, g, name, df, *a: moved.append((name, "Exchange" in df._jdf.queryExecution().executedPlan().toString(), a[-1])) or kept(self, g, name, df, *a))
    store = Store(spark, str(tmp_path / "s"))
    store.publish(index.index_tables(chunks, embedder="hash"), {"embedding_model": "hash"}, "bucket", order=index.ORDER)
    assert {n for n, shuffled, still in moved if still and not shuffled} == {"forward", "postings", "vectors"}
    held = store.table("postings")
    names = held.where("term IS NULL")
    assert names.agg(F.sum(F.size("ids"))).head()[0] == chunks.count() and held.where("term IS NOT NULL AND (ids IS NOT NULL OR dl IS NOT NULL)").count() == 0
    x = index.Index(store)
    for few in (0, 1_000_000):
        monkeypatch.setattr(lexical, "FEW", few)
        monkeypatch.setattr(lexical, "FIRST", 3)
        for phrases in ([["w1"], ["w70"]], [["w0", "w1"], ["w79"]], [["nothing"]]):
            for condition in (None, F.col("id").endswith("7")):
                got = x.lexical(phrases, condition, 20).collect()
                want = lexical.bm25(chunks, phrases, condition, 20).collect()
                order = lambda rows: [(r.id, round(r.bm25, 8)) for r in sorted(rows, key=lambda r: (round(r.bm25, 9), r.id))]
                assert order(got) == order(want)
