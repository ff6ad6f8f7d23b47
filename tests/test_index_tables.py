"""Tables of the search index: made when they are first asked for, and their layout."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from searchloom.functions.text import fold, index_tokens
from searchloom.queries import base, contract, ingest, search, state
from searchloom.sources import index
from searchloom.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(monkeypatch):
    """No index of an earlier test."""
    monkeypatch.setattr(base, "_INDEXES", {})


def tables(store):
    return store.meta()["tables"]


def test_a_query_publishes_what_it_reads(spark, fresh):
    assert search.Q["postings_stats"](spark, SF).count() > 0
    store = base.index(spark, SF, "chunks").store
    first = tables(store)
    assert set(first) == {"chunks", "forward", "terms"}
    assert search.Q["chunk_vectors"](spark, SF).count() == first["chunks"]["rows"]
    assert contract.Q["read_back"](spark, SF).head().ready
    second = tables(store)
    assert set(second) == {*first, "vectors"} and all(second[n] == held for n, held in first.items())
    assert search.Q["hybrid_search"](spark, SF).count() == 10
    assert set(tables(store)) == {*second, "postings", "sizes"}
    base.index(spark, SF)
    assert set(tables(store)) == {"chunks", *index.MADE_OF} and tables(store)["chunks"] == first["chunks"]


def test_searches_by_words_write_no_tokens(spark, fresh, monkeypatch):
    names = ("bm25_topk", "bm25_filtered", "bm25_phrase", "hybrid_search")
    got = {n: sorted(map(tuple, search.Q[n](spark, SF).collect()), key=str) for n in names}
    store = base.index(spark, SF, "chunks").store
    alone = tables(store)
    assert set(alone) == {"chunks", "postings", "terms", "sizes", "vectors"}
    sums = {n: sorted(map(tuple, store.table(n).collect())) for n in ("terms", "sizes")}
    assert search.Q["bm25_batched"](spark, SF).count() > 0
    later = tables(store)
    assert set(later) == {*alone, "forward"} and all(later[n] == held for n, held in alone.items())
    monkeypatch.setattr(base, "_INDEXES", {})
    whole = base.index(spark, SF).store
    assert sums == {n: sorted(map(tuple, whole.table(n).collect())) for n in sums}
    assert got == {n: sorted(map(tuple, search.Q[n](spark, SF).collect()), key=str) for n in names}


def test_health_publishes_what_it_tells_of(spark, fresh):
    rows = {r.table: r for r in ingest.Q["index_health"](spark, SF).collect()}
    held = tables(base.index(spark, SF, "chunks").store)
    assert set(held) == set(rows) == {"chunks", "forward", "vectors"}
    assert all(r.rows == r.ids == held[n]["rows"] and not r.damaged and not r.diverging for n, r in rows.items())


def test_texts_of_documents_without_hits_stay(spark):
    hits = spark.createDataFrame([(0, "src0/0.md::x::v3::0", 1), (1, "src1/1.md::x::v3::0", 2)], "query_id int, id string, rank int")
    plan = state._ranks(spark, SF, hits)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "broadcast" in plan


def test_terms_are_summed_without_postings(spark):
    rows = [(b, f"c{i}", ["a", "b", "a"] if i % 2 else ["b", f"é{i}"] if i % 3 else []) for i in range(60) for b in [i % 4]]
    forward = spark.createDataFrame([(b, i, len(t), t) for b, i, t in rows], "bucket int, id string, dl int, tokens array<string>").coalesce(1)
    got = index.term_sums(forward).groupBy("bucket", "term").agg(F.sum("chunks"), F.sum("occurrences"))
    want = forward.select("bucket", "id", F.explode("tokens").alias("term")).groupBy("bucket", "term").agg(F.countDistinct("id"), F.count(F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_are_one_list_and_older_layouts_are_refused(spark, tmp_path):
    rows = [(f"a/{i}.md", "a", f"a/{i}.md::0", 0, t) for i, t in enumerate(["x y x y z", "y x", "", "z z x y y"])]
    chunks = spark.createDataFrame(rows, "path string, section string, id string, chunk_index int, chunk string")
    store = Store(spark, str(tmp_path / "s"))
    store.publish(index.index_tables(chunks), {}, "bucket", order=index.ORDER)
    held = store.table("postings").where("term IS NOT NULL")
    assert held.schema["places"].dataType.simpleString() == "array<int>"
    assert held.where("size(places) <> total OR aggregate(tf, 0, (s, x) -> s + x) <> total").count() == 0
    assert [r.id for r in index.Index(store).lexical([["x", "y"]]).orderBy("id").collect()] == ["a/0.md::0", "a/3.md::0"]
    meta = store.meta()
    fields = [f for f in StructType.fromJson(meta["tables"]["postings"]["schema"]) if f.name != "places"]
    meta["tables"]["postings"]["schema"] = StructType(fields).add("places", ArrayType(ArrayType(IntegerType()))).jsonValue()
    assert not index.has_slots(meta)
    store._put(f"{store.current()}/meta.json", meta)
    assert index.Index(store).problem() == "lexical index incompatible"


def test_ascii_folds_like_the_rest(spark):
    texts = ["Plain ASCII, 42_x", "É́cole CAFÉ ß", "", "áb", "TAB\tand\nline"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t")), index_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == ["plain ascii, 42_x", "ecole cafe ß", "", "ab", "tab\tand\nline"]
    assert got[0][1] == ["plain", "ascii", "42", "x"] and got[2][1] == []
