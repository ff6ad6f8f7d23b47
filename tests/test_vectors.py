"""Vectors that follow the chunks, cells, compatibility, and the writers' lease."""

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom.operators import vector
from searchloom.operators.chunking import chunk_files
from searchloom.plans.build import behind, build, lay_out
from searchloom.plans.search import search
from searchloom.plans.sync import sync
from searchloom.sources.index import ORDER, Index, index_tables
from searchloom.sources.store import Locked, Store, Superseded
from searchloom.streaming.reconcile import FINGERPRINT, apply_batch

FILES = "path string, section string, text string, schema_version int"
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "eps", "zeta"]


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(f"s{i % 3}/{i}.md", f"s{i % 3}", " ".join(rng.choice(WORDS, 150)), 2) for i in range(n)]


def hits(store, fingerprint=FINGERPRINT):
    x = Index(store, fingerprint)
    found = search(x, [["alpha"], ["zeta"]], x.embed("alpha zeta zeta"), 10)
    assert found.mode == "hybrid"
    return [(r.id, r.final_rank, r.distance) for r in found.hits.orderBy("final_rank").collect()]


def table(store, name):
    return sorted(map(str, store.table(name).collect()))


def test_a_sync_keeps_vectors_in_line(spark, tmp_path):
    rows = rows_of(30)
    store = Store(spark, str(tmp_path / "s"))
    sync(store, spark.createDataFrame(rows, FILES), FINGERPRINT)
    assert store.table("vectors").count() == store.table("chunks").count() > 30  # each chunk has one, not only first ones
    rows[4] = (*rows[4][:2], "zeta alpha " * 40, 2)
    del rows[9]
    rows.append(("s1/new.md", "s1", "a new file about zeta and alpha " * 5, 2))
    r = sync(store, spark.createDataFrame(rows, FILES), FINGERPRINT).head()
    assert (r.status, r.published_files, r.removed_files) == ("succeeded", 2, 1)
    fresh = Store(spark, str(tmp_path / "f"))
    sync(fresh, spark.createDataFrame(rows, FILES), FINGERPRINT)
    assert hits(store) == hits(fresh)
    for name in ("chunks", "forward", "postings", "terms", "sizes", "vectors", "digests"):
        assert table(store, name) == table(fresh, name)


def test_a_stream_keeps_vectors_in_line(spark, tmp_path):
    rows = [(*r, 1) for r in rows_of(12)]
    schema = FILES + ", version int"
    store = Store(spark, str(tmp_path / "s"))
    apply_batch(store, spark.createDataFrame(rows, schema))
    late = [(*rows[2][:2], "zeta zeta alpha " * 30, 2, 2), (*rows[5][:2], None, 2, 3)]
    apply_batch(store, spark.createDataFrame(late, schema))
    fresh = Store(spark, str(tmp_path / "f"))
    apply_batch(fresh, spark.createDataFrame(rows + late, schema))
    assert hits(store) == hits(fresh) and table(store, "vectors") == table(fresh, "vectors")


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def make():
        def model(texts):
            with open(log / f"{time.time_ns()}-{threading.get_ident()}", "w") as f:
                json.dump(texts, f)
            return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

        return model

    def embedded():
        out = sorted(t for f in log.iterdir() for t in json.loads(f.read_text()))
        for f in log.iterdir():
            f.unlink()
        return out

    vector.register_embedder("logged", make)
    fingerprint = {"embedding_model": "logged"}
    rows = [(f"a/{i}.md", "a", f"file number {i % 7} with enough text to be kept", 2) for i in range(40)]
    store = Store(spark, str(tmp_path / "s"))
    sync(store, spark.createDataFrame(rows, FILES), fingerprint)
    assert embedded() == sorted(f"file number {i} with enough text to be kept" for i in range(7))  # a text once
    rows[3] = ("a/3.md", "a", "file with another text than it had before", 2)
    sync(store, spark.createDataFrame(rows, FILES), fingerprint)
    assert embedded() == ["file with another text than it had before"]
    assert store.table("vectors").count() == 40
    with pytest.raises(ValueError, match="fingerprint|made with"):
        Index(store, FINGERPRINT).vector([1.0, 0.0, 0.0])
    del vector.EMBEDDERS["logged"]
    with pytest.raises(ValueError, match="no embedder"):
        sync(store, spark.createDataFrame(rows[:-1], FILES), fingerprint)


def test_a_build_adds_vectors_and_takes_up_where_it_stopped(spark, tmp_path):
    rows = rows_of(30)
    chunks = chunk_files(spark.createDataFrame(rows, FILES))
    store = Store(spark, str(tmp_path / "s"))
    store.publish(index_tables(chunks), FINGERPRINT, "bucket", order=ORDER)
    assert store.table("vectors") is None
    parts = behind(store)
    publish, done = Store.publish, []

    def stops(self, *a, **k):
        if len(done) == 2:
            raise RuntimeError("stopped")
        done.append(k["replaced"])
        return publish(self, *a, **k)

    Store.publish = stops
    try:
        with pytest.raises(RuntimeError, match="stopped"):
            build(store, FINGERPRINT, turn=3)
    finally:
        Store.publish = publish
    assert behind(store) == parts[6:] and {"chunks", "postings", "vectors"} <= set(store.meta()["tables"])
    assert build(store, FINGERPRINT) == parts[6:] and build(store, FINGERPRINT) == []
    fresh = Store(spark, str(tmp_path / "f"))
    sync(fresh, spark.createDataFrame(rows, FILES), FINGERPRINT)
    assert hits(store) == hits(fresh) and store.table("vectors").count() == chunks.count()


def test_cells_follow_syncs(spark, tmp_path):
    rows = rows_of(40)
    store = Store(spark, str(tmp_path / "s"))
    sync(store, spark.createDataFrame(rows, FILES), FINGERPRINT)
    assert lay_out(store, FINGERPRINT, cells=6) >= 1
    before = hits(store)
    rows[7] = (*rows[7][:2], "gamma delta " * 40, 2)
    sync(store, spark.createDataFrame(rows, FILES), FINGERPRINT)
    held = {r.cell: np.array(r.centroid) for r in store.table("centroids").collect()}
    unit = {c: v / np.linalg.norm(v) for c, v in held.items()}
    for r in store.table("vectors").collect():
        v = np.array(r.vector)
        assert unit[r.cell] @ v >= max(u @ v for u in unit.values()) - 1e-9
    assert len(hits(store)) == len(before) == 10


def test_recall_of_probed_cells(spark):
    """All vec_id % 100 = 0 against brute force, and the share of rows that is read."""
    from searchloom.queries import base, search

    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        x = base.vector_index(spark, d)
        got = {(r.query_id, r.id) for r in search.Q["vector_probed"](spark, d).collect()}
        want = {(r.query_id, r.id) for r in search.Q["vector_batched"](spark, d).collect()}
        sizes = {r.cell: r.n for r in x.table("vectors").groupBy("cell").agg(F.count("*").alias("n")).collect()}
        recall, share = len(got & want) / len(want), x.probes() / len(sizes)
        print(f"{sf}: recall {recall:.3f}, {x.probes()} of {len(sizes)} cells")
        assert recall >= 0.9 and share <= 1


def test_cells_of_clustered_vectors_read_few_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centers[i % 40] + 0.15 * rng.normal(size=24)], i % 4) for i in range(4000)]
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame(rows, "id long, vector array<float>, bucket int").withColumn("cell", F.lit(0))
    store.publish({"vectors": df}, FINGERPRINT, "bucket", order=ORDER)
    probes = lay_out(store, FINGERPRINT)
    x, asked = Index(store), df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    got, want = ({(r.query_id, r.id) for r in x.vector_batch(asked, 10, p).collect()} for p in (probes, None))
    assert len(got & want) / len(want) >= 0.9 and probes <= 10
    one = x.vector(rows[0][1], None, 10, probes)
    assert {r.id for r in one.collect()} & {r.id for r in x.vector(rows[0][1], None, 10).collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan  # row groups of other cells aren't read


def test_incompatible_indexes_are_told_before_reading(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sync(store, spark.createDataFrame(rows_of(5), FILES), FINGERPRINT)
    g = store.current()
    meta = json.loads((tmp_path / "s" / g / "meta.json").read_text())
    (tmp_path / "s" / g / "meta.json").write_text(json.dumps(meta | {"version": "v1"}))
    (tmp_path / "s" / g / ".meta.json.crc").unlink(missing_ok=True)
    x = Index(store, FINGERPRINT)
    found = search(x, [["alpha"]], x.embed("alpha"), 5)
    assert (found.mode, found.reason) == ("vector-only", "lexical index incompatible")
    with pytest.raises(ValueError, match="made with"):
        search(Index(store, {"embedding_model": "other"}), [["alpha"]], [1.0] * 16, 5)


# the writers' lease
def test_a_dead_writers_claim_runs_out(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish({"t": spark.range(1)}, FINGERPRINT)
    dead = store.lock(lease=1.5, heartbeat=False)
    first = dead.__enter__()  # never left
    with pytest.raises(Locked), store.lock(wait=0.1):
        pass
    began = time.monotonic()
    with store.lock(wait=10) as second:
        assert second > first and time.monotonic() - began < 5
        # the late writer wakes up and is refused the pointer
        with pytest.raises(Superseded):
            store._point("gen-late", first)
    g = store.publish({"t": spark.range(2)}, FINGERPRINT)
    with pytest.raises(Superseded):
        store._point("gen-late", first)
    assert store.current() == g and store.table("t").count() == 2


def test_a_heartbeat_keeps_the_claim(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with store.lock(lease=0.9):
        time.sleep(2.5)
        with pytest.raises(Locked), store.lock(wait=0.1):
            pass
    with store.lock(wait=0.1):
        pass


def test_a_superseded_publication_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    g = store.publish({"t": spark.range(1)}, FINGERPRINT)
    write = Store._table

    def slow(self, *a):
        (tmp_path / "s" / "claims" / "00000099").write_text(json.dumps({"owner": "x", "expires": time.time() + 60}))
        return write(self, *a)

    monkeypatch.setattr(Store, "_table", slow)
    with pytest.raises(Superseded):
        store.publish({"t": spark.range(5)}, FINGERPRINT)
    assert store.current() == g and [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("gen-")] == [g]
