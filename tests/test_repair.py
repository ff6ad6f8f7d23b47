"""Repair of a store's parts."""

import pytest
from pyspark.sql import functions as F

from searchloom.plans import backup, repair
from searchloom.plans.sync import sync
from searchloom.sources.index import Index
from searchloom.sources.store import Store
from searchloom.streaming.reconcile import FINGERPRINT


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"a/{i}.md", "a", f"words of file {i} and others, number{i % 7} " * (3 + i % 40), 2) for i in range(120)]
    return spark.createDataFrame(rows, "path string, section string, text string, schema_version int")


@pytest.fixture(scope="module")
def whole(spark, files, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("r") / "s"))
    assert sync(s, files, FINGERPRINT).head().status == "succeeded"
    backup.backup(s, s.root + "-kept")
    return s


@pytest.fixture
def store(spark, whole, tmp_path):
    return backup.restore(spark, whole.root + "-kept", str(tmp_path / "s"))


def rows(store, name):
    t = store.table(name)
    return sorted(map(repr, t.select(*sorted(t.columns)).collect()))


def parts(store, name):
    """The folders of a table's parts, below the store's root."""
    return store.meta()["tables"][name]["parts"]


def data(tmp_path, folder):
    return sorted((tmp_path / "s" / folder).glob("part-*"))[0]


def test_a_sound_store_is_left_alone(store, whole):
    g = store.current()
    assert store.damaged() == {} and repair.diverging(store).count() == 0
    assert repair.repair(store, FINGERPRINT) == {} and store.current() == g


@pytest.mark.parametrize("how", ["lost", "cut", "folder"])
@pytest.mark.parametrize("name", ["postings", "vectors"])
def test_one_damaged_part_is_found_and_written_alone(store, whole, tmp_path, name, how):
    before = {t: parts(store, t) for t in store.meta()["tables"]}
    victim = sorted(before[name], key=int)[3]
    f = data(tmp_path, before[name][victim])
    if how == "cut":
        f.write_bytes(f.read_bytes()[:40])
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    else:
        f.unlink()
        if how == "folder":
            for x in f.parent.iterdir():
                x.unlink()
            f.parent.rmdir()
    assert store.damaged() == {name: [victim]}
    assert repair.repair(store, FINGERPRINT)[name] == [victim]
    for t, held in before.items():
        now = parts(store, t)
        assert {k for k in held if now[k] != held[k]} == {victim} and set(now) == set(held)
        assert rows(store, t) == rows(whole, t)
    assert store.damaged() == {} and repair.repair(store, FINGERPRINT) == {}


def test_damaged_chunks_come_from_their_files(store, whole, files, tmp_path):
    victim = sorted(parts(store, "chunks"), key=int)[2]
    data(tmp_path, parts(store, "chunks")[victim]).unlink()
    with pytest.raises(repair.Unrepairable, match=victim):
        repair.repair(store, FINGERPRINT)
    assert repair.repair(store, FINGERPRINT, files)["chunks"] == [victim]
    for t in ("chunks", "forward", "postings", "terms", "sizes"):
        assert rows(store, t) == rows(whole, t)
    best = lambda s: [(r.id, round(r.bm25, 9)) for r in Index(s, FINGERPRINT).lexical([["number3"]]).orderBy("bm25", "id").collect()]
    assert best(store) == best(whole) != []


def test_ids_that_diverge_are_found_though_written_so(store, whole):
    part = store.table("forward").where(F.col("id").contains("a/5.md")).head().bucket
    keep = store.table("forward", [part]).where(~F.col("id").contains("a/5.md"))
    store.publish({"forward": keep}, FINGERPRINT, "bucket", replaced=[part])
    assert store.damaged() == {}
    assert [tuple(r) for r in repair.diverging(store).collect()] == [("forward", part)]
    assert repair.repair(store, FINGERPRINT) == {"forward": [str(part)]}
    assert rows(store, "forward") == rows(whole, "forward") and rows(store, "postings") == rows(whole, "postings")
