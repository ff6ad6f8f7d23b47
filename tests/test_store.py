"""The store, synchronisation, streams, files and remote pages."""

import json

import pytest
from pyspark.sql import functions as F

from searchloom import config
from searchloom.contracts import CHUNKING_VERSION
from searchloom.plans.sync import sync
from searchloom.sources import generation, remote, vault
from searchloom.sources.store import PublicationError, Store, upsert
from searchloom.streaming.reconcile import FINGERPRINT, activity, apply_batch, stream

FILES = "path string, section string, text string, schema_version int"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def paths(store):
    return {r.path: r.n for r in store.table("chunks").groupBy("path").agg(F.count("*").alias("n")).collect()}


def test_sync_publishes_skips_and_removes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    long = "sentence number one. " * 60
    first = files(spark, [("a/1.md", "a", long, 2), ("a/2.md", "a", "short but long enough text", 2), ("b/3.md", "b", "tiny", 2)])
    r = sync(store, first, FINGERPRINT).head()
    assert (r.status, r.published_files, r.skipped_files) == ("succeeded", 2, 1)
    g = store.current()
    r = sync(store, first, FINGERPRINT).head()
    assert (r.published_files, r.removed_files, r.changed) == (0, 0, False) and store.current() == g
    r = sync(store, files(spark, [("a/1.md", "a", long + "more.", 2)]), FINGERPRINT).head()
    assert (r.published_files, r.removed_files) == (1, 1) and set(paths(store)) == {"a/1.md"}
    r = sync(store, files(spark, []), FINGERPRINT, sections_available=[]).head()
    assert r.removed_files == 0 and set(paths(store)) == {"a/1.md"}


def test_unreadable_files_keep_their_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = files(spark, [("a/1.md", "a", "some text that is long enough", 2)])
    sync(store, one, FINGERPRINT)
    bad = one.withColumn("text", F.lit("other text that is long enough")).withColumn("ok", F.lit(False))
    r = sync(store, bad, FINGERPRINT, readable="ok").head()
    assert (r.status, r.errors, r.recommendation) == ("failed", 1, "retry_sync") and paths(store) == {"a/1.md": 1}


def test_a_failed_publication_leaves_the_current_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish({"chunks": spark.range(3)}, FINGERPRINT)
    g = store.current()
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        store.publish({"chunks": broken}, FINGERPRINT)
    assert store.current() == g and store.table("chunks").count() == 3
    with pytest.raises(ValueError):
        store.publish({"chunks": spark.range(1)}, {"embedding_model": "other"})


def test_a_change_writes_its_part_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [(f"a/{i}.md", "a", f"file number {i} with enough text to be kept", 2) for i in range(40)]
    sync(store, files(spark, rows), FINGERPRINT)
    first, before = store.current(), store.meta()["tables"]
    rows[7] = ("a/7.md", "a", "file number 7 with other text than before", 2)
    r = sync(store, files(spark, rows), FINGERPRINT).head()
    assert (r.status, r.published_files, r.added_chunks, r.deleted_chunks) == ("succeeded", 1, 1, 1)
    for name, held in store.meta()["tables"].items():
        moved = [k for k, p in held["parts"].items() if p != before[name]["parts"].get(k)]
        assert len(moved) == 1 and all(p.startswith(first) for k, p in held["parts"].items() if k not in moved)
    whole = Store(spark, str(tmp_path / "w"))
    sync(whole, files(spark, rows), FINGERPRINT)
    for name in before:
        same = lambda s: sorted(map(str, s.table(name).collect()))  # noqa: B023, E731
        assert same(store) == same(whole)


def test_one_writer_at_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = files(spark, [("a/1.md", "a", "some text that is long enough", 2)])
    with store.lock():
        r = sync(store, one, FINGERPRINT, wait=0.1).head()
        assert (r.status, r.changed) == ("locked", False) and store.current() is None
    assert sync(store, one, FINGERPRINT).head().status == "succeeded"


def test_what_does_not_read_back_is_not_published(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    one = files(spark, [("a/1.md", "a", "some text that is long enough", 2)])
    sync(store, one, FINGERPRINT)
    g = store.current()
    kept = Store._table
    monkeypatch.setattr(Store, "_table", lambda self, g, name, *a: (_ for _ in ()).throw(PublicationError(f"table {name} doesn't read back")) if name == "postings" else kept(self, g, name, *a))
    r = sync(store, one.withColumn("text", F.lit("other text that is long enough")), FINGERPRINT).head()
    assert (r.status, r.recommendation, r.errors, r.published_files) == ("failed", "repair_lexical", 1, 0)
    assert store.current() == g and [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("gen-")] == [g]


def test_sections_that_cannot_be_read_are_errors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    two = files(spark, [("a/1.md", "a", "some text that is long enough", 2), ("b/1.md", "b", "some text that is long enough", 2)])
    sync(store, two, FINGERPRINT)
    r = sync(store, two.where("section = 'a'"), FINGERPRINT, sections_available=["a"]).head()
    assert (r.status, r.errors, r.removed_files) == ("failed", 1, 0) and set(paths(store)) == {"a/1.md", "b/1.md"}
    assert [(e.section, e.error) for e in r.error_sample] == [("b", "section_unavailable")] and not r.errors_truncated


def test_retention(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    made = [store.publish({"t": spark.range(i + 1)}, FINGERPRINT, keep=2) for i in range(4)]
    left = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("gen-")}
    assert left == set(made[-2:]) and store.table("t").count() == 4 and store.meta()["chunking"] == CHUNKING_VERSION


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("d", 2)], "id string, v int")
    gone = spark.createDataFrame([("c",)], "id string")
    assert {tuple(r) for r in upsert(old, new, gone).collect()} == {("a", 1), ("b", 2), ("d", 2)}


def test_stream_replay_equals_batch(spark, tmp_path):
    drops = [[("a/1.md", "a", "first version of the text", 2, 1), ("a/2.md", "a", "second file of the test", 2, 1)], [("a/1.md", "a", "newer version of the text", 2, 2)], [("a/2.md", "a", None, 2, 3), ("a/3.md", "a", "third file of the test", 2, 3)]]
    schema = FILES + ", version int"
    for i, d in enumerate(drops):
        spark.createDataFrame(d, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "st"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    batch = Store(spark, str(tmp_path / "b"))
    apply_batch(batch, spark.createDataFrame([r for d in drops for r in d], schema))
    ids = lambda s: {r.id for r in s.table("chunks").select("id").collect()}
    assert ids(Store(spark, str(tmp_path / "st"))) == ids(batch) and len(ids(batch)) == 2


def test_activity_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert activity(e).agg(F.sum("events")).head()[0] == e.count()


def test_vault(spark, tmp_path):
    for rel, data in {"knowledge/a.md": b"hello there", "knowledge/.git/x.md": b"no", "projects/b.md": b"\xff\xfe", "projects/c.pdf": b"%PDF one|two", "projects/d.txt": b"x", "other/e.md": b"y"}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = vault.scan(spark, str(tmp_path))
    assert {(r.path, r.excluded) for r in rows.collect()} == {("knowledge/a.md", False), ("knowledge/.git/x.md", True), ("projects/b.md", False), ("projects/c.pdf", False)}
    assert {r.path: r.status for r in vault.read_markdown(rows).collect()} == {"knowledge/a.md": "ok", "projects/b.md": "read_error"}
    pages = vault.read_pdf(rows, lambda b: b.decode().removeprefix("%PDF ").split("|"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "one"), (2, "two")]
    assert vault.out_of_policy(spark, str(tmp_path)) == ["other"]
    assert vault.scan(spark, str(tmp_path / "nowhere")).count() == 0


def test_remote_pages(spark):
    pages = {None: {"results": [{"id": 1, "space": "A", "uri": "/p/1", "title": "T"}, {"id": 9, "space": "Z"}], "next": "c"}, "c": {"results": [{"id": 2, "space": "A"}], "next": None}}

    def fetch(space, cursor):
        return json.dumps(pages[cursor]) if space == "A" else json.dumps({"results": [], "next": None})

    got = list(remote.PagesReader(["A"], fetch, "https://w.example.com").read(remote.SpacePartition("A")))
    assert [(g[0], g[4]) for g in got] == [("1", "https://w.example.com/p/1"), ("2", None)]
    with pytest.raises(ValueError):
        list(remote.PagesReader(["A"], lambda s, c: json.dumps({"results": [], "next": "same"}), "").read(remote.SpacePartition("A")))
    html = spark.createDataFrame([("<html><script>x</script><p>One &amp; <b>two</b></p><!-- c --><div>three</div></html>",)], "html string")
    assert remote.convert_html(html).head().text == "One & two\nthree"


def test_remote_transport_and_registration(spark):
    for status, kind in ((401, remote.AuthError), (403, remote.AuthError), (404, remote.NotFound), (429, remote.Transient), (503, remote.Transient), (418, remote.TransportError)):
        with pytest.raises(kind):
            remote.raise_for(status)
    remote.raise_for(200)

    class Response:
        def __init__(self, body, told=None):
            self.body, self.headers = body, {} if told is None else {"Content-Length": told}

        def read(self, n):
            return self.body[:n]

    assert remote.object_of(remote.bounded(Response(b'{"a": 1}', "8"), 10)) == {"a": 1}
    for bad in (Response(b"x" * 11), Response(b"", "11"), Response(b"", "many")):
        with pytest.raises(remote.TransportError):
            remote.bounded(bad, 10)
    for body in (b"\xff", b"[]", b"{"):
        with pytest.raises(remote.TransportError):
            remote.object_of(body)
    remote.TRANSPORTS["two"] = lambda space, cursor: json.dumps({"results": [{"id": 7, "space": space, "uri": "/p/7"}], "next": None})
    remote.register(spark)
    rows = spark.read.format("remote_pages").option("spaces", "A, B").option("transport", "two").option("origin", "https://w.example.com").load()
    assert {(r.page_id, r.space_key, r.canonical_uri) for r in rows.collect()} == {("7", "A", "https://w.example.com/p/7"), ("7", "B", "https://w.example.com/p/7")}


def test_generation_reader(spark, tmp_path):
    assert generation.read(spark, str(tmp_path)) is None
    docs = tmp_path / "generations" / "g1" / "documents"
    (docs / "a").mkdir(parents=True)
    (docs / "a" / "1.md").write_text("one")
    (docs / "2.md").write_bytes(b"\xff")
    (docs / "unlisted.md").write_text("no")
    (tmp_path / "current.json").write_text('{"generation_id": "g1"}')
    manifest = {"documents": [{"path": "a/1.md", "source_uid": "1"}, {"path": "2.md", "source_uid": "2"}]}
    (tmp_path / "generations" / "g1" / "manifest.json").write_text(json.dumps(manifest))
    assert {(r.domain, r.path, r.source_uid, r.text, r.readable) for r in generation.read(spark, str(tmp_path)).collect()} == {("ingestion", "a/1.md", "1", "one", True), ("ingestion", "2.md", "2", None, False)}
    manifest["documents"].append({"path": "b/3.md", "source_uid": "3"})
    (tmp_path / "generations" / "g1" / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(generation.InconsistentGeneration, match="b/3.md"):
        generation.read(spark, str(tmp_path))
    for pointer in ('{"generation_id": "../x"}', '{"generation_id": "g2"}', "{", "{}"):
        (tmp_path / "current.json").write_text(pointer)
        with pytest.raises(generation.InconsistentGeneration):
            generation.read(spark, str(tmp_path))


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('store = "s3a://b/x"\nincluded_sections = ["a", "b", "a"]\nlock_wait_seconds = 5\n')
    got = config.load(f, {"SEARCHLOOM_LOCK_WAIT_SECONDS": "2.5", "SEARCHLOOM_INDEX_WHOLE_FOLDER": "true"})
    assert (got.store, got.included_sections, got.lock_wait_seconds, got.index_whole_folder, got.max_markdown_bytes) == ("s3a://b/x", ("a", "b"), 2.5, True, 1_000_000)
    assert config.load(tmp_path / "none.toml", {}) == config.Config()
    for text in ("other = 1", "store = 3", "index_whole_folder = 1", "max_pdf_bytes = 0", "included_sections = 'a'", "store ="):
        f.write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(f, {})
    with pytest.raises(config.ConfigError):
        config.load(None, {"SEARCHLOOM_MAX_PDF_BYTES": "many"})
