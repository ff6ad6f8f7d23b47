"""Conversion of pages, publication of generations, backups, PDF chunks."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.functions.html import markdown
from searchloom.operators import convert, pdf
from searchloom.plans import backup, ingest
from searchloom.sources import generation
from searchloom.sources.generation import Generations, InconsistentGeneration
from searchloom.sources.store import PublicationError, Store
from searchloom.streaming.reconcile import FINGERPRINT

PAGES = "source_uid string, path string, html string"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<h2>A <i>b</i></h2>c", "## A b\n\nc"),
        ("<ul><li>a<li>b<ol><li>x</li><li><p>y</p><p>z</p></ol></ul>", "- a\n- b\n  1. x\n  2. y\n\nz"),
        ("<table><tr><th>a<td>1|2<tr><td>b</table>", "| a | 1\\|2 |\n| b |"),
        ("<pre> a\n  b``` </pre>", "````\n a\n  b``` \n````"),
        ("q<br> r <b>s</i>t", "q\nr st"),
        ("<a href='/u?x=1&amp;y'>li <i>nk</i></a> <a>none</a>", "[li nk](/u?x=1&y) none"),
        ("&amp;lt; a &lt; b &nosuch; 1 < 2", "&lt; a < b &nosuch; 1 < 2"),
        ("x<script>var t='</p>';</script><style>p{}</style><!-- c --><svg><title>n</title></svg>y", "xy"),
        ("</p></ul></li>x", "x"),
        ("<ul><li></li><li> </li></ul><h1></h1><hr>", ""),
    ],
)
def test_markdown_of_html(html, text):
    assert markdown(html)[1] == text


@pytest.mark.parametrize(
    "html, title, text",
    [
        ("<title>a&amp;&amp</title>b&amp", "a&&amp", "b&amp"),
        ("<p>1 &lt 2 &lt; 3 &#65 &#65; &am", None, "1 &lt 2 < 3 &#65 A &am"),
        ("<a href='/u?a=1&copy=2&amp;b'>x&copy</a>", None, "[x&copy](/u?a=1&copy=2&b)"),
        ("&ampfoo; &notit; & && <xmp>a & b</xmp>", None, "&ampfoo; &notit; & && a & b"),
    ],
)
def test_references_end_with_a_semicolon(html, title, text):
    assert markdown(html) == (title, text)


def test_cut_references_are_as_in_the_sql(spark, tmp_path):
    import duckdb

    from searchloom.queries import ingest as queries

    rows = [(7, "<html><head><title>a&amp</title></head><body><article><h1>a&amp</h1><p>b&amp;c&am</p></article></body></html>"), (13, "<p>x&amp; &lt y</p>"), (44, "<p>&am</p>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("converted_pages", "published_generation"):
        got = queries.Q[name](spark, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(queries.SQL[name]).fetchall()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<pre>", "</pre>", "<br>", "<h1>", "</h1>", "<ol>", "<div>", "</div>", "<b>", "w1", " w2 ", "w3\n"])))
def test_no_words_are_lost_whatever_the_tags(pieces):
    words = re.findall(r"w\d", "".join(p if p.startswith("w") or p.startswith(" ") else " " for p in pieces))
    assert re.findall(r"w\d", markdown("".join(pieces))[1]) == words


def test_deep_pages_take_time_in_proportion():
    assert markdown("<div>" * 50_000 + "x")[1] == "x"
    assert markdown("<ul><li>" * 3_000 + "x")[1].strip() == "- x"


def test_all_pages_have_the_words_of_a_plain_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    got = {r.page_id: r for r in convert.convert(rows).collect()}
    assert len(got) == rows.count()
    for page_id, html in rows.toLocalIterator():
        shown = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<!--.*?-->|<!DOCTYPE[^>]*>", "", html or "")
        shown = re.sub(r"<[^>]*>", " ", shown)
        for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
            shown = shown.replace(a, b)
        plain = re.sub(r"\[([^\]]*)\]\(/[^)]*\)", r"\1", got[page_id].text or "")
        plain = re.sub(r"(?m)^(?:- |#+ )", "", plain)
        assert plain.split() == shown.split()


def test_outcomes(spark):
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "<p></p>", "k"), (4, "<title> T\n t</title><p>é", "k"), (5, "é" * 60, "k"), (4, "<p>again", "k")], "page_id int, html string, title string")
    got = convert.convert(rows, limit=100)
    assert sorted(got.columns) == ["error_code", "outcome", "page_id", "text", "title"]
    assert {(r.page_id, r.outcome, r.error_code) for r in got.collect()} == {(1, "failed", "no_content"), (2, "failed", "empty"), (3, "failed", "empty"), (4, "ok", None), (5, "failed", "too_large")}
    assert convert.convert(rows.limit(0)).count() == 0


def pages(spark, *rows):
    return spark.createDataFrame([(u, f"wiki/{u}.md", h) for u, h in rows], PAGES)


def held(root, spark):
    return {r.source_uid: (r.status, r.text) for r in Generations(spark, root).rows("documents").collect()}


def test_runs_carry_forward_bury_and_read_back(spark, tmp_path):
    root = str(tmp_path / "g")
    assert generation.read(spark, root) is None
    first = ingest.run(spark, root, pages(spark, ("a", "<p>one"), ("b", "<p>two"), ("c", "<p>three")))
    assert (first["status"], first["converted"], first["documents"]) == ("ok", 3, 3)
    second = ingest.run(spark, root, pages(spark, ("a", "<p>ONE"), ("b", None), ("d", "<p>four")), failures=0.5)
    assert (second["status"], second["failed"], second["tombstones"]) == ("degraded", 1, 1)
    assert held(root, spark) == {"a": ("fresh", "ONE"), "b": ("stale", "two"), "d": ("fresh", "four")}
    read = {r.path: (r.text, r.section, r.readable) for r in generation.read(spark, root).collect()}
    assert read == {"wiki/a.md": ("ONE", "sources", True), "wiki/b.md": ("two", "sources", True), "wiki/d.md": ("four", "sources", True)}
    ingest.run(spark, root, pages(spark, ("a", "<p>ONE")), complete=False)
    assert held(root, spark) == {"a": ("fresh", "ONE"), "b": ("stale", "two"), "d": ("stale", "four")}


def test_refused_attempts_leave_the_generation_and_their_health(spark, tmp_path):
    root = str(tmp_path / "g")
    ingest.run(spark, root, pages(spark, ("a", "<p>one")))
    now = Generations(spark, root).current()
    same = spark.createDataFrame([("a", "wiki/x.md", "<p>1"), ("b", "wiki/x.md", "<p>2")], PAGES)
    for rows, code in ((pages(spark, ("a", "<p>1"), ("a", "<p>2")), "duplicate"), (pages(spark, (None, "<p>1")), "duplicate"), (pages(spark, ("a", None), ("b", "<p>x")), "failure_threshold"), (same, "path_collision")):
        with pytest.raises(ingest.Refused) as e:
            ingest.run(spark, root, rows)
        assert e.value.code == code and Generations(spark, root)._read("health.json")["error_code"] == code
    assert Generations(spark, root).current() == now and held(root, spark) == {"a": ("fresh", "one")}


@pytest.mark.parametrize("step", ["documents", "manifest", "rename", "pointer"])
def test_a_crash_before_any_step_leaves_the_old_generation(spark, tmp_path, step):
    root = str(tmp_path / "g")
    ingest.run(spark, root, pages(spark, ("a", "<p>one")))
    store = Generations(spark, root)
    old = store.current()

    class Died(BaseException):  # no handler of the writer sees it, as if the process had gone
        pass

    def die(at):
        if at == step:
            raise Died

    with pytest.raises(Died):
        ingest.run(spark, root, pages(spark, ("a", "<p>new")), before=die)
    assert store.current() == old and held(root, spark) == {"a": ("fresh", "one")}
    ingest.run(spark, root, pages(spark, ("a", "<p>later")), keep=1)
    assert held(root, spark) == {"a": ("fresh", "later")}
    assert [p.name for p in (tmp_path / "g" / "generations").iterdir()] == [store.current()]


def test_a_generation_that_lost_a_file_is_refused(spark, tmp_path):
    root = str(tmp_path / "g")
    ingest.run(spark, root, pages(spark, ("a", "<p>one")))
    for f in (tmp_path / "g" / "generations").rglob("documents/part-*"):
        f.unlink()
    with pytest.raises(InconsistentGeneration):
        generation.read(spark, root)


def test_a_publication_on_another_base_is_refused(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "g"))
    empty = store.rows("documents"), store.rows("tombstones")
    store.put(*empty, base="")
    with pytest.raises(PublicationError):
        store.put(*empty, base="")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.publish({"chunks": spark.range(100).withColumn("bucket", F.col("id") % 4)}, FINGERPRINT, "bucket")
    s.publish({"chunks": spark.range(1000, 1010).withColumn("bucket", F.lit(1).cast("bigint"))}, FINGERPRINT, "bucket", replaced=[1])
    return s


def test_a_restored_store_is_the_store(spark, tmp_path, store):
    kept = backup.backup(store, str(tmp_path / "b"))
    files = {r.path: r for r in kept.collect()}
    assert len(files) == 4 and all((tmp_path / "s" / p).stat().st_size == r.bytes for p, r in files.items())
    assert backup.verify(spark, str(tmp_path / "b")).count() == 0
    back = backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))
    assert back.meta() == store.meta() and sorted(back.table("chunks").collect()) == sorted(store.table("chunks").collect())
    back.publish({"chunks": spark.range(3).withColumn("bucket", F.col("id"))}, FINGERPRINT, "bucket")
    assert back.table("chunks").count() == 3
    for again in (lambda: backup.backup(store, str(tmp_path / "b")), lambda: backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))):
        with pytest.raises(FileExistsError):
            again()


def test_a_flipped_byte_is_named(spark, tmp_path, store):
    backup.backup(store, str(tmp_path / "b"))
    victim = sorted((tmp_path / "b" / "files").rglob("part-*"))[2]
    data = bytearray(victim.read_bytes())
    data[len(data) // 2] ^= 1
    victim.write_bytes(data)
    name = str(victim.relative_to(tmp_path / "b" / "files"))
    assert [tuple(r) for r in backup.verify(spark, str(tmp_path / "b")).collect()] == [(name, "changed")]
    with pytest.raises(backup.DamagedCopy, match=re.escape(name)):
        backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()


def test_a_backup_without_its_end_is_none(spark, tmp_path, store):
    backup.backup(store, str(tmp_path / "b"))
    (tmp_path / "b" / "backup.json").unlink()
    for use in (lambda: backup.verify(spark, str(tmp_path / "b")), lambda: backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))):
        with pytest.raises(FileNotFoundError):
            use()


def test_pdf_chunks(spark):
    def pages_of(raw):
        if raw == b"broken":
            raise ValueError("no pdf")
        return raw.decode().split("\f")

    rows = [("a/my-big_file.pdf", b"  one \f\f\n" + b"two. " * 200, 1012), ("b.pdf", b"broken", 6), ("c.pdf", b" \f ", 3), ("d.pdf", b"x", 60_000_000)]
    got = pdf.pdf_chunks(spark.createDataFrame(rows, "path string, content binary, size_bytes bigint"), pages_of, F.lit("2024-01-01T00:00:00Z")).orderBy("path", "chunk_index").collect()
    first = [r for r in got if r.status == "ok"]
    assert {r.path: r.status for r in got if r.status != "ok"} == {"b.pdf": "extraction_error", "c.pdf": "empty", "d.pdf": "too_large"}
    assert [r.header for r in first] == ["Page 1"] + ["Page 3"] * (len(first) - 1) and len(first) > 2
    assert [r.chunk_index for r in first] == list(range(len(first))) and {r.expected_chunk_count for r in first} == {len(first)}
    assert first[0].chunk == "one" and first[0].title == "My Big File" and first[0].source_kind == "doc" and first[0].section == "a"
    assert first[1].id == f"a/my-big_file.pdf::{first[1].file_content_hash}::v3::1" and first[1].format == "pdf"
