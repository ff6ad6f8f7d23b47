"""Remote pages as a stream, and headers that stay with their origin."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from searchloom.sources import remote


def _server(handler):
    server = HTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_headers_stay_with_their_origin():
    asked = []

    class Other(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(dict(self.headers))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *_):
            pass

    other, there = _server(Other)

    class Wiki(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", there + "/x")
                self.end_headers()
            else:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"results": [], "secret": self.headers["Authorization"]}).encode())

        def log_message(self, *_):
            pass

    wiki, here = _server(Wiki)
    try:
        headers = {"Authorization": "Bearer x"}
        assert json.loads(remote.http_transport(lambda s, c: here + "/page", headers, origin=here)("A", None))["secret"] == "Bearer x"
        with pytest.raises(remote.TransportError, match="no redirect"):
            remote.http_transport(lambda s, c: here + "/away", headers, origin=here)("A", None)
        with pytest.raises(remote.TransportError, match="another origin"):
            remote.http_transport(lambda s, c: there + "/page", headers, origin=here)("A", None)
        assert asked == []
    finally:
        wiki.shutdown()
        other.shutdown()
    assert remote.origin_of("HTTPS://W.example.com/a") == remote.origin_of("https://w.example.com:443") != remote.origin_of("http://w.example.com")


def test_a_stream_of_changes_equals_one_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def grow(space, rows):
        have = json.loads((log / space).read_text()) if (log / space).exists() else []
        (log / space).write_text(json.dumps(have + rows))

    where = str(log)

    def held(space):
        from pathlib import Path

        f = Path(where) / space
        return json.loads(f.read_text()) if f.exists() else []

    def fetch(space, cursor):
        at = int(cursor or 0)
        part = held(space)[at : at + 2]
        return json.dumps({"results": [{"id": i, "space": space, "title": t, "body": f"<p>{t}</p>"} for i, t in part], "next": str(at + len(part)) if part else None})

    def head(space):
        return str(len(held(space))) if held(space) else None

    remote.register(spark, {"log": fetch}, {"log": head})
    options = {"spaces": "A,B,C", "transport": "log", "origin": "https://w.example.com"}

    def run(out, checkpoint):
        stream = spark.readStream.format("remote_pages").options(**options).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    rows = lambda df: sorted((r.page_id, r.space_key, r.title, r.body) for r in df.collect())
    grow("A", [(1, "one"), (2, "two"), (3, "three")])
    grow("B", [(9, "nine")])
    run("twice", "cp")
    first = rows(spark.read.parquet(str(tmp_path / "twice")))
    assert len(first) == 4
    run("twice", "cp")  # nothing new
    assert rows(spark.read.parquet(str(tmp_path / "twice"))) == first
    grow("A", [(4, "four"), (1, "one again")])
    grow("C", [(7, "seven")])
    run("twice", "cp")
    run("once", "cp2")
    got = rows(spark.read.parquet(str(tmp_path / "twice")))
    assert got == rows(spark.read.parquet(str(tmp_path / "once"))) == rows(spark.read.format("remote_pages").options(**options).load()) and len(got) == 7


def test_a_replay_reads_the_same_cursors():
    pages = {None: (["a"], "1"), "1": (["b"], "2"), "2": (["c"], "3"), "3": ([], None)}
    fetch = lambda space, cursor: json.dumps({"results": [{"id": i, "space": space} for i in pages[cursor][0]], "next": pages[cursor][1]})
    reader = remote.ChangesReader(["S"], fetch, lambda space: "3", "")
    (p,) = reader.partitions({"S": "1"}, reader.latestOffset())
    assert [r[0] for r in reader.read(p)] == [r[0] for r in reader.read(p)] == ["b", "c"]
    assert reader.partitions({"S": "3"}, {"S": "3"}) == [] and reader.initialOffset() == {"S": None}
    with pytest.raises(ValueError, match="don't lead"):
        list(reader.read(remote.ChangesPartition("S", "1", "9")))
