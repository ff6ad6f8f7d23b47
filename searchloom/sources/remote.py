"""Remote pages as a Spark data source with cursor pagination.

The transport is a function from (space, cursor) to a page of results, so tests
and other systems give their own; one partition reads one space.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page_id string, space_key string, title string, author string, canonical_uri string, updated_at string, created_at string, body string"
LIMIT_BYTES = 8 << 20

#: Transports by name: (space, cursor or None) -> JSON text of {"results": [...], "next": cursor or null}.
TRANSPORTS: dict[str, Callable[[str, str | None], str]] = {}
#: For streams, how far a space goes now: the cursor that its last page of results
#: names as the next one; None while it has none.
HEADS: dict[str, Callable[[str], str | None]] = {}


#: HTTP statuses that may pass by themselves.
TRANSIENT = {408, 425, 429, 500, 502, 503, 504}


class TransportError(RuntimeError):
    """A response that can't be used."""


class AuthError(TransportError):
    """The credentials were refused."""


class NotFound(TransportError):
    """There is no such page."""


class Transient(TransportError):
    """Worth another attempt."""


def raise_for(status: int) -> None:
    """The error of an HTTP status, none for success; it names nothing but the status."""
    if status < 300:
        return
    if status < 400:
        raise TransportError("no redirect is followed")
    kind = AuthError if status in (401, 403) else NotFound if status == 404 else Transient if status in TRANSIENT else TransportError
    raise kind(f"HTTP status {status}")


def bounded(response, limit: int = LIMIT_BYTES) -> bytes:
    """The body of a response (headers and read(n)), not read beyond limit."""
    told = response.headers.get("Content-Length")
    if told is not None and (not told.strip().isdigit() or int(told) > limit):
        raise TransportError("a bad Content-Length, or one over the limit")
    body = response.read(limit + 1)
    if len(body) > limit:
        raise TransportError("a response exceeds the limit")
    return body


def object_of(body: bytes) -> dict:
    """The JSON object of a body in strict UTF-8."""
    try:
        value = json.loads(body.decode("utf-8", errors="strict"))
    except ValueError as error:
        raise TransportError("invalid UTF-8 or JSON") from error
    if not isinstance(value, dict):
        raise TransportError("not a JSON object")
    return value


def origin_of(url: str) -> tuple[str, str, int | None]:
    """(scheme, host, port) of an address; what two pages of one site share."""
    from urllib.parse import urlsplit

    try:
        u = urlsplit(url)
        return u.scheme.lower(), (u.hostname or "").lower(), u.port or {"http": 80, "https": 443}.get(u.scheme.lower())
    except ValueError as error:
        raise TransportError("a bad address") from error


def http_transport(url_of: Callable[[str, str | None], str], headers: dict[str, str], timeout: float = 60.0, origin: str | None = None) -> Callable[[str, str | None], str]:
    """A transport over HTTP, for TRANSPORTS: url_of gives the address of a page
    of results. The headers go to that address alone: no redirect is followed, and
    with an origin no other one is asked."""

    def fetch(space: str, cursor: str | None) -> str:
        from urllib.error import HTTPError, URLError
        from urllib.request import HTTPRedirectHandler, Request, build_opener

        class Stay(HTTPRedirectHandler):
            def redirect_request(self, *_):
                return None

        url = url_of(space, cursor)
        if origin is not None and origin_of(url) != origin_of(origin):
            raise TransportError("an address of another origin")
        try:
            with build_opener(Stay).open(Request(url, headers=headers), timeout=timeout) as response:
                return json.dumps(object_of(bounded(response)))
        except HTTPError as error:
            raise_for(error.code if error.code >= 400 else 399)
            raise
        except (URLError, TimeoutError, OSError):
            raise Transient("the request failed") from None

    return fetch


class SpacePartition(InputPartition):
    def __init__(self, space: str):
        self.space = space


class PagesReader(DataSourceReader):
    def __init__(self, spaces: list[str], fetch: Callable[[str, str | None], str], origin: str):
        self.spaces, self.fetch, self.origin = spaces, fetch, origin

    def partitions(self):
        return [SpacePartition(s) for s in self.spaces]

    def read(self, partition):
        yield from pages_between(self.fetch, self.origin, partition.space, None, None)


def pages_between(fetch: Callable[[str, str | None], str], origin: str, space: str, start: str | None, end: str | None):
    """The rows of a space from one cursor up to another, or to where there is no
    next one."""
    cursor, seen = start, {start}
    while end is None or cursor != end:
        text = fetch(space, cursor)
        if len(text) > LIMIT_BYTES:
            raise ValueError("a response exceeds the limit")
        page = json.loads(text)
        for r in page["results"]:
            if r.get("space") != space:
                continue  # outside the allowlist
            uri = r.get("uri")
            yield (str(r["id"]), r["space"], r.get("title"), r.get("author"), origin + uri if uri and uri.startswith("/") else uri, r.get("updated"), r.get("created"), r.get("body"))
        cursor = page.get("next")
        if cursor is None:
            if end is not None:
                raise ValueError("the cursors don't lead to the end that was told")
            return
        if cursor in seen:
            raise ValueError("the cursor repeats")
        seen.add(cursor)


class ChangesPartition(InputPartition):
    def __init__(self, space: str, start: str | None, end: str):
        self.space, self.start, self.end = space, start, end


class ChangesReader(DataSourceStreamReader):
    """Pages as they change: an offset holds each space's cursor, and a batch what
    lies between two offsets, which a replay reads again from the same cursors. The
    driver only asks how far a space goes; tasks read, a space each."""

    def __init__(self, spaces: list[str], fetch: Callable[[str, str | None], str], head: Callable[[str], str | None], origin: str):
        self.spaces, self.fetch, self.head, self.origin = spaces, fetch, head, origin

    def initialOffset(self):
        return {s: None for s in self.spaces}

    def latestOffset(self):
        return {s: self.head(s) for s in self.spaces}

    def partitions(self, start, end):
        return [ChangesPartition(s, start.get(s), end[s]) for s in self.spaces if end.get(s) is not None and start.get(s) != end[s]]

    def read(self, partition):
        yield from pages_between(self.fetch, self.origin, partition.space, partition.start, partition.end)

    def commit(self, end):
        pass  # the remote side keeps its pages


class PagesSource(DataSource):
    """spark.read.format("remote_pages") with options spaces (comma-separated),
    transport (a registered name) and origin; spark.readStream likewise, for a
    transport that also has a head."""

    transports, heads = TRANSPORTS, HEADS

    @classmethod
    def name(cls):
        return "remote_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        return PagesReader(self._spaces(), self.transports[o["transport"]], o.get("origin", ""))

    def streamReader(self, schema):
        o = self.options
        return ChangesReader(self._spaces(), self.transports[o["transport"]], self.heads[o["transport"]], o.get("origin", ""))

    def _spaces(self) -> list[str]:
        return [s.strip() for s in self.options["spaces"].split(",") if s.strip()]


def register(spark, transports: dict[str, Callable[[str, str | None], str]] | None = None, heads: dict[str, Callable[[str], str | None]] | None = None) -> None:
    """Makes spark.read.format("remote_pages") known to a session, with transports
    (those of TRANSPORTS) that go to the workers along with it."""

    class Registered(PagesSource):  # a class of its own, so that its transports travel by value
        pass

    Registered.transports = dict(TRANSPORTS if transports is None else transports)
    Registered.heads = dict(HEADS if heads is None else heads)
    spark.dataSource.register(Registered)


def convert_html(df, html: str = "html", out: str = "text"):
    """df with plain text of HTML: scripts, styles and comments gone, blocks on
    lines of their own, tags gone, the common entities decoded."""
    from pyspark.sql import functions as F

    t = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|body|head|html|title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return df.withColumn(out, F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", ""))
