"""Operator 10: WARC archives of pages, written and read back.

Writing uses Spark's text writer, with a record as the line and CRLF CRLF as the
line's end, so that files appear whole or not at all. Reading checks each
record's boundary: tasks emit, for every place that looks like a record, its
offset and its successor's, and pointer jumping from the start of each file
keeps the records that are reached. Magic inside a payload is reached by none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.tables import scratch, written
from searchloom.llm.textcore import trimmed

#: Payloads from this size on are stored once; other records with them revisit.
REVISIT_BYTES = 100
#: Records a file at most; with pages of some KB, files of some ten MB. Fewer in the
#: files of large pages, so that no file passes FILE_BYTES but with a single record.
FILE_RECORDS, FILE_BYTES = 8192, 512 << 20
#: Pages up to this size share files; larger ones are written apart from them.
SMALL = 60 << 10
DATE = "2024-01-01T00:00:00Z"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Kinds of rows beside records: a file's end, and where its records stop leading to it.
END, DAMAGED = "end", "damaged"
FIELDS = "path string, offset bigint, successor bigint, size bigint, kind string, page bigint, refers_to bigint, payload_bytes bigint, digest string"


def write(pages: DataFrame, path: str | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes a record for each row of pages and returns the archives' folder.

    Of rows with equal payloads of REVISIT_BYTES or more, those with the
    smallest key are responses and the others revisits of them, without a
    payload; smaller payloads, and rows with a null key, are responses always. A
    null html is an empty payload, a null url becomes a urn of the key. Rows
    that repeat in whole get a record each. Payloads don't move between tasks
    unless revisits are so many that their keys exceed the session's broadcast
    threshold; then one join by key does it.
    """
    path = path or scratch(pages.sparkSession, "warc")
    base = pages.select(
        F.col(page).cast("long").alias("page"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")))), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"),
    )
    keyed = base.where(F.octet_length("payload") >= REVISIT_BYTES).where("page IS NOT NULL").select("page", F.sha2("payload", 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page").alias("refers_to"), F.max("page").alias("last")).where("last > refers_to").drop("last")
    again = written(keyed.join(first, "digest").where("page > refers_to").select("page", "digest", "refers_to"), "revisits").dropDuplicates(["page", "digest"])
    rows = base.withColumn("digest", F.sha2("payload", 256)).join(again, ["page", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    name = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 16), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))).cast("string"),
        F.lit("\r\n\r\n"),
    )
    size = F.octet_length("payload") + F.octet_length("url")
    largest = base.agg(F.max(size)).first()[0] or 0
    out = rows.select(F.concat(header, block).alias("value"), (size > SMALL).alias("large"))
    for large, most in ((False, min(largest, SMALL)), (True, largest)):
        if large <= (largest > SMALL):  # large pages have files of their own
            records = max(1, min(FILE_RECORDS, FILE_BYTES // (most + 2048)))
            out.where(F.col("large") == large).select("value").write.mode("append" if large else "error").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)
    return path


class DamagedArchive(RuntimeError):
    """An archive whose records don't lead from its start to its end."""


def candidates(content: bytes):
    """For every record-like place of a file: (offset, successor, kind, key, key
    referred to, payload bytes, payload digest, which for a revisit is the one
    it names). The successor is the file's end
    or another such place; what has no such successor isn't a record."""
    size, view = len(content), memoryview(content)
    for m in MAGIC.finditer(content):
        at = m.start()
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            continue
        fields = {}
        for line in content[m.end() : head].split(b"\r\n"):
            k, colon, v = line.partition(b":")
            if colon:
                fields[k.strip().lower()] = v.strip()
        length = fields.get(b"content-length", b"")
        if not length.isdigit():
            continue
        begin, end = head + 4, head + 4 + int(length)
        if content[end : end + 4] != b"\r\n\r\n" or not (end + 4 == size or MAGIC.match(content, end + 4)):
            continue
        body = content.find(b"\r\n\r\n", begin, end)
        body = end if body < 0 else body + 4
        kind = fields.get(b"warc-type", b"").decode("latin-1")
        told = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
        digest = told if kind == "revisit" else hashlib.sha256(view[body:end]).hexdigest()
        page, other = (re.match(rb"<urn:page:(-?\d+):", fields.get(f, b"")) for f in (b"warc-record-id", b"warc-refers-to"))
        yield at, end + 4, kind, page and int(page[1]), other and int(other[1]), end - body, digest


def reachable(offset, successor):
    """Mask of the places reached from offset 0, by pointer jumping: after round
    r the mark has spread over 2**r records and each pointer spans as many."""
    n = len(offset)
    order = np.argsort(offset, kind="stable")
    o = offset[order]
    at = np.searchsorted(o, successor[order])
    jump = np.where((at < n) & (o[np.minimum(at, n - 1)] == successor[order]), at, n)
    jump = np.append(jump, n)
    mark = np.zeros(n + 1, bool)
    mark[:-1] = o == 0
    while True:
        spread = mark.copy()
        spread[jump[mark]] = True
        if (spread == mark).all() and (jump == jump[jump]).all():
            break
        mark, jump = spread, jump[jump]
    out = np.zeros(n, bool)
    out[order] = mark[:-1]
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: FIELDS, reachable ones only. Where
    the records of a file don't lead to its end, as when a record is cut off or
    tells a wrong length, a row of kind DAMAGED has the offset up to which they
    lead; what lies behind it can't be told from payloads and isn't read.

    One task scans a file, of at most FILE_BYTES if `write` made it, and holds it
    in whole; files of 2 GB or more can't be read. Candidates, without payloads, then meet by file. A
    folder without records gives an empty table, an empty file no rows. A false
    candidate costs its claimed length once.
    """

    def scan(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_py()
                found = [(name.as_py(), c[0], c[1], len(raw), *c[2:]) for c in candidates(raw)]
                found.append((name.as_py(), len(raw), len(raw), len(raw), END, None, None, None, None))  # where the records are to lead
                cols = list(zip(*found, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])

    def chain(table):
        keep = reachable(table.column("offset").to_numpy(), table.column("successor").to_numpy())
        kind = np.array(table.column("kind").to_pylist(), object)
        broken = not keep[kind == END].any()
        found = table.filter(keep & (kind != END))
        if broken:
            at = max(found.column("successor").to_pylist(), default=0)
            row = dict.fromkeys(table.column_names) | {"path": table.column("path")[0].as_py(), "offset": at, "successor": at, "size": table.column("size")[0].as_py(), "kind": DAMAGED}
            found = pa.concat_tables([found, pa.Table.from_pylist([row], schema=table.schema)])
        return found

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(trimmed(scan), FIELDS).groupBy("path").applyInArrow(chain, FIELDS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record; a revisit has its response's payload. A damaged file is an error that
    names it and the offset from which on it can't be read; read_records gives what
    comes before."""
    records = written(read_records(spark, path).select("kind", "page", "refers_to", "payload_bytes", "digest", "path", "offset"), "records")
    bad = records.where(F.col("kind") == DAMAGED).orderBy("path").select("path", "offset").head()
    if bad:
        raise DamagedArchive(f"{bad.path} can't be read from byte {bad.offset} on")
    plain = records.where("kind <> 'revisit'").select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = records.where("kind = 'revisit'").select(F.col("page").alias("page_id"), "refers_to", F.col("digest").alias("payload_digest"))
    source = records.where("kind <> 'revisit' AND page IS NOT NULL").select(F.col("page").alias("refers_to"), "payload_bytes", F.col("digest").alias("payload_digest"))
    source = source.join(again.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi").distinct()
    return plain.unionByName(again.join(written(source, "responses"), ["refers_to", "payload_digest"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
