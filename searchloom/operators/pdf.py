"""Chunks of PDF files, page by page."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_SIZE, METADATA_FIELDS, PDF_BYTES
from searchloom.functions import spans as cut
from searchloom.functions.paths import section_of
from searchloom.operators import metadata
from searchloom.operators.chunking import chunk_id

ROWS = "path string, status string, fallback_title string, file_hash string, file_content_hash string, page int, header string, chunk_index int, expected_chunk_count int, chunk string"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def file_rows(path: str, content: bytes | None, size: int, pages_of: Callable[[bytes], list[str]]) -> list[tuple]:
    """The rows of one file: its chunks in order, or one that has only a status."""
    status = lambda s: [(path, s, *[None] * (len(COLUMNS) - 2))]
    if size > PDF_BYTES:
        return status("too_large")
    try:
        raw = bytes(content)
        pages = [(n, t.strip(cut.BLANKS)) for n, t in enumerate(pages_of(raw), 1) if t and t.strip(cut.BLANKS)]
    except Exception:  # a broken file is a status, not a failure
        return status("extraction_error")
    chunks = [(n, x) for n, t in pages for x in cut.pieces(t, CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN)]
    if not chunks:
        return status("empty")
    whole = hashlib.md5("\n".join(t for _, t in pages).encode("utf-8", "replace")).hexdigest()
    title = path.rpartition("/")[2].rpartition(".")[0].replace("-", " ").replace("_", " ").title()
    exact = hashlib.sha256(raw).hexdigest()
    return [(path, "ok", title, whole, exact, n, f"Page {n}", i, len(chunks), x) for i, (n, x) in enumerate(chunks)]


def pdf_chunks(files: DataFrame, pages_of: Callable[[bytes], list[str]], captured_at: Column | None = None) -> DataFrame:
    """A row for each chunk of the PDF files (path, content, size_bytes), or one with
    a status alone: too_large, extraction_error or empty. Pages are cut each by
    itself and numbered from 1, blank ones left out but counted; a chunk has the
    header "Page n", the id of its file's bytes, and the public metadata of a doc.
    pages_of gives the texts of a file's pages."""

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            for path, content, size in zip(b["path"], b["content"], b["size_bytes"], strict=True):
                yield pd.DataFrame(file_rows(path, content, size, pages_of), columns=COLUMNS).astype({"page": "Int32", "chunk_index": "Int32", "expected_chunk_count": "Int32"})

    rows = files.select("path", "content", "size_bytes").mapInPandas(run, ROWS)
    empty = F.create_map().cast("map<string,string>")
    fields = metadata.contract(empty, F.col("path"), section_of(F.col("path")), F.col("fallback_title"), F.col("file_content_hash"), F.current_timestamp().cast("string") if captured_at is None else captured_at, default_kind="doc")
    own = [f for f, name in zip(fields, METADATA_FIELDS, strict=True) if name != "chunk_index"]
    return rows.select(*[c for c in COLUMNS if c != "path"], *own, F.when(F.col("status") == "ok", chunk_id(F.col("path"), F.col("file_content_hash"), F.col("chunk_index"))).alias("id"), F.lit("pdf").alias("format"))
