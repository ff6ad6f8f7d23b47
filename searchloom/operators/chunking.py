"""Lossless chunking: front matter, header sections, spans and chunk rows."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from searchloom.contracts import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_SIZE, CHUNKING_VERSION, EMPTY_CHARS, MARKDOWN_BYTES
from searchloom.functions import spans as cut
from searchloom.functions.text import content_hash, strip


def front_matter_end(c: Column) -> Column:
    """Where the block's closing line starts, counting from 1; 0 without a block."""
    return F.when(F.startswith(c, F.lit("---")), F.locate("\n---", c, 4)).otherwise(0)


def body(c: Column) -> Column:
    """The text behind the front matter, without the line feeds before it."""
    end = front_matter_end(c)
    return F.when(end > 0, F.ltrim(F.substring(c, end + 4, F.length(c)), F.lit("\n"))).otherwise(c)


def front_matter(c: Column) -> Column:
    """Map of key to the raw JSON or plain text of each `key: value` line; of a
    key's lines the last counts."""
    end = front_matter_end(c)
    block = F.when(end > 0, strip(F.substring(c, F.lit(4), end - 4))).otherwise("")
    lines = F.filter(F.split(block, r"\r\n|\r|\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def scalar(raw: Column) -> Column:
    """A front-matter value as text: a JSON string unquoted, null for JSON null,
    anything else without quotes around it."""
    is_json = raw.rlike(r'^"(?:[^"\\]|\\.)*"$')
    return F.when(raw == "null", None).when(is_json, F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(F.regexp_replace(raw, "^['\"]+|['\"]+$", ""))


def header_sections(c: Column) -> Column:
    """Array of (header, span) at headings of level 1 to 3; spans joined are c."""
    spans = F.filter(F.split(c, r"(?md)(?=^#{1,3} .+$)", -1), lambda x: x != "")
    spans = F.when(F.size(spans) == 0, F.array(c)).otherwise(spans)
    return F.transform(spans, lambda s: F.struct(F.when(s.rlike(r"(?d)^#{1,3} ."), strip(F.regexp_extract(s, r"(?d)^(#{1,3} .+)", 1))).otherwise("").alias("header"), s.alias("span")))


def merge_sections(sections: Column, least: int = CHUNK_MIN) -> Column:
    """Adjacent sections joined until each group has `least` characters; what is
    left over joins the last group. The header is the group's distinct ones."""
    empty = "CAST(array() AS ARRAY<STRUCT<headers: ARRAY<STRING>, span: STRING>>)"
    zero = F.expr(f"named_struct('done', {empty}, 'headers', CAST(array() AS ARRAY<STRING>), 'span', '')")

    def step(a, s):
        headers, span = F.array_append(a["headers"], s["header"]), F.concat(a["span"], s["span"])
        full = F.length(span) >= least
        group = F.array(F.struct(headers.alias("headers"), span.alias("span")))
        return F.struct(
            F.when(full, F.concat(a["done"], group)).otherwise(a["done"]).alias("done"),
            F.when(full, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(headers).alias("headers"),
            F.when(full, "").otherwise(span).alias("span"),
        )

    def finish(a):
        rest = F.struct(a["headers"].alias("headers"), a["span"].alias("span"))
        n = F.size(a["done"])
        last = F.element_at(a["done"], -1)
        joined = F.struct(F.concat(last["headers"], a["headers"]).alias("headers"), F.concat(last["span"], a["span"]).alias("span"))
        groups = F.when(F.size(a["headers"]) == 0, a["done"]).when(n == 0, F.array(rest)).otherwise(F.concat(F.slice(a["done"], F.lit(1), n - 1), F.array(joined)))
        return F.transform(groups, lambda g: F.struct(F.substring(F.array_join(F.array_distinct(F.filter(g["headers"], lambda h: h != "")), " | "), 1, 300).alias("header"), g["span"].alias("span")))

    return F.aggregate(sections, zero, step, finish)


def _lists(kind: str, make):
    """An Arrow function of a text column to arrays of rows: make(text) gives a
    list of tuples, or of values where kind is a plain type. A text is walked once
    by character, which a fold over SQL strings can't do; the batch goes to Python
    and back as Arrow arrays."""

    def run(texts: pa.Array) -> pa.Array:
        found = [make(t or "") for t in texts.to_pylist()]
        flat = [x for rows in found for x in rows]
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        if isinstance(element, pa.StructType):
            cols = list(zip(*flat, strict=True)) or [[]] * element.num_fields
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, element, strict=True)], fields=list(element))
        else:
            values = pa.array(flat, element)
        return pa.ListArray.from_arrays(ends, values)

    element = to_arrow_type(DataType.fromDDL(kind)).value_type
    return F.arrow_udf(run, kind)


def spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, tail: int = 0) -> Column:
    """Array of (s, e) character ranges of column `text`: windows of size with
    late breaks at line ends and stops, overlapping, covering all; a last one
    below tail is balanced with the one before it."""
    return _lists("array<struct<s:int,e:int>>", lambda t: cut.spans(t, size, overlap, tail))(F.col(text))


def chunk_texts(text: str, tail: int = CHUNK_MIN) -> Column:
    """The stripped texts of the spans of column `text`, without blank ones."""
    return _lists("array<string>", lambda t: cut.pieces(t, CHUNK_SIZE, CHUNK_OVERLAP, tail))(F.col(text))


def file_chunks(text: str) -> Column:
    """Array of (header, section_no, chunk) of a Markdown file in column `text`:
    front matter goes, the body is cut at headings, small sections are joined, and
    each section is cut into spans. Empty for files over the size limit, or with
    almost no text."""
    small = F.when(F.octet_length(F.col(text)) <= MARKDOWN_BYTES, F.col(text))
    return _lists("array<struct<header:string,section_no:int,chunk:string>>", lambda t: cut.file_chunks(t, CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN, EMPTY_CHARS))(small)


def chunk_id(path: Column, file_hash: Column, index: Column) -> Column:
    return F.concat_ws("::", path, file_hash, F.lit(CHUNKING_VERSION), index.cast("string"))


def chunk_files(files: DataFrame, text: str = "text") -> DataFrame:
    """A row for each chunk of files (path, text and more): the files' other
    columns, file_hash, expected_chunk_count, header, section_no, chunk_index (in
    the file), chunk and id."""
    rows = files.withColumn("file_hash", content_hash(F.col(text))).withColumn("__chunks", file_chunks(text)).drop(text)
    rows = rows.withColumn("expected_chunk_count", F.size("__chunks")).select("*", F.posexplode("__chunks").alias("chunk_index", "__c"))
    rows = rows.select(*[c for c in rows.columns if not c.startswith("__")], "__c.header", "__c.section_no", "__c.chunk")
    return rows.withColumn("id", chunk_id(F.col("path"), F.col("file_hash"), F.col("chunk_index")))
