"""Files on disk or in a store as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.contracts import INCLUDED_SECTIONS, MARKDOWN_BYTES, PDF_BYTES
from searchloom.functions.paths import excluded, relative_to, section_of
from searchloom.functions.text import decode_strict


def roots(base: str, sections: Iterable[str] | None = None, whole_folder: bool = False) -> list[str]:
    """The folders to read: one section's, all included ones', or the base."""
    if whole_folder:
        return [base]
    return [f"{base.rstrip('/')}/{s}" for s in (sections or INCLUDED_SECTIONS)]


def scan(spark: SparkSession, base: str, sections: Iterable[str] | None = None, whole_folder: bool = False) -> DataFrame:
    """(path, section, content, size_bytes, modified, excluded) of the .md and .pdf
    files below the given sections; path is relative to base. Folders that don't
    exist give no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [r for r in roots(base, sections, whole_folder) if hadoop.Path(r).getFileSystem(conf).exists(hadoop.Path(r))]
    schema = "path string, section string, content binary, size_bytes bigint, modified timestamp, excluded boolean"
    if not there:
        return spark.createDataFrame([], schema)
    # listings leave out names that start with _ or a dot; such files are named one by one
    hidden = []
    for r in there:
        root = hadoop.Path(r)
        fs = root.getFileSystem(conf)
        found = fs.listFiles(root, True)
        above = fs.makeQualified(root).toString().rstrip("/") + "/"
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.lower().endswith((".md", ".pdf")) and any(p.startswith(("_", ".")) for p in name.removeprefix(above).split("/")):
                hidden.append(name)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,pdf,MD,PDF}")
    raw = reader.load(there)
    if hidden:
        raw = raw.unionByName(reader.load(hidden))
    # the reader skips the contents of what the pushed condition on length rules out
    cap = max(MARKDOWN_BYTES, PDF_BYTES)
    raw = raw.where(F.col("length") <= cap).unionByName(raw.where(F.col("length") > cap).withColumn("content", F.lit(None).cast("binary")))
    plain = F.regexp_replace("path", "^file:/*", "/")
    rows = raw.withColumn("path", relative_to(plain, base))
    return rows.select("path", section_of(F.col("path")).alias("section"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), excluded(F.col("path")).alias("excluded"))


def read_markdown(files: DataFrame) -> DataFrame:
    """files with text and status: too_large, read_error (bytes that aren't UTF-8)
    or ok."""
    rows = files.where(F.lower("path").endswith(".md") & ~F.col("excluded"))
    text = decode_strict(F.col("content"))
    return rows.withColumn("text", F.when(F.col("size_bytes") <= MARKDOWN_BYTES, text)).withColumn("status", F.when(F.col("size_bytes") > MARKDOWN_BYTES, "too_large").when(F.col("text").isNull(), "read_error").otherwise("ok"))


def read_pdf(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text, status) by a function from a file's bytes to its pages'
    texts; one row with extraction_error where it fails, empty without text."""

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for path, content, size in zip(b["path"], b["content"], b["size_bytes"], strict=True):
                if size > PDF_BYTES:
                    out.append((path, 0, None, "too_large"))
                    continue
                try:
                    pages = [(i, t) for i, t in enumerate(pages_of(bytes(content)), 1) if t and t.strip()]
                except Exception:  # a broken file is a status, not a failure
                    out.append((path, 0, None, "extraction_error"))
                    continue
                out += [(path, i, t, "ok") for i, t in pages] or [(path, 0, None, "empty")]
            yield pd.DataFrame(out, columns=["path", "page", "text", "status"])

    rows = files.where(F.lower("path").endswith(".pdf") & ~F.col("excluded")).select("path", "content", "size_bytes")
    return rows.mapInPandas(run, "path string, page int, text string, status string")


def out_of_policy(spark: SparkSession, base: str, included: Iterable[str] = INCLUDED_SECTIONS) -> list[str]:
    """Top-level folders that are neither included nor excluded: a driver listing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    kept = rows.where(~F.col("name").isin(*included) & ~excluded(F.concat("name", F.lit("/_probe"))))
    return sorted(r.name for r in kept.collect())
