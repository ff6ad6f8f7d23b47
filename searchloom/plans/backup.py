"""Copies of a store: every file with its SHA-256, checked byte by byte."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.operators.metrics import manifest_diff
from searchloom.sources.scratch import file_system
from searchloom.sources.store import Store

#: Bytes that a task holds of a file.
PIECE = 8 << 20
MANIFEST = "path string, bytes bigint, sha string"


class DamagedCopy(RuntimeError):
    """Files that aren't what the backup's manifest says."""


def _place(root: str):
    """(file system, path) of a folder, for a task, without the session."""
    from pyarrow import fs

    if root.startswith("file:") or ":" not in root.split("/")[0]:
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def _copied(batches: Iterator, source: str, target: str | None) -> Iterator:
    """Reads each file once, in pieces; with target, copies it under a name of its
    own and then names it as it shall be, so that a task that runs again, or twice
    at a time, leaves a whole file."""
    import pandas as pd

    held, above = _place(source)
    there, below = _place(target) if target else (None, None)
    for b in batches:
        out = []
        for path in b["path"]:
            digest, size, sink = hashlib.sha256(), 0, None
            if there:
                final = f"{below}/{path}"
                folder = final.rpartition("/")[0]
                there.create_dir(folder, recursive=True)
                aside = f"{folder}/.copy-{uuid.uuid4().hex}"
                sink = there.open_output_stream(aside)
            with held.open_input_stream(f"{above}/{path}") as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    size += len(piece)
                    if sink:
                        sink.write(piece)
            if sink:
                sink.close()
                there.move(aside, final)
            out.append((path, size, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["path", "bytes", "sha"])


def _files(spark: SparkSession, folders: list[str], root: str) -> DataFrame:
    """(path below root, length) of the data files in folders; listed by Spark, their
    contents aren't read. Dealt out file by file, the large ones first."""
    if not folders:
        return spark.createDataFrame([], "path string, length bigint")
    p, fs = file_system(spark, root)
    above = fs.resolvePath(p).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root}/{f}" for f in folders])
    rows = rows.select(F.substring("path", len(above) + 1, 1 << 20).alias("path"), "length")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "path")


def _run(files: DataFrame, source: str, target: str | None) -> DataFrame:
    return files.select("path").mapInPandas(lambda batches: _copied(batches, source, target), MANIFEST)


def _folders(meta: dict) -> list[str]:
    return sorted({p for t in meta["tables"].values() for p in t["parts"].values()})


def backup(store: Store, target: str) -> DataFrame:
    """Copies the current generation to target, which must not exist, under the
    writers' lock, and gives its manifest (path, bytes, sha). Tasks copy the files,
    one at a time each in pieces of 8 MB; the manifest is a table beside them. The
    pointer of the copy is written last, so one without it is no backup."""
    spark, target = store.spark, target.rstrip("/")
    p, fs = file_system(spark, target)
    if fs.exists(p):
        raise FileExistsError(target)
    with store.lock():
        meta = store.meta()
        if meta is None:
            raise FileNotFoundError(f"{store.root} has no generation")
        copy = Store(spark, target)
        _run(_files(spark, _folders(meta), store.root), store.root, f"{target}/files").write.parquet(f"{target}/manifest")
        copy._put("meta.json", meta)
        wrong = verify(spark, target, pointer=False)
        if first := wrong.orderBy("path").head():
            raise DamagedCopy(f"{first.path} of {target}: {first.state}")
        copy._put("backup.json", {"generation_id": store.current()})
    return manifest(spark, target)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def verify(spark: SparkSession, target: str, pointer: bool = True) -> DataFrame:
    """(path, state) of the backup's files that aren't as its manifest says: changed,
    removed or added. Every byte is read again, by tasks."""
    if pointer and not Store(spark, target)._read("backup.json"):
        raise FileNotFoundError(f"{target} is no whole backup")
    p, fs = file_system(spark, f"{target}/files")
    now = _run(_files(spark, ["."] if fs.exists(p) else [], f"{target}/files"), f"{target}/files", None)
    return manifest_diff(manifest(spark, target).select("path", "sha"), now.select("path", "sha")).where("state <> 'same'")


def restore(spark: SparkSession, target: str, root: str) -> Store:
    """The store of a backup, at root, which must not exist. Files whose bytes aren't
    the manifest's are named by DamagedCopy; the pointer is set last, so what is
    refused is never read."""
    target, root = target.rstrip("/"), root.rstrip("/")
    held = Store(spark, target)._read("backup.json")
    if not held:
        raise FileNotFoundError(f"{target} is no whole backup")
    p, fs = file_system(spark, root)
    if fs.exists(p):
        raise FileExistsError(root)
    meta, g = Store(spark, target)._read("meta.json"), held["generation_id"]
    told = manifest(spark, target)
    _run(told, f"{target}/files", root).write.mode("overwrite").parquet(f"{root}/.restored")
    # what lies there now is read again: a copy is believed by its own bytes alone
    now = _run(told.repartition(max(spark.sparkContext.defaultParallelism, 2), "path"), root, None)
    wrong = manifest_diff(told.select("path", "sha"), now.select("path", "sha")).where("state <> 'same'")
    found = wrong.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).head()
    if found.n:
        fs.delete(p, True)
        raise DamagedCopy(f"{found.n} files aren't as they were saved, the first is {found.first}")
    store = Store(spark, root)
    store._put(f"{g}/meta.json", meta)
    store._write("serial.json", {"n": int(g.split("-")[1])})
    with store.lock() as claim:
        store._point(g, claim)
    return store
