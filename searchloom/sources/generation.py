"""Published generations of remote documents: a pointer names a generation, whose
manifest lists its documents, or names the tables that hold them.

A generation is written in a pending folder, read back and compared, given its
manifest, renamed to its own name, and only then named by the pointer. A writer that
dies between any two of these steps leaves the generation before as the current one;
its pending folder goes with the next publication.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.contracts import LOCK_WAIT
from searchloom.functions.text import decode_strict
from searchloom.operators.reconcile import INGESTION
from searchloom.sources.scratch import file_system, small_file
from searchloom.sources.store import PublicationError, Store, facts


class InconsistentGeneration(RuntimeError):
    """A generation that can't be read in whole; what is indexed stays."""


#: Of a written generation: its documents, and what was deleted at the source.
DOCUMENTS = "source_uid string, path string, status string, content_hash string, text string"
TOMBSTONES = "source_uid string, kind string"
PENDING = ".pending-"


class Generations(Store):
    """Writes generations of documents below root, one writer at a time."""

    def manifest(self) -> dict | None:
        """That of the current generation, if it was written by this class."""
        name = self.current()
        found = name and self._read(f"generations/{name}/manifest.json")
        if name and not found:
            raise InconsistentGeneration(f"generation {name} has no manifest")
        return found

    def rows(self, name: str) -> DataFrame:
        """documents or tombstones of the current generation; empty without one."""
        schema = {"documents": DOCUMENTS, "tombstones": TOMBSTONES}[name]
        found = self.manifest()
        if not found:
            return self.spark.createDataFrame([], schema)
        return _counted(self.spark, f"{self.root}/generations/{found['generation_id']}", found, name, schema)

    def previous(self) -> DataFrame:
        """(source_uid, status, content_hash, kind), as a step takes them."""
        documents = self.rows("documents").select("source_uid", "status", "content_hash", F.lit("document").alias("kind"))
        return documents.unionByName(self.rows("tombstones").select("source_uid", "kind"), allowMissingColumns=True)

    def put(self, documents: DataFrame, tombstones: DataFrame, keep: int = 3, wait: float = LOCK_WAIT, before: Callable[[str], None] = lambda step: None, base: str | None = None) -> str:
        """Publishes a generation and returns its id. `before` is called ahead of each
        step by its name: documents, manifest, rename, pointer, purge. With base, the
        publication is refused if that isn't the current generation any more."""
        folder = f"{self.root}/generations"
        with self.lock(wait) as claim:
            if base is not None and (self.current() or "") != base:
                raise PublicationError(f"the current generation isn't {base or 'none'} any more")
            left = [int(m[1]) for n in self._folders() if (m := re.match(r"g(\d{8})-", n))]  # a writer that died leaves its number too
            serial = max((self._read("serial.json") or {"n": 0})["n"], *left, 0) + 1
            name = f"g{serial:08d}-{uuid.uuid4().hex[:8]}"
            pending = f"{folder}/{PENDING}{name}"
            try:
                before("documents")
                seen = {}
                for table, rows, schema in (("documents", documents, DOCUMENTS), ("tombstones", tombstones, TOMBSTONES)):
                    rows = rows.select(*[c.split()[0] for c in schema.split(", ")])
                    rows.write.parquet(f"{pending}/{table}")
                    seen[table] = _facts_of(self.spark.read.schema(schema).parquet(f"{pending}/{table}"))
                    if seen[table] != _facts_of(rows):
                        raise PublicationError(f"{table} don't read back as they were written")
                before("manifest")
                self._put(f"generations/{PENDING}{name}/manifest.json", {"generation_id": name, "format": "parquet", "tables": seen})
                before("rename")
                if not self._fs.rename(self._path(pending), self._path(f"{folder}/{name}")):
                    raise PublicationError(f"{pending} couldn't be renamed")
                before("pointer")
                self._point(name, claim)
            except Exception:
                self._fs.delete(self._path(pending), True)
                raise
            self._write("serial.json", {"n": serial})
            before("purge")
            self._purge(keep)
            return name

    def _folders(self) -> list[str]:
        path = self._path(f"{self.root}/generations")
        return [s.getPath().getName() for s in self._fs.listStatus(path) if s.isDirectory()] if self._fs.exists(path) else []

    def _purge(self, keep: int) -> None:
        """Deletes pending folders, none of which is being written under this lock,
        and all generations but the newest `keep` and the current one."""
        found = self._folders()
        done = sorted(n for n in found if not n.startswith(PENDING))
        stay = {*done[-keep:], self.current()} if keep > 0 else {self.current()}
        for n in found:
            if n not in stay:
                self._fs.delete(self._path(f"{self.root}/generations/{n}"), True)


def _facts_of(rows: DataFrame) -> dict:
    aggregates, row = facts(rows)
    return rows.withColumn("h", row).agg(*aggregates).head().asDict()


def _counted(spark: SparkSession, folder: str, manifest: dict, name: str, schema: str) -> DataFrame:
    """A table of a written generation; one that has lost rows is an error."""
    p, fs = file_system(spark, f"{folder}/{name}")
    if not fs.exists(p):
        raise InconsistentGeneration(f"{folder} has no {name}")
    rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
    if rows.count() != manifest["tables"][name]["rows"]:
        raise InconsistentGeneration(f"{folder} lacks some of its {name}")
    return rows


def _document(spark: SparkSession, path: str):
    text = small_file(spark, path)
    return None if text is None else json.loads(text)


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """(domain, section, path, source_uid, text, readable) of the current
    generation's documents; None without a pointer. A pointer or manifest that
    isn't well formed, or a document that isn't there, is an error."""
    try:
        pointer = _document(spark, f"{root}/current.json")
        if pointer is None:
            return None
        name = pointer["generation_id"]
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise InconsistentGeneration(f"bad generation id {name!r}")
        manifest = _document(spark, f"{root}/generations/{name}/manifest.json")
    except (ValueError, KeyError, TypeError) as error:
        raise InconsistentGeneration(f"{root}: {error}") from error
    if manifest is None:
        raise InconsistentGeneration(f"generation {name} has no manifest")
    if manifest.get("format") == "parquet":
        held = _counted(spark, f"{root}/generations/{name}", manifest, "documents", DOCUMENTS)
        return held.select(F.lit(INGESTION).alias("domain"), F.lit("sources").alias("section"), "path", "source_uid", "text", F.col("text").isNotNull().alias("readable"))
    base = f"{root}/generations/{name}/documents"
    listed = spark.createDataFrame([(d["path"], d["source_uid"]) for d in manifest["documents"]], "path string, source_uid string")
    p, fs = file_system(spark, base)
    if not manifest["documents"]:
        found = spark.createDataFrame([], "path string, content binary")
    elif not fs.exists(p):
        raise InconsistentGeneration(f"generation {name} has no documents")
    else:
        prefix = fs.resolvePath(p).toString().rstrip("/") + "/"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(base)
        found = files.select(F.substring("path", len(prefix) + 1, 1 << 20).alias("path"), "content")
    missing = listed.join(found.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).head()
    if missing.n:
        raise InconsistentGeneration(f"generation {name} lacks {missing.n} documents, the first is {missing.first}")
    text = decode_strict(F.col("content"))
    return found.join(listed, "path").select(F.lit(INGESTION).alias("domain"), F.lit("sources").alias("section"), "path", "source_uid", text.alias("text"), text.isNotNull().alias("readable"))
