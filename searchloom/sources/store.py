"""Versioned tables: a folder for each generation and a pointer to the current.

A generation is written under its own name, read back and compared with what was
written, and only then named by the pointer, whose file is replaced as a whole.
Readers resolve the pointer once. A writer that dies leaves the current
generation as it was. Tables may be laid out in parts by a column; a new
generation then writes the parts that changed, and its manifest names the older
ones, and the tables that weren't given, where they are.

Writers are kept apart by numbered claims, each made by one writer alone and held
for a lease, which a heartbeat prolongs. When its writer dies, a claim runs out and
the next number takes over; the number goes into the pointer, and a writer whose
claim isn't the last one any more can't set it.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from searchloom.contracts import CHUNKING_VERSION, LEXICAL_VERSION, LOCK_LEASE, LOCK_WAIT, METADATA_VERSION
from searchloom.sources.scratch import file_system, small_file, swept

#: The part of rows without a value to lay them out by.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
#: Parts of an index whose manifest doesn't say.
DEFAULT_BUCKETS = 16
#: Files that a task writes at once to tables in place, and the codec of all tables.
OPEN_FILES, COMPRESSION = 64, "zstd"


class Locked(RuntimeError):
    """Another writer holds the store."""


class Superseded(RuntimeError):
    """The writer's claim ran out and another writer has taken the store over."""


class PublicationError(RuntimeError):
    """What was written doesn't read back as it was."""


def in_place(make: Callable, sort: bool = True) -> Callable:
    """Marks a table of Store.publish, given as a function of tables laid out before
    it: its rows are made where those lie, so a task that reads one part has rows of
    that part alone, and they are written without a shuffle. Without sort they come
    in order already."""
    make.in_place, make.sort = True, sort
    return make


def facts(df: DataFrame):
    """Aggregates over rows with their hash h: how many there are and a fingerprint
    of them, whatever their order; and the expression of h."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return [F.count(F.lit(1)).alias("rows"), F.expr("coalesce(bit_xor(h), 0)").alias("f1"), F.expr("coalesce(bit_xor(xxhash64(h, 1)), 0)").alias("f2")], row


def part_facts(df: DataFrame, partition: str | None) -> dict[str, dict]:
    """The facts of each part of a table, by its name in the manifest."""
    totals, row = facts(df)
    part = F.col(partition).cast("string") if partition else F.lit("")
    found = df.withColumn("h", row).groupBy(F.coalesce(part, F.lit(NULL_PART)).alias("__part")).agg(*totals).collect()  # at most the number of parts
    return {r["__part"]: {k: r[k] for k in ("rows", "f1", "f2")} for r in found}


def total(held) -> dict:
    """The facts of a table from those of its parts."""
    out = {"rows": 0, "f1": 0, "f2": 0}
    for x in held:
        out = {"rows": out["rows"] + x["rows"], "f1": out["f1"] ^ x["f1"], "f2": out["f2"] ^ x["f2"]}
    return out


class Store:
    """Tables chunks, postings and others, in generations below root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = file_system(spark, self.root)[1]
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _read(self, name: str):
        text = small_file(self.spark, f"{self.root}/{name}")
        return None if text is None else json.loads(text)

    def _put(self, name: str, value: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def _write(self, name: str, value: dict) -> None:
        """The file as a whole: written aside, then renamed over the old one."""
        aside = f".{name}.{uuid.uuid4().hex}"
        self._put(aside, value)
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf).rename(self._path(f"{self.root}/{aside}"), self._path(f"{self.root}/{name}"), options)

    def _claims(self) -> list[int]:
        path = self._path(f"{self.root}/claims")
        if not self._fs.exists(path):
            return []
        return sorted(int(n) for s in self._fs.listStatus(path) if (n := s.getPath().getName()).isdigit())

    def _held(self, claim: int) -> bool:
        """Whether a claim is in force; one that is being written counts from its file's time."""
        try:
            value = self._read(f"claims/{claim:08d}")
            return not value.get("released") and value["expires"] > time.time()
        except (ValueError, KeyError, TypeError, AttributeError):
            path = self._path(f"{self.root}/claims/{claim:08d}")
            return self._fs.exists(path) and self._fs.getFileStatus(path).getModificationTime() / 1000 + LOCK_LEASE > time.time()

    @contextmanager
    def lock(self, wait: float = LOCK_WAIT, lease: float = LOCK_LEASE, heartbeat: bool = True):
        """Holds the store for one writer and gives its number; Locked if another one
        keeps it for `wait` seconds. A claim that isn't prolonged runs out after
        `lease` seconds, and then another writer may take the store."""
        until, owner = time.monotonic() + wait, uuid.uuid4().hex
        self._fs.mkdirs(self._path(f"{self.root}/claims"))
        while True:
            last = max(self._claims(), default=0)
            if not (last and self._held(last)):
                try:  # one writer alone makes this file
                    self._fs.create(self._path(f"{self.root}/claims/{last + 1:08d}"), False).close()
                    mine = last + 1
                    break
                except Exception as error:
                    if "xist" not in str(error):
                        raise
            if time.monotonic() >= until:
                raise Locked(f"{self.root} is being written")
            time.sleep(min(0.2, max(wait, 0.01)))
        name, done = f"claims/{mine:08d}", threading.Event()
        prolong = lambda: self._write(name, {"owner": owner, "expires": time.time() + lease})

        def beat():
            while not done.wait(lease / 3):
                if max(self._claims(), default=mine) != mine:
                    return  # another writer has taken over
                prolong()

        prolong()
        beating = threading.Thread(target=beat, daemon=True)
        if heartbeat:
            beating.start()
        try:
            yield mine
        finally:
            done.set()
            if heartbeat:
                beating.join()
            for n in self._claims():
                if n < mine:
                    self._fs.delete(self._path(f"{self.root}/claims/{n:08d}"), False)
            if max(self._claims(), default=mine) == mine:
                self._write(name, {"owner": owner, "expires": 0, "released": True})

    def _point(self, g: str, claim: int) -> None:
        """Sets the pointer, for the writer of the last claim alone."""
        held = self._read("current.json") or {}
        if max(self._claims(), default=claim) != claim or held.get("claim", 0) > claim:
            raise Superseded(f"another writer took {self.root} over")
        self._write("current.json", {"generation_id": g, "claim": claim})

    def current(self) -> str | None:
        pointer = self._read("current.json")
        return pointer and pointer["generation_id"]

    def meta(self) -> dict | None:
        """Fingerprint, contracts, row counts and manifest of the current generation."""
        g = self.current()
        return self._read(f"{g}/meta.json") if g else None

    def table(self, name: str, parts: list | None = None) -> DataFrame | None:
        """A table of the current generation, or those of its parts; a file that the
        manifest names and that isn't there is an error."""
        meta = self.meta()
        if not meta or name not in meta["tables"]:
            return None
        return self._parts(meta["tables"][name], parts)

    def _parts(self, held: dict, parts: list | None = None, **options: str) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        wanted = None if parts is None else {str(x) for x in parts}
        paths = [f"{self.root}/{p}" for k, p in held["parts"].items() if wanted is None or k in wanted]
        return self.spark.read.schema(schema).options(**options).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _there(self, held: dict) -> dict[str, str]:
        return {k: p for k, p in held["parts"].items() if self._fs.exists(self._path(f"{self.root}/{p}"))}

    def left(self, name: str) -> DataFrame:
        """What can still be read of a table that may be damaged."""
        held = self.meta()["tables"][name]
        return self._parts(held | {"parts": self._there(held)}, ignoreCorruptFiles="true", ignoreMissingFiles="true")

    def damaged(self) -> dict[str, list[str]]:
        """Tables of the current generation, each with its parts whose rows aren't
        those that were written: changed, lost, or in files that can't be read.
        Every part's fingerprint is compared with the manifest's, one aggregation a
        table. Parts that were written without fingerprints only have to be there."""
        out: dict[str, list[str]] = {}
        for name, held in (self.meta() or {"tables": {}})["tables"].items():
            there = self._there(held)
            by = held["laid"] if isinstance(held["laid"], str) else None
            found = {}
            if by or not held["laid"]:
                found = part_facts(self.left(name), by)
            told = held.get("facts", {})
            bad = [k for k in held["parts"] if k not in there or k in told and found.get(k) != told[k]]
            if bad:
                out[name] = sorted(bad)
        return out

    def buckets(self) -> int:
        """The number of parts, which stays as it was at first."""
        return (self.meta() or {}).get("buckets") or DEFAULT_BUCKETS

    def check(self, fingerprint: dict) -> None:
        """Refuses an index that another embedder made."""
        meta = self.meta()
        if meta and meta["fingerprint"] != fingerprint:
            raise ValueError(f"the index was made with {meta['fingerprint']}, not {fingerprint}")

    def publish(self, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], fingerprint: dict, partition: str | None = None, keep: int = 3, replaced: list | None = None, order: dict[str, list[str]] | None = None, wait: float = LOCK_WAIT, buckets: int | None = None) -> str:
        """Writes a generation, compares what reads back with what was written,
        points to it and deletes all but the newest `keep`. Returns its id.
        A table may be given as a function of those written before it, by name, so
        that what it is made of isn't computed anew.

        With partition, tables that have this column are laid out by it, sorted by
        order[name]. With replaced, tables holds these parts only, and the others,
        and tables that aren't given, stay those of the current generation. Without
        it the tables given are all there are.
        """
        with self.lock(wait) as claim:
            self.check(fingerprint)
            old = self.meta() if replaced is not None else None
            before = (old or {"tables": {}})["tables"]
            serial = (self._read("serial.json") or {"n": 0})["n"] + 1
            g = f"gen-{serial:08d}-{uuid.uuid4().hex[:8]}"
            manifest: dict = {}
            try:
                for name, df in tables.items():
                    still, sort = getattr(df, "in_place", False), getattr(df, "sort", True)
                    df = df(lambda n: self._parts(manifest[n] if n in manifest else before[n])) if callable(df) else df
                    manifest[name] = self._table(g, name, df, partition, (order or {}).get(name) if sort else None, still)
                gone = {str(x) for x in replaced or []}
                for name, held in before.items():
                    if name not in tables:
                        manifest[name] = held
                    elif held["laid"] and manifest[name]["laid"]:
                        stay = {k: p for k, p in held["parts"].items() if k not in gone}
                        manifest[name]["parts"] |= {k: p for k, p in stay.items() if k not in manifest[name]["parts"]}
                        manifest[name]["facts"] |= {k: f for k, f in held.get("facts", {}).items() if k in stay and k not in manifest[name]["facts"]}
                self._put(f"{g}/meta.json", {"fingerprint": fingerprint, "chunking": CHUNKING_VERSION, "metadata": METADATA_VERSION, "version": LEXICAL_VERSION, "buckets": buckets or (self.meta() or {}).get("buckets"), "written": {k: manifest[k]["rows"] for k in tables}, "tables": manifest})
                self._point(g, claim)
            except Exception:
                self._fs.delete(self._path(f"{self.root}/{g}"), True)
                raise
            self._write("serial.json", {"n": serial})
            self.purge(keep)
            return g

    @contextmanager
    def _open_writers(self):
        """Tasks hold a file open for each part they have rows of, instead of sorting
        their rows by part."""
        conf, name = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        old = conf.get(name, None)
        conf.set(name, OPEN_FILES)
        try:
            yield
        finally:
            conf.unset(name) if old is None else conf.set(name, old)

    def _table(self, g: str, name: str, df: DataFrame, partition: str | None, order: list[str] | None, still: bool = False) -> dict:
        """Writes one table and verifies it; its entry of the manifest. Rows that stay
        still are in_place; others are shuffled by part, and the shuffle's files go
        when the driver collects its garbage, so it is told to."""
        path, schema = f"{self.root}/{g}/{name}", df.schema
        totals, row = facts(df)
        seen = Observation()
        rows = df.withColumn("h", row).observe(seen, *totals).drop("h") if "h" not in df.columns else df
        laid = partition and partition in df.columns
        if laid:
            rows = rows.withColumn("__part", F.col(partition))
            if not still:
                rows = rows.repartition("__part")
            if order or not still:
                rows = rows.sortWithinPartitions("__part", *(order or []))
            with self._open_writers() if still and not order else nullcontext():
                rows.write.option("compression", COMPRESSION).partitionBy("__part").parquet(path)
            parts = {s.getPath().getName().removeprefix("__part="): f"{g}/{name}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(path)) if s.isDirectory()}
        else:
            rows.write.option("compression", COMPRESSION).parquet(path)
            parts = {"": f"{g}/{name}"}
        paths = [f"{self.root}/{p}" for p in parts.values()]
        back = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        held = part_facts(back, partition if laid else None)
        got = total(held.values())
        if "h" not in df.columns and got != seen.get:
            # a task that ran twice is observed twice, so the rows themselves decide
            if got != df.withColumn("h", row).agg(*totals).head().asDict():
                raise PublicationError(f"table {name} doesn't read back as it was written")
        if not still:
            del rows, df
            swept(self.spark)
        return {"schema": schema.jsonValue(), "laid": partition if laid else False, "parts": parts, "facts": held, "rows": got["rows"]}

    def purge(self, keep: int) -> list[str]:
        """Deletes the generations that are neither current, nor among the newest,
        nor named by a manifest of those."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and s.getPath().getName().startswith("gen-"))
        stay = {*names[-keep:], self.current()}
        used = set(stay)
        for n in stay:
            meta = self._read(f"{n}/meta.json") if n else None
            used |= {p.split("/")[0] for t in (meta or {"tables": {}})["tables"].values() for p in t["parts"].values()}
        gone = [n for n in names if n not in used]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return gone


def upsert(old: DataFrame, new: DataFrame, deleted: DataFrame | None = None, key: str = "id") -> DataFrame:
    """old without new's and deleted's keys, and new."""
    kept = old.join(new.select(key), key, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
