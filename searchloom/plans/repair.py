"""Repair of a store: only the parts that aren't what they should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import CHUNKING_VERSION
from searchloom.operators import vector
from searchloom.operators.chunking import chunk_files
from searchloom.sources.index import ORDER, centroids, index_tables, needed, path_bucket
from searchloom.sources.store import Store

#: Tables that have a row for each chunk of their part.
BY_ID = ("forward", "vectors")


class Unrepairable(RuntimeError):
    """Parts that can't be made again from what is left."""


def diverging(store: Store) -> DataFrame:
    """(table, bucket) of the derived tables' parts whose ids aren't those of the
    part's chunks. Each side is counted and digested where it lies, so a row a part
    is all that moves; which ids they are isn't asked."""
    digest = lambda df: df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"))
    tables = (store.meta() or {"tables": {}})["tables"]
    out = store.spark.createDataFrame([], "table string, bucket int")
    if "chunks" not in tables:
        return out
    want = digest(store.left("chunks").select("bucket", "id"))
    side = lambda df, s: df.select("bucket", *[F.col(c).alias(c + s) for c in ("n", "a", "b")])
    for name in BY_ID:
        if name in tables:
            got = digest(store.left(name).select("bucket", "id"))
            j = side(want, "1").join(side(got, "2"), "bucket", "full_outer")
            out = out.unionByName(j.where("NOT (n1 <=> n2 AND a1 <=> a2 AND b1 <=> b2)").select(F.lit(name).alias("table"), F.col("bucket").cast("int").alias("bucket")))
    return out


def repair(store: Store, fingerprint: dict, files: DataFrame | None = None) -> dict[str, list[str]]:
    """Makes the parts again that are damaged or whose ids diverge from their chunks,
    publishes them as a generation that keeps all others where they are, and returns
    them by table (empty if all is well, and then nothing is written).

    Derived tables are made from the part's chunks, vectors that were sound are kept.
    Where chunks themselves are damaged, files (path, text and more, as they are
    indexed) are chunked again for that part alone; without files that is
    Unrepairable, as is a damaged table without parts. A store whose vectors no
    registered embedder can make is refused.
    """
    store.check(fingerprint)
    wrong = {k: set(v) for k, v in store.damaged().items()}
    lost = {int(p) for p in wrong.get("chunks", ())}
    for r in diverging(store).collect():  # at most tables x parts
        wrong.setdefault(r.table, set()).add(str(r.bucket))
    meta, name = store.meta(), fingerprint.get("embedding_model")
    if not wrong:
        return {}
    if whole := sorted(t for t in wrong if not meta["tables"][t]["laid"]):
        raise Unrepairable(f"{', '.join(whole)} can't be made from the chunks")
    if lost and files is None:
        raise Unrepairable(f"chunks of the parts {sorted(lost)} are damaged; their files are needed")
    embeds = "vectors" in meta["tables"]
    if embeds and not vector.known(name):
        raise Unrepairable(f"no embedder {name!r} is registered")
    buckets, parts = store.buckets(), sorted({int(p) for ps in wrong.values() for p in ps})
    chunks = store.table("chunks", [p for p in parts if p not in lost]).drop("bucket")
    if lost:
        again = chunk_files(files.where(path_bucket(F.col("path"), buckets).isin(*lost))).withColumn("chunking_version", F.lit(CHUNKING_VERSION))
        chunks = chunks.unionByName(again.select(*[c if c in again.columns else F.lit(None).alias(c) for c in chunks.columns]))
    sound = [p for p in parts if str(p) not in wrong.get("vectors", ())]
    held = store.table("vectors", sound) if embeds and sound else None
    tables = index_tables(chunks, buckets, embedder=name if embeds else None, held=held, centroids=centroids(store) if embeds else None)
    store.publish({k: v for k, v in needed(tables, tuple(meta["tables"])).items() if k in meta["tables"]}, fingerprint, "bucket", replaced=parts, order=ORDER, buckets=buckets)
    return {k: sorted(v, key=int) for k, v in wrong.items()}
