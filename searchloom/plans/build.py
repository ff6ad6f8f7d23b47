"""Vectors of a store's chunks: built part by part, and laid out by cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchloom.functions.text import content_hash
from searchloom.operators import vector
from searchloom.sources.index import ORDER, centroids, chunk_vectors, digests
from searchloom.sources.store import Store


def behind(store: Store) -> list[int]:
    """The parts whose chunks, by number and digest a section, aren't those that
    they have vectors of."""
    chunks = store.table("chunks")
    if chunks is None:
        return []
    now = digests(chunks.withColumn("chunk_hash", content_hash(F.col("chunk"))))
    held = store.table("digests")
    if held is None:
        return sorted(r[0] for r in now.select("bucket").distinct().collect())
    held = held.select("bucket", "section", F.col("chunks").alias("n"), F.col("digest").alias("d"))
    j = now.join(held, ["bucket", "section"], "full_outer")
    return sorted(r[0] for r in j.where("NOT (chunks <=> n AND digest <=> d)").select("bucket").distinct().collect())  # at most the number of parts


def build(store: Store, fingerprint: dict, turn: int = 4) -> list[int]:
    """Embeds the chunks of the parts that are behind, `turn` parts a publication,
    and keeps all other tables and vectors as they are. A build that stops is taken
    up where its last publication left it. Returns the parts it embedded."""
    store.check(fingerprint)
    name, todo = fingerprint["embedding_model"], behind(store)
    for at in range(0, len(todo), turn):
        parts = todo[at : at + turn]
        held = store.table("vectors", parts)
        rows = chunk_vectors(store.table("chunks", parts), name, held, centroids(store))
        store.publish({"vectors": rows, "digests": lambda t: digests(t("vectors"))}, fingerprint, "bucket", replaced=parts, order=ORDER)
    return todo


def lay_out(store: Store, fingerprint: dict, cells: int | None = None, recall: float = 0.95, limit: int = 10) -> int:
    """Learns cells from a bounded sample of the vectors, sorts every part's vectors
    by them, and measures how many of a query's nearest cells hold `recall` of its
    exact `limit` hits, which is what is returned and stored. Chunks that come
    later go to these cells; run it again when they have changed much."""
    rows = store.table("vectors")
    if rows is None:
        raise ValueError("the store has no vectors")
    found = vector.learn_cells(rows.select("id", "vector"), cells)
    placed = vector.with_cells(rows.drop("cell"), found)
    probes = vector.probes_for(placed.select("id", "vector", "cell"), found, recall, limit)
    table = store.spark.createDataFrame([(i, c, probes) for i, c in enumerate(found)], "cell int, centroid array<double>, probes int")
    parts = [int(k) for k in store.meta()["tables"]["vectors"]["parts"]]
    store.publish({"vectors": placed.select(*[c for c in rows.columns if c != "cell"], "cell"), "centroids": table}, fingerprint, "bucket", replaced=parts, order=ORDER)
    return probes
