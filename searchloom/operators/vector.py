"""Cosine search over vector tables, and a deterministic hash embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from searchloom.contracts import CANDIDATES
from searchloom.functions.text import index_tokens
from searchloom.operators.topk import Running
from searchloom.sources.scratch import written

#: Embedders by name: functions of lists of texts to lists of vectors.
EMBEDDERS: dict[str, Callable] = {}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of double; null if either is all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def topk(vectors: DataFrame, query: list[float], condition: Column | None = None, limit: int = CANDIDATES, vector: str = "vector") -> DataFrame:
    """The `limit` rows nearest to one query by (distance, id): exact, one scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if condition is None else vectors.where(condition)
    scored = rows.withColumn("distance", 1 - cosine(F.col(vector).cast("array<double>"), q))
    return scored.where("distance IS NOT NULL").orderBy(F.round("distance", 9), "id").limit(limit)


#: Queries that all tasks hold at once; more are asked in turns.
BATCH_QUERIES = 4096


def topk_batch(vectors: DataFrame, queries: DataFrame, limit: int = CANDIDATES, vector: str = "vector", block: int = BATCH_QUERIES, cells: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of each query's nearest rows, exactly.

    A block of queries (query_id, vector) goes to all tasks, which multiply it
    with their own rows and keep the best of each query over all of them, so at
    most tasks x queries x limit rows are shuffled. Vectors of another length than
    the query's, null or all zeros take no part. With cells, vectors have a column
    cell and queries a column cells, an array, and a query meets the rows of its
    cells only.
    """
    asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("qv"), *(["cells"] if cells else [])).where("qv IS NOT NULL")
    turns = max(1, -(-asked.count() // block))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    out = None
    for turn in range(turns):
        mine = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        part = task_nearest(vectors, mine.collect(), limit, vector, queries.schema["query_id"].dataType.simpleString(), cells)
        part = part.withColumn("rank", rank).where(F.col("rank") <= limit)
        part = part if turns == 1 else written(part, "turn")
        out = part if out is None else out.unionByName(part)
    return out


def task_nearest(vectors: DataFrame, asked: list, limit: int, vector: str, kind: str, cells: bool = False) -> DataFrame:
    """(query_id, id, distance): each task's nearest rows of each query in asked."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    names = [r.query_id for r in asked]
    sizes: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        sizes.setdefault(len(r.qv), []).append(i)
    packs = {n: (np.array(own), np.array([asked[i].qv for i in own], float)) for n, own in sizes.items()}
    probes = [np.array(r.cells or [], int) for r in asked] if cells else None
    shared = vectors.sparkSession.sparkContext.broadcast((names, packs, probes))
    id_kind = vectors.schema["id"].dataType.simpleString()
    if cells:  # only these cells' row groups are read
        vectors = vectors.where(F.col("cell").isin(sorted({int(c) for p in probes for c in p})))
    types = [to_arrow_type(DataType.fromDDL(k)) for k in (kind, id_kind)]

    def run(batches):
        import pyarrow as pa

        names, packs, probes = shared.value
        best = Running(len(names), limit)
        for batch in batches:
            lens = np.asarray(batch.column(1).value_lengths().fill_null(-1))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(lens, 0))
            cell = batch.column(2).to_numpy()
            take = lambda r, ids=batch.column(0): np.array(ids.take(pa.array(r)).to_pylist(), object)
            for size, (which, q) in packs.items():
                length = np.sqrt((q * q).sum(1))
                for c in np.unique(cell[lens == size]):
                    rows = np.flatnonzero((lens == size) & (cell == c))
                    mine = np.arange(len(which)) if probes is None else np.flatnonzero([c in probes[i] for i in which])
                    if not len(mine):
                        continue
                    step = max(1, (1 << 22) // len(mine))
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        v = flat[(ends[part] - size)[:, None] + np.arange(size)]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            far = 1 - (v @ q[mine].T) / (np.sqrt((v * v).sum(1))[:, None] * length[mine])
                        far[~np.isfinite(far)] = np.inf
                        best.add(far, lambda r, part=part: take(part[r]), which[mine])
        found = best.rows()
        if found:
            query = [names[i] for i in found[0]]
            yield pa.RecordBatch.from_arrays([pa.array(query, types[0]), pa.array(found[2].tolist(), types[1]), pa.array(found[1])], names=["query_id", "id", "distance"])

    cell = F.col("cell") if cells else F.lit(0)
    return vectors.select("id", F.col(vector).cast("array<double>").alias("v"), cell.cast("int").alias("cell")).mapInArrow(run, f"query_id {kind}, id {id_kind}, distance double")


#: The embedder that needs no model, and its dimensions.
HASH, HASH_DIMS = "hash", 16


def hash_embedding(c: Column, dims: int = HASH_DIMS) -> Column:
    """Counts of a text's tokens by the first 8 hex digits of their MD5, modulo dims."""
    slot = F.transform(index_tokens(c), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))


def register_embedder(name: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
    """Names an embedder; make() is called once in each worker."""
    EMBEDDERS[name] = make


def known(name: str | None) -> bool:
    """Whether texts can be embedded by this name: a registered one, or HASH."""
    return name == HASH or name in EMBEDDERS


def embed(df: DataFrame, name: str, text: str = "chunk", out: str = "vector") -> DataFrame:
    """df with a vector column by an embedder, in Arrow batches."""
    if name == HASH:
        return df.withColumn(out, F.arrow_udf(_hash_vectors, "array<float>")(index_tokens(F.col(text))))
    import pandas as pd

    make = EMBEDDERS[name]

    def run(batches):
        model = make()
        for s in batches:
            yield pd.Series(list(model(s.tolist())))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def _hash_vectors(tokens: pa.Array) -> pa.Array:
    """hash_embedding of arrays of tokens; a token is hashed once a batch."""
    import hashlib

    import numpy as np

    flat = tokens.flatten().dictionary_encode()
    slot = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % HASH_DIMS for t in flat.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths().fill_null(0)))
    at = slot[flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat) else row
    counts = np.bincount(row * HASH_DIMS + at, minlength=len(tokens) * HASH_DIMS).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * HASH_DIMS, pa.int32()), pa.array(counts))


def embed_text(spark, name: str, text: str) -> list[float]:
    """One text's vector, a query's; HASH needs no job for it."""
    if name == HASH:
        return list(spark.sql("SELECT 1").select(hash_embedding(F.lit(text)).alias("vector")).head().vector)
    return [float(x) for x in embed(spark.createDataFrame([(text,)], "chunk string"), name).head().vector]


#: Vectors whose hash is least, from which cells are learnt, and queries by which their number to probe is.
CELL_SAMPLE, PROBE_SAMPLE, MOST_CELLS = 20_000, 256, 4096


def learn_cells(vectors: DataFrame, cells: int | None = None, sample: int = CELL_SAMPLE, seed: int = 11) -> list[list[float]]:
    """Centroids of spherical k-means over a bounded sample of vectors (id,
    vector), the square root of their number unless told. All-zero vectors, and
    those of another length than the first, are none of its."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.col("vector").cast("array<double>")
    usable = vectors.where(F.exists("vector", lambda x: x != 0)).select(F.xxhash64("id").alias("h"), v.alias("v"))
    n = usable.count()
    if not n:
        return []
    some = written(usable.orderBy("h").limit(sample), "sample")
    size = some.orderBy("h").select(F.size("v")).head()[0]
    k = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    data = some.where(F.size("v") == size).select(array_to_vector("v").alias("features"))
    model = KMeans(k=k, maxIter=10, seed=seed, distanceMeasure="cosine").fit(data) if k > 1 else None
    return [[float(x) for x in c] for c in model.clusterCenters()] if model else [[1.0] * size]


def nearest_cells(vector, centroids):
    """Cell numbers by falling cosine to each row of vector."""
    import numpy as np

    c = centroids / np.maximum(np.sqrt((centroids * centroids).sum(1)), 1e-300)[:, None]
    return np.argsort(-(vector @ c.T), axis=1, kind="stable")


def with_cells(df: DataFrame, centroids: list[list[float]], vector: str = "vector") -> DataFrame:
    """df with the cell of each vector; 0 without centroids, or where a vector is
    of another length."""
    if not centroids:
        return df.withColumn("cell", F.lit(0))
    import numpy as np

    shared = df.sparkSession.sparkContext.broadcast(np.array(centroids, float))

    def run(v: pa.Array) -> pa.Array:
        c = shared.value
        lens = np.asarray(v.value_lengths().fill_null(-1))
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.maximum(lens, 0))
        out, own = np.zeros(len(v), np.int32), np.flatnonzero(lens == c.shape[1])
        for at in range(0, len(own), step := max(1, (1 << 22) // len(c))):
            part = own[at : at + step]
            out[part] = nearest_cells(flat[(ends[part] - c.shape[1])[:, None] + np.arange(c.shape[1])], c)[:, 0]
        return pa.array(out)

    return df.withColumn("cell", F.arrow_udf(run, "int")(F.col(vector).cast("array<double>")))


def probes_for(vectors: DataFrame, centroids: list[list[float]], recall: float = 0.95, limit: int = 10, sample: int = PROBE_SAMPLE) -> int:
    """The least number of nearest cells that hold a share of `recall` of the
    exact hits of a sample of vectors (id, vector, cell) as queries."""
    import numpy as np

    if len(centroids) < 2:
        return 1
    asked = written(vectors.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("id")).limit(sample).select(F.col("id").alias("query_id"), "vector"), "asked")
    hits = topk_batch(vectors.select("id", "vector"), asked, limit + 1).where("id <> query_id").join(vectors.select("id", "cell"), "id")
    found = hits.select("query_id", "cell").collect()  # at most sample * limit rows
    c = np.array(centroids, float)
    place = {}
    for r in asked.collect():
        if len(r.vector) == c.shape[1]:
            place[r.query_id] = np.argsort(nearest_cells(np.array([r.vector], float), c)[0])
    ranks = np.sort([place[r.query_id][r.cell] for r in found if r.query_id in place])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else len(centroids)
