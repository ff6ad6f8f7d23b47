"""Operators 1 and 6: exact and approximate top-k search over vectors.

The exact search lays queries and candidates out in blocks of bounded size and
meets each pair of blocks in one group, so the only work is queries x candidates
and no task holds more than one block of each. The approximate one writes a tree
for each block of candidates and takes the queries to the trees, in turns.
"""

from __future__ import annotations

import heapq
import math
import pickle
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.llm.tables import blocks_of, spread, written
from searchloom.llm.textcore import trimmed

QUERY_BLOCK = 2048
#: Whole numbers from this size on are multiplied as Python's; those over MOST count as MOST.
LARGE, MOST = 1 << 27, 1 << 55


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id, v) of the rows that take part: a key, a vector, no component null or
    not finite and, unless zero, not all components 0."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = F.col(key).isNotNull() & v.isNotNull() & ~bad
    if not zero:
        keep &= F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(keep, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def whole_numbers(df: DataFrame, scale: float | None = None, vector: str = "v") -> DataFrame:
    """The rows of df whose vector takes part, an all-zero one too, with its
    components as whole numbers: floor(scale * x), or x without its fraction.
    Beyond MOST in size they are MOST."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    near = lambda x: F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST)))
    whole = (lambda x: F.floor(near(F.lit(float(scale)) * x)).cast("long")) if scale else (lambda x: near(x).cast("long"))
    return df.where(F.coalesce(v.isNotNull() & ~bad, F.lit(False))).withColumn(vector, F.transform(v, whole))


def block_pairs(queries: DataFrame, candidates: DataFrame, block: int):
    """Rows (qb, cb, q, id, v), for each pair of a query and a candidate block.
    Queries, whose ids are distinct, are dealt by id, as they come out of a shuffle,
    and candidates by their place in the input; both are the same in a second run."""
    n_c, n_q = (blocks_of(x.count(), size) for x, size in ((candidates, block), (queries, QUERY_BLOCK)))
    c = candidates.withColumn("cb", spread(n_c)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    return c.select("qb", "cb", F.lit(False).alias("q"), "id", "v").unionByName(q.select("qb", "cb", F.lit(True).alias("q"), "id", "v")).groupBy("qb", "cb")


def split_block(table):
    """(query ids, query matrix, candidate ids, candidate matrix); shorter
    vectors are filled up with zeros."""
    table = table.combine_chunks()
    m = matrix(table.column("v"))
    ids = table.column("id").to_numpy()
    q = table.column("q").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(ids[~q], kind="stable")
    return ids[q], m[q], ids[~q][order], m[~q][order]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, ranked from 1."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrow(query_id, vec_id, score, kind):
    import pyarrow as pa

    return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, kind)})


def top_rows(scores, ids, k: int):
    """Columns of each row's k highest scores, ties to the smaller id; ids ascend."""
    n = scores.shape[1]
    k = min(k, n)
    cut = np.partition(scores, n - k, axis=1)[:, n - k]
    for r in range(len(scores)):
        hit = np.flatnonzero(scores[r] >= cut[r])
        yield hit[np.argsort(-scores[r, hit], kind="stable")[:k]]


def exact_topk(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner
    products over all rows of df but those with its own key.

    Vectors are taken as sparse rows of integer weights. A block's postings, one
    list a component, are scattered term by term into dense arrays of scores;
    a partition finds each block's k best and a window merges the blocks.

    Rows with a null key or vector, or a component null or not finite, take no
    part; an all-zero vector scores 0; a shorter vector lacks its last terms. Of
    several query rows with one key the smallest vector counts; candidates that
    repeat are rows of their own. Ties go to the smaller key. Weights of any size
    are multiplied and ordered exactly, large ones as Python's numbers; beyond
    2**55 they count as 2**55, and a score that leaves a long is given as the
    nearest long. Empty tables give no rows; other columns don't matter.
    """
    rows = whole_numbers(df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id IS NOT NULL"))
    asked = whole_numbers(queries.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id IS NOT NULL"))
    size = lambda c: F.greatest(F.abs(F.array_max(c)), F.abs(F.array_min(c)))
    most, dim = rows.agg(F.coalesce(F.max(size("v")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    asked_most = asked.agg(F.coalesce(F.max(size("v")), F.lit(0))).head()[0]
    slim = F.col("v").cast("array<int>") if max(most, asked_most) < 1 << 31 else F.col("v")
    large = most * asked_most * dim >= 1 << 62
    number, none, kind = (object, -(1 << 126), "decimal(38,0)") if large else (np.int64, np.iinfo(np.int64).min, "long")
    q = asked.groupBy("id").agg(F.min("v").alias("v")).select("id", slim.alias("v"))

    def score(table):
        import pyarrow as pa

        qid, qm, cid, cm = split_block(table)
        out: list[tuple] = []
        if len(qid) and len(cid) and cm.shape[1]:
            postings = []
            for t in range(cm.shape[1]):
                rows = np.flatnonzero(cm[:, t])
                postings.append((slice(None) if len(rows) == len(cid) else rows, cm[rows, t].astype(number)))
            for at in range(0, len(qid), 32):
                part = qm[at : at + 32].astype(number)
                acc = np.zeros((len(part), len(cid)), number)
                for r, row in enumerate(part):
                    own = acc[r]
                    for t in np.flatnonzero(row):
                        ids, weights = postings[t]
                        own[ids] += row[t] * weights
                lo, hi = (np.searchsorted(cid, qid[at : at + 32], side=s) for s in ("left", "right"))
                for r in range(len(part)):
                    acc[r, lo[r] : hi[r]] = none
                for r, cols in enumerate(top_rows(acc, cid, k)):
                    cols = cols[(cols < lo[r]) | (cols >= hi[r])]
                    out.append((np.full(len(cols), qid[at + r]), cid[cols], acc[r, cols]))
        who, hit, got = [np.concatenate(x) for x in zip(*out, strict=True)] or [[], [], []]
        return _arrow(who, hit, [Decimal(int(x)) for x in got] if large else got, pa.decimal128(38, 0) if large else pa.int64())

    found = block_pairs(q, rows.select("id", slim.alias("v")), block).applyInArrow(score, f"query_id long, vec_id long, score {kind}")
    best = best_of(found, k)
    edge = lambda n: F.lit(n).cast("decimal(38,0)")
    return best.withColumn("score", F.greatest(F.least("score", edge((1 << 63) - 1)), edge(-(1 << 63))).cast("long")) if large else best


class ProjectionTree:
    """A kd-tree over Gaussian (2-stable) projections of a block of vectors.

    Inner products become distances by one more coordinate that gives all
    vectors the block's largest norm. A search descends from the root with a heap of
    boxes, nearest first. What lies nearer to the query's projection than the next
    box comes in rising order and is verified by its whole vector, some at a time.
    The query stops when a vector nearer than its k-th would, with probability below
    1 - sure, still lie beyond the projected distance reached: the squared ratio of
    projected to true distance follows a chi-square law with as many degrees as
    there are projections.
    """

    #: Vectors that are verified between two tests, and that are sorted at once.
    VERIFY, SORTED = 192, 6144

    def __init__(self, x, ids=None, dims: int = 16, leaf: int = 1024, seed: int = 11):
        self.dims = dims
        norm2 = np.einsum("ij,ij->i", x, x)
        self.big2 = float(norm2.max())
        last = np.sqrt(np.maximum(self.big2 - norm2, 0))
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, dims))
        p = x @ self.a[:-1] + last[:, None] * self.a[-1]
        rows = np.arange(len(x))
        start, stop, left = [0], [len(x)], [0]
        node = 0
        while node < len(start):  # nodes by breadth; the children of one are left and left + 1, a leaf has none
            a, b = start[node], stop[node]
            if b - a > leaf:
                own = rows[a:b]
                axis = int(np.ptp(p[own], axis=0).argmax())
                rows[a:b] = own[np.argpartition(p[own, axis], (b - a) // 2)]
                left[node] = len(start)
                start += [a, a + (b - a) // 2]
                stop += [a + (b - a) // 2, b]
                left += [0, 0]
            node += 1
        self.start, self.stop, self.left = start, stop, left
        self.ids = (np.arange(len(x)) if ids is None else ids)[rows]
        self.x, p = np.ascontiguousarray(x[rows]), p[rows]
        self.short = (self.x / max(math.sqrt(self.big2), 1e-150)).astype(np.float32)  # for a first look at a vector
        self.pp, self.pt = np.einsum("ij,ij->i", p, p), np.ascontiguousarray(p.T)
        self.lo = np.array([p[a:b].min(0) for a, b in zip(start, stop, strict=True)])
        self.hi = np.array([p[a:b].max(0) for a, b in zip(start, stop, strict=True)])
        self.verified = self.opened = 0  # rows, over all queries

    def _chi_square(self, v: float) -> float:
        """P(chi-square with dims degrees <= v); dims is even."""
        half, term, total = min(v / 2, 700.0), 1.0, 1.0
        for i in range(1, self.dims // 2):
            term *= half / i
            total += term
        return 1 - math.exp(-half) * total

    def search(self, q, own, k: int, sure: float, bound=None):
        """For each query the places (in x) of up to k rows, fewer if bound, a k-th
        inner product known already, shuts others out; own are the queries' ids,
        whose rows don't count."""
        out = []
        for i, v in enumerate(q):
            known = -math.inf if bound is None or not math.isfinite(bound[i]) else float(bound[i])
            out.append(self._one(v, own[i], k, sure, known))
        return out

    def _one(self, v, own, k: int, sure: float, known: float):
        pv, q2 = v @ self.a[:-1], float(v @ v)
        scale = math.sqrt(max(q2 * self.big2, 1e-300))
        if known > scale * (1 + 1e-9):
            return np.zeros(0, np.int64)  # no row of the block reaches it
        rows, ips = np.zeros(0, np.int64), np.zeros(0)
        worst, short = known / scale, (v / max(math.sqrt(q2), 1e-150)).astype(np.float32)

        def verify(hit):
            nonlocal rows, ips, worst
            self.verified += len(hit)
            for i in range(0, len(hit), self.VERIFY):
                some = hit[i : i + self.VERIFY]
                use = np.take(self.short, some, axis=0).dot(short) >= worst - 1e-5  # short floats err by less
                if use.any():
                    some = some[use]
                    rows, ips = np.append(rows, some), np.append(ips, np.round(np.einsum("ij,j->i", self.x[some], v) / scale, 12))  # so that equal vectors tie
                    o = np.lexsort((self.ids[rows], -ips))[:k]
                    rows, ips = rows[o], ips[o]
                    if len(ips) >= k:
                        worst = max(worst, float(ips[-1]))

        def enough(radius: float) -> bool:
            if worst == -math.inf:
                return False
            d2 = max(q2 + self.big2 - 2 * worst * scale, 0.0)
            return radius > 0 if d2 == 0 else self._chi_square(radius / d2) >= sure

        heap, wait, near, least = [(0.0, 0)], [], [], math.inf
        mine, pp, pv2 = np.flatnonzero(self.ids == own), float(pv @ pv), 2 * pv
        while heap:
            gap, node = heapq.heappop(heap)
            if gap > least:  # vectors that are nearer than any box that isn't open
                at, far = np.concatenate(wait), np.concatenate(near)
                come = far < gap
                verify(at[come])
                if enough(gap):
                    return rows
                wait, near = [at[~come]], [far[~come]]
                least = float(near[0].min(initial=math.inf)) * 1.02  # some at a time
            child = self.left[node]
            if child:
                away = np.maximum(np.maximum(self.lo[child : child + 2] - pv, pv - self.hi[child : child + 2]), 0)
                for c, g in enumerate(np.einsum("ij,ij->i", away, away).tolist()):
                    heapq.heappush(heap, (g, child + c))
                continue
            a, b = self.start[node], self.stop[node]
            self.opened += b - a
            d = self.pp[a:b] - pv2.dot(self.pt[:, a:b]) + pp
            if len(mine):
                d[mine[(mine >= a) & (mine < b)] - a] = math.inf
            wait.append(np.arange(a, b))
            near.append(d)
            least = min(least, float(d.min()))
        at, far = np.concatenate(wait), np.concatenate(near)
        n = 0
        while n < len(far):  # the next ones in rising order, sorted as far as they are needed
            most = min(len(far), n + self.SORTED)
            if most < len(far):
                o = np.argpartition(far[n:], most - n - 1)
                at[n:], far[n:] = at[n:][o], far[n:][o]
            o = np.argsort(far[n:most])
            at[n:most], far[n:most] = at[n:most][o], far[n:most][o]
            for m in range(n, most, self.VERIFY):
                end = min(most, m + self.VERIFY)
                if enough(float(far[m])) or far[m] == math.inf:
                    return rows
                verify(at[m : min(end, int(np.searchsorted(far[n:most], math.inf)) + n)])
            n = most
        return rows


#: Rows of a tree, and queries that all tasks hold at once.
TREE_BLOCK, QUERY_TURN = 16_384, 16_384


def trees(rows: DataFrame, block: int = TREE_BLOCK, dims: int = 16) -> DataFrame:
    """(place, top, tree): the written trees of rows (id, v), in blocks of about
    `block` rows by norm; place rises with the norm, and top is a block's largest."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dealt = rows.select("id", "v", norm.alias("norm")).repartitionByRange(blocks_of(rows.count(), block), "norm", F.xxhash64("id"), F.monotonically_increasing_id())

    def run(batches):
        import pyarrow as pa

        parts = list(batches)  # a block
        if sum(len(b) for b in parts):
            t = pa.Table.from_batches(parts)
            ids, x, place = t.column("id").to_numpy(), matrix(t.column("v")), t.column("place")[0].as_py()
            order = np.argsort(ids, kind="stable")
            tree = ProjectionTree(x[order], ids[order], dims)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([math.sqrt(tree.big2)]), pa.array([pickle.dumps(tree.__dict__, 5)], pa.binary())], names=["place", "top", "tree"])

    return written(dealt.select("id", "v", F.spark_partition_id().alias("place")).mapInArrow(run, "place int, top double, tree binary"), "trees", maxRecordsPerFile="1")


def matrix(col):
    """A column of lists as a matrix; shorter ones are filled up with zeros."""
    import pyarrow.compute as pc

    lists = col.combine_chunks()
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, dim = lists.flatten().to_numpy(zero_copy_only=False), int(lens.max(initial=0))
    if (lens == dim).all():
        return flat.reshape(len(lens), dim)
    m = np.zeros((len(lens), dim), flat.dtype)
    m[np.arange(dim)[None, :] < lens[:, None]] = flat
    return m


def search_trees(held: DataFrame, asked: list, k: int, sure: float, known: dict | None = None) -> DataFrame:
    """(query_id, vec_id, score): what each task's trees hold of the best of the
    queries asked (id, v); known are k-th products found already."""
    ids, vs = np.array([r.id for r in asked], np.int64), [np.array(r.v, float) for r in asked]
    bound = np.array([(known or {}).get(r.id, -np.inf) for r in asked])
    shared = held.sparkSession.sparkContext.broadcast((ids, vs, bound))

    def run(batches):
        import pyarrow as pa

        ids, vs, bound = shared.value
        bound, best = bound.copy(), [[np.zeros(0), np.zeros(0, np.int64)] for _ in ids]
        for batch in batches:
            for raw in batch.column(0):
                tree = ProjectionTree.__new__(ProjectionTree)
                tree.__dict__.update(pickle.loads(raw.as_py()))
                dim = tree.x.shape[1]
                fit = lambda v, dim=dim: v[:dim] if len(v) >= dim else np.append(v, np.zeros(dim - len(v)))
                for i, hit in enumerate(tree.search([fit(v) for v in vs], ids, k, sure, bound)):
                    if len(hit):
                        score = np.append(best[i][0], np.einsum("j,ij->i", fit(vs[i]), tree.x[hit]))
                        found = np.append(best[i][1], tree.ids[hit])
                        o = np.lexsort((found, -score))[:k]
                        best[i] = [score[o], found[o]]
                        if len(o) == k:
                            bound[i] = max(bound[i], score[o][-1])
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            score, found = (np.concatenate([b[c] for b in best]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return held.select("tree").mapInArrow(trimmed(run), "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = TREE_BLOCK, dims: int = 16, sure: float = 0.9, turn: int = QUERY_TURN) -> DataFrame:
    """query_id, rank, vec_id, score: for each query about its k largest inner
    products (double precision, on the whole vectors) over the rows of df but
    those with its own key; score and order are exact for what is found.

    Every row is indexed, in blocks by norm with a ProjectionTree each, built once
    and written. Queries go to the trees in turns of bounded size; the block of the
    largest norms answers first, and its k-th products bound the search in the
    others. A task keeps each query's k best over its blocks. Rows with a null key
    or vector, an all-zero vector, or a component null or not finite take no part; a
    shorter vector is filled up with zeros; of several query rows with one key the
    smallest vector counts; rows of df that repeat count each. Ties go to the
    smaller key. An empty table gives no rows, and other columns don't matter,
    whatever their names.
    """
    asked = written(usable(queries, key, vector, False).groupBy("id").agg(F.min("v").alias("v")), "asked")
    held = trees(usable(df, key, vector, False), block, dims)
    last = held.agg(F.max("place")).head()[0]
    turns, out = blocks_of(asked.count(), turn), None
    for n in range(turns):
        mine = (asked if turns == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == n)).collect()
        first = written(best_of(search_trees(held.where(F.col("place") == last), mine, k, sure), k), "first")
        known = {r.query_id: r.score for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}  # one a query of the turn
        rest = search_trees(held.where(F.col("place") < last), mine, k, sure, known)
        part = best_of(first.select("query_id", "vec_id", "score").unionByName(rest), k)
        part = part if turns == 1 else written(part, "turn")
        out = part if out is None else out.unionByName(part)
    return out
