"""Operator 12: ranked lexical search by branch and bound over trees of maxima.

`index` tokenises the documents and writes blocks of postings, a block being a row
of bounded size. `search` takes blocks of queries to all tasks. For each block of
documents and each term of a query it has a tree: the leaves are the documents
that hold the term, with their impacts, and a node over a range of documents has
the largest impact below it. The weighted maxima of a query's terms, summed, bound
every score in a range, so a query descends from the range of highest bound, and
stops when no range reaches its k-th score; ranges that equal it are opened, as
ties go by key. A task keeps each query's k best over all its blocks, so a block
whose root is below them isn't opened, and at most tasks x queries x k rows meet.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.llm.tables import written
from searchloom.llm.textcore import flat_bytes, ranges, segments, trimmed

#: A block is closed at so many documents or bytes of text; a longer text is a block.
BLOCK_DOCS, BLOCK_BYTES = 4096, 2 << 20
#: Blocks in a file, which one reader holds at once.
FILE_BLOCKS = 16
#: Ranges under a node.
FAN = 32
#: (query, term) pairs that a task holds at once; more queries are asked in turns.
PAIRS = 1_000_000

#: Bytes of words: ASCII letters and digits, and all of characters beyond ASCII.
_IS = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

BLOCK = "docs array<long>, lengths array<long>, terms array<string>, holds array<int>, place array<int>, tf array<int>"


def words(data, off):
    """(text of each word, the words as an Arrow array) of texts laid end to end:
    maximal runs of ASCII letters, digits and characters beyond ASCII, with only
    A-Z in lower case."""
    import pyarrow as pa

    inside = _IS[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    kept = _LOWER[data[inside]]
    places = np.append((np.cumsum(inside) - 1)[at], len(kept)).astype(np.int32)
    return np.searchsorted(off, at, side="right") - 1, pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(kept))


class _Block:
    """Postings of some documents, as they come."""

    def __init__(self):
        self.docs, self.lengths, self.n, self.size = [], [], 0, 0
        self.terms, self.code, self.place, self.tf = [], [], [], []

    def add(self, keys, data, off) -> None:
        import pyarrow as pa

        self.size += len(data)
        text, found = words(data, off)
        n = np.bincount(text, minlength=len(off) - 1)
        some = np.flatnonzero(n)
        if not len(some):
            return
        coded = found.dictionary_encode()
        slot = np.zeros(len(n), np.int64)
        slot[some] = np.arange(len(some))
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(some) + slot[text], return_counts=True)
        self.terms.append(coded.dictionary)
        self.code.append(pairs // len(some))
        self.place.append(pairs % len(some) + self.n)
        self.tf.append(tf)
        self.docs.append(keys.take(pa.array(some)))
        self.lengths.append(n[some])
        self.n += len(some)

    def row(self):
        """The block as a batch of one row, by term and place."""
        import pyarrow as pa

        coded = pa.chunked_array(self.terms).combine_chunks().dictionary_encode()
        new = coded.indices.to_numpy().astype(np.int64)
        base = np.cumsum([0, *(len(t) for t in self.terms)])
        code = np.concatenate([new[c + b] for c, b in zip(self.code, base, strict=False)])
        place, tf = np.concatenate(self.place), np.concatenate(self.tf)
        o = np.lexsort((place, code))
        holds = np.bincount(code, minlength=len(coded.dictionary))
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, kind))
        docs = pa.chunked_array(self.docs).combine_chunks()
        cols = [one(docs, None), one(np.concatenate(self.lengths), pa.int64()), one(coded.dictionary, None), one(holds, pa.int32()), one(place[o], pa.int32()), one(tf[o], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["docs", "lengths", "terms", "holds", "place", "tf"])


def index(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written blocks of df's documents. Documents without a word, null texts
    among them, are in none."""

    def run(batches):
        import pyarrow as pa

        block = _Block()
        for batch in batches:
            keys = batch.column(0)
            data, off = flat_bytes(batch.column(1))
            for i, j in segments(off, BLOCK_BYTES):
                for a in range(i, j, BLOCK_DOCS):  # empty texts have no bytes
                    b = min(j, a + BLOCK_DOCS)
                    if block.n and (block.size + off[b] - off[a] > BLOCK_BYTES or block.n + b - a > BLOCK_DOCS):
                        yield block.row()
                        block = _Block()
                    block.add(keys.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a])
        if block.n:
            yield block.row()
        pa.default_memory_pool().release_unused()

    rows = df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(trimmed(run), BLOCK)
    return written(rows, "lexical", maxRecordsPerFile=str(FILE_BLOCKS))


def terms_of(items: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term), once each, of items' texts; of equal keys the smallest text counts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            for i, j in segments(off, BLOCK_BYTES):
                text, found = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + i)), found], names=["id", "term"])

    one = items.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg(F.min(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("t"))
    return one.mapInArrow(run, "id long, term string").distinct()


def _block_terms(batch, r: int, value_set):
    """(places in value_set, places in the block's dictionary) of the terms of
    value_set that row r of a batch holds."""
    import pyarrow.compute as pc

    at = pc.index_in(batch.column("terms")[r].values, value_set=value_set).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
    return at[own].astype(np.int64), own


def _holders(blocks: DataFrame, terms) -> dict[str, int]:
    """How many documents hold each of the terms."""
    shared = blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import pyarrow as pa

        found, total = pa.array(shared.value, pa.string()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                which, own = _block_terms(batch, r, found)
                total[which] += batch.column("holds")[r].values.to_numpy()[own]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([found.take(pa.array(some)), pa.array(total[some])], names=["term", "df"])

    out = blocks.select("terms", "holds").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in out.toLocalIterator()}  # no more than the terms asked for


class MaxTree:
    """For each of some terms the tree of its largest impacts over ranges of the
    places below n. keys[l] are term * width[l] + range, ascending, and tops[l] the
    largest impact there; a range of level l + 1 holds FAN ranges of level l."""

    def __init__(self, term, place, impact, n: int):
        width = 1
        while width < n:
            width *= FAN
        self.width, self.keys, self.tops = [width], [term * width + place], [impact]
        while width > 1:
            width //= FAN
            up = self.keys[-1] // FAN
            heads = np.flatnonzero(np.append(True, up[1:] != up[:-1])) if len(up) else np.zeros(0, np.int64)
            self.keys.append(up[heads])
            self.tops.append(np.maximum.reduceat(self.tops[-1], heads) if len(heads) else self.tops[-1])
            self.width.append(width)

    def below(self, level: int, node: int, terms, weights):
        """(ranges, bounds) of the next level's ranges under a node, for a query
        of terms and weights; those without its terms are left out."""
        width, keys = self.width[level - 1], self.keys[level - 1]
        first = terms * width + node * FAN
        lo = np.searchsorted(keys, first)
        size = np.searchsorted(keys, first + min(FAN, width)) - lo
        at = ranges(lo, size)
        bounds = np.zeros(FAN, np.int64)
        np.add.at(bounds, keys[at] - np.repeat(first, size), np.repeat(weights, size) * self.tops[level - 1][at])
        some = np.flatnonzero(bounds)
        return some + node * FAN, bounds[some]


class _Best:
    """The k best of one query so far: higher scores, then smaller keys, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, null, doc) -> None:
        score, null, doc = (np.append(a, b) for a, b in ((self.score, score), (self.null, null), (self.doc, doc)))
        o = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.null, self.doc = score[o], null[o], doc[o]


def _descend(tree: MaxTree, bound: int, terms, weights, best: _Best, null, doc) -> int:
    """Opens ranges from the highest bound down until none reaches best; how many."""
    heap, opened = [(-bound, len(tree.keys) - 1, 0)], 0
    while heap and -heap[0][0] >= best.least:
        bound, level, node = heapq.heappop(heap)
        if level == 0:  # a tree of one document
            best.add([-bound], null[[node]], doc[[node]])
            continue
        opened += 1
        ranges_, bounds = tree.below(level, node, terms, weights)
        use = bounds >= best.least
        if level > 1:
            for b, r in zip(bounds[use].tolist(), ranges_[use].tolist(), strict=True):
                heapq.heappush(heap, (-b, level - 1, r))
        elif use.any():
            at = ranges_[use]
            best.add(bounds[use], null[at], doc[at])
    return opened


def search(blocks: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """key, rank, doc, score: the k documents of highest score above 0 for each of
    items, whatever the number of documents, over blocks made by `index`.

    With N documents that have a word, L words in all, n in a document, and a term
    in df documents and tf times in one, the term's weight w is
    floor(1000 * ln((2N + 2) / (2df + 1))) and a document's score the sum of
    w * (10**9 * tf div (1000 * tf + 8 * m)), where m = 10 + 90 * n * N div L, over
    an item's terms, once each; all but the logarithm is in whole numbers.

    Equal scores go to the smaller doc, null last; documents that repeat are hits
    of their own. Items without a key take no part, of several with one key the
    smallest text counts, and an item without words, a null text among them, has no
    hits. Empty tables give no rows; other columns don't matter.
    """
    spark = blocks.sparkSession
    asked = written(terms_of(items, key, text), "asked")
    n_docs, n_words = blocks.agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).head()
    turns = max(1, -(-asked.count() // PAIRS))
    out = None
    for turn in range(turns):
        mine = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn)
        part = _best_of_tasks(blocks, mine.orderBy("id", "term").toArrow(), k, n_docs or 0, n_words or 0)
        part = part.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))).where(F.col("rank") <= k)
        part = part.select(F.col("id").alias(key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc), "score")
        part = part if turns == 1 else written(part, "turn")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{key} long, rank int, {doc} long, score long")


def _best_of_tasks(blocks: DataFrame, asked, k: int, n_docs: int, n_words: int) -> DataFrame:
    """(id, doc, score): each task's best documents of each item in asked (id, term)."""
    ids = np.unique(asked.column("id").to_numpy())
    coded = asked.column("term").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    held = _holders(blocks, names)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) if t in held else 0 for t in names], np.int64)
    query, term = np.searchsorted(ids, asked.column("id").to_numpy()), coded.indices.to_numpy().astype(np.int64)
    o = np.argsort(term, kind="stable")
    # the queries of each term, term by term
    shared = blocks.sparkSession.sparkContext.broadcast((ids, names, weight, query[o], np.searchsorted(term[o], np.arange(len(names) + 1))))

    def run(batches):
        import pyarrow as pa

        ids, names, weight, query, start = shared.value
        found, best = pa.array(names, pa.string()), [_Best(k) for _ in ids]
        least = np.ones(len(ids), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                which, own = _block_terms(batch, r, found)
                if not len(which):
                    continue
                holds = batch.column("holds")[r].values.to_numpy().astype(np.int64)
                at = ranges((np.cumsum(holds) - holds)[own], holds[own])
                place, tf = (batch.column(c)[r].values.to_numpy()[at].astype(np.int64) for c in ("place", "tf"))
                lengths, docs = batch.column("lengths")[r].values.to_numpy(), batch.column("docs")[r].values
                null = np.asarray(docs.is_null())
                doc = docs.fill_null(0).to_numpy()
                m = 10 + 90 * lengths * n_docs // n_words
                tree = MaxTree(np.repeat(np.arange(len(own)), holds[own]), place, 1_000_000_000 * tf // (1000 * tf + 8 * m[place]), len(doc))
                size = start[which + 1] - start[which]
                who, local = query[ranges(start[which], size)], np.repeat(np.arange(len(which)), size)
                gain = weight[which][local] * tree.tops[-1][local]
                bound = np.zeros(len(ids), np.int64)
                np.add.at(bound, who, gain)
                o = np.argsort(who, kind="stable")
                edge = np.searchsorted(who[o], np.arange(len(ids) + 1))
                for q in np.flatnonzero(bound >= least):
                    terms = local[o[edge[q] : edge[q + 1]]]
                    _descend(tree, int(bound[q]), terms, weight[which][terms], best[q], null, doc)
                    least[q] = best[q].least
        rows = [len(b.score) for b in best]
        cat = lambda f, kind: np.concatenate([getattr(b, f) for b in best]) if best else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, rows), pa.int64()), pa.array(cat("doc", np.int64), pa.int64(), mask=cat("null", bool)), pa.array(cat("score", np.int64), pa.int64())], names=["id", "doc", "score"])

    return blocks.mapInArrow(trimmed(run), "id long, doc long, score long")
