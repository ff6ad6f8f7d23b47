"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.jaccard import shingle_sets
from searchloom.llm.textcore import SEGMENT, U64, mix, segments, trimmed

#: Labelled documents taken of each class at most, and the longest text taken.
SAMPLE, SAMPLE_CHARS = 2500, 20_000


def remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo; null keys count as held out nowhere."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def picked(docs: DataFrame, labels: DataFrame, label: str, train, text: str = "text", key: str = "doc_id", size: int = SAMPLE, chars: int = SAMPLE_CHARS):
    """(rows, share): rows (k, t, y) of at most size documents of each class, those of
    least hash, for which the condition train holds; share is that of label 1
    among all labels for which it holds. Rows without key, text or label, texts
    over chars characters, and labels without such a document are left out before
    the sample is taken, so it has size documents of a class if there are as many;
    of rows with one key the smallest text counts. An empty table gives no rows."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(train).groupBy(key).agg(F.max(label).alias("y"))
    count = {r.y: r["count"] for r in marks.where("y IN (0, 1)").groupBy("y").count().collect()}
    usable = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull() & (F.length(text) <= chars))
    there = marks.where("y IN (0, 1)").join(usable.select(key), key, "left_semi")
    chosen = None
    for y in (0, 1):
        part = there.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(size)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = usable.select(F.col(key), F.col(text).alias("t")).join(F.broadcast(chosen), key)  # at most 2 * size rows
    return rows.groupBy(F.col(key).alias("k"), "y").agg(F.min("t").alias("t")), count.get(1, 0) / max(1, sum(count.values()))


def sample(docs: DataFrame, labels: DataFrame, label: str, train, text: str = "text", key: str = "doc_id", size: int = SAMPLE, chars: int = SAMPLE_CHARS):
    """(texts, labels, share) of the documents picked, on the driver."""
    rows, share = picked(docs, labels, label, train, text, key, size, chars)
    found = [(r.t, r.y) for r in rows.orderBy(F.xxhash64("k"), "k").toLocalIterator()]
    return [t for t, _ in found], [y for _, y in found], share


def fitted(fit: Callable, docs: DataFrame, labels: DataFrame, label: str, train, text: str = "text", key: str = "doc_id"):
    """fit(texts, labels, share) of the documents picked, called in a task, as the
    sample and the work on it would fill the driver; what it returns, of built-in
    types and arrays, comes back."""
    rows, share = picked(docs, labels, label, train, text, key)

    def run(batches):
        import pyarrow as pa

        texts, ys = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, ys, share))], pa.binary())], names=["made"])

    whole = rows.repartition(1).sortWithinPartitions(F.xxhash64("k"), "k").select("t", "y")  # at most 2 * SAMPLE rows
    found = whole.mapInArrow(trimmed(run), "made binary").collect()
    return pickle.loads(found[0].made) if found else None


def without_copies(texts: list[str], ys: list[int], seeds: int = 4):
    """(texts, labels) without copies and near copies, which would make chance
    words of theirs look telling: a text goes if one of `seeds` min-hashes of its
    five-word shingles is that of an earlier one."""
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    seen: set = set()
    keep = []
    for i, j in segments(off, SEGMENT // 4):
        for k, s in enumerate(shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], 5), i):
            marks = {(m, int(mix(s ^ mix(np.array([m + 1], U64))).min())) for m in range(seeds)} if len(s) else {("", texts[k])}
            if not marks & seen:
                keep.append(k)
            seen |= marks
    return [texts[k] for k in keep], [ys[k] for k in keep]
