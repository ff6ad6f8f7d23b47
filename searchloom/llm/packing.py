"""Operator 7: packing of token ids into sequences of a fixed length.

Bounded-space online packing: a task keeps a fixed number of open windows,
places each document's tail where it fits best and, when it fits nowhere, fills
the fullest window with the tail's head and emits it. What is still open at the
end is poured together; the last sequences have powers of two as lengths, so
that no sequence needs padding.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.bpe import Encoder, read_ranks
from searchloom.llm.textcore import SEGMENT, flat_bytes, segments, trimmed, worker_cache, worker_slot

LENGTH, OPEN_WINDOWS, END_ID = 1024, 64, 0


class Packer:
    """Packs documents one at a time. sequences() yields, for each emitted
    sequence, its pieces (key, ids, start, doc_tokens) in order."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.length, self.windows = length, windows
        self.free: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.open: dict[int, list] = {}
        self.next = 0
        self.ready: list[list] = []

    def add(self, key, ids) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:
            self.ready.append([(key, ids[at : at + self.length], at, n)])
            at += self.length
        while at < n:
            size = n - at
            i = bisect.bisect_left(self.free, (size, -1))
            if i < len(self.free):
                self._put(i, (key, ids[at:n], at, n))
                return
            if len(self.free) < self.windows:
                self.open[self.next] = [(key, ids[at:n], at, n)]
                bisect.insort(self.free, (self.length - size, self.next))
                self.next += 1
                return
            gap = self.free[0][0]  # of the fullest
            self._put(0, (key, ids[at : at + gap], at, n))
            at += gap

    def _put(self, i: int, piece) -> None:
        left, w = self.free.pop(i)
        self.open[w].append(piece)
        left -= len(piece[1])
        if left:
            bisect.insort(self.free, (left, w))
        else:
            self.ready.append(self.open.pop(w))

    def emitted(self):
        out, self.ready = self.ready, []
        return out

    def finish(self):
        """Pours the open windows together, the fullest first."""
        left = sum(self.length - f for f, _ in self.free)
        sizes = [self.length] * (left // self.length) + [1 << b for b in reversed(range(self.length.bit_length())) if (left % self.length) >> b & 1]
        pieces = [p for _, w in self.free for p in self.open[w]]
        self.free, self.open = [], {}
        k = 0
        for size in sizes:
            own = []
            while size:
                key, ids, start, n = pieces[k]
                own.append((key, ids[:size], start, n))
                if len(ids) > size:
                    pieces[k] = (key, ids[size:], start + size, n)
                else:
                    k += 1
                size -= len(own[-1][1])
            self.ready.append(own)
        return self.emitted()


def pack(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, windows: int = OPEN_WINDOWS, end_id: int = END_ID, with_ids: bool = False, special: dict[bytes, int] | None = None) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, the piece's ids as little-endian 32-bit binary.

    A document's ids are those of the vocabulary at ranks_path (a rank file;
    the pre-tokens of the library's pattern), with those in special for the
    strings named there (as `added_tokens` reads them), then end_id; a null or
    empty text is end_id alone. Each id lies in one piece and pieces lie
    in a sequence without gaps. Sequences have length ids but for at most
    log2(length) a task, which have a smaller power of two. Rows are packed as
    they come, so repeated rows and null keys are documents like others; an
    empty table gives no pieces; ties don't arise, and other columns don't
    matter, whatever their names. Texts are taken whole; a worker holds about
    100 bytes a character of its longest text. sequence_id is the task's number
    and a count.
    """
    ranks = worker_cache(("ranks", ranks_path), lambda: read_ranks(ranks_path))
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    name = ranks_path

    def make():
        import tiktoken

        one = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        return Encoder(lambda tokens: [one(x.decode("utf-8", "surrogatepass")) for x in tokens], special)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = worker_slot(("pack_encoder", name, tuple(sorted((special or {}).items()))), make)
        packer, base, count = Packer(length, windows), TaskContext.get().partitionId() << 40, 0
        kind = None

        def rows(sequences):
            nonlocal count
            cols: list[list] = [[] for _ in range(8)]
            for pieces in sequences:
                at = 0
                for k, ids, start, n in pieces:
                    raw = ids.tobytes()
                    for c, v in zip(cols, (k, start, len(ids), zlib.crc32(raw), n, base + count, at, raw if with_ids else None), strict=True):
                        c.append(v)
                    at += len(ids)
                count += 1
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7])] + ([pa.array(cols[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            data, off = flat_bytes(batch.column(1))
            for i, j in segments(off, SEGMENT):
                ids, upto = encoder(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for r in range(j - i):
                    packer.add(keys[i + r], np.append(ids[upto[r] : upto[r + 1]], np.uint32(end_id)))
                yield rows(packer.emitted())
        if kind is not None:
            yield rows(packer.finish())

    source = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = f"k {source.schema['k'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    return source.mapInArrow(trimmed(run), schema).withColumnRenamed("k", key)
