"""Operator 4: byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.bpe import Encoder, TwoTier, read_ranks
from searchloom.llm.textcore import SEGMENT, flat_bytes, segments, trimmed, worker_cache, worker_slot


def encode(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", decode: bool = False) -> DataFrame:
    """key, n_tokens, token_ids (little-endian unsigned 32-bit) and, if asked
    for, decoded (the ids' bytes) of each row.

    A null text is an empty one: no ids. Rows are independent: null, repeated
    or equal keys pass through, other columns don't matter. Texts are taken
    whole; a worker holds about 100 bytes a character of its longest text.
    """
    spark = df.sparkSession
    tables = worker_cache(("two_tier", ranks_path), lambda: TwoTier(read_ranks(ranks_path)))
    shared = spark.sparkContext.broadcast(tables)  # as large as the vocabulary
    name = ranks_path

    def run(batches):
        import pyarrow as pa

        tier = shared.value
        encoder = worker_slot(("encoder", name), lambda: Encoder(tier))
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            for i, j in segments(off, SEGMENT):
                ids, upto = encoder(data[off[i] : off[j]], off[i : j + 1] - off[i])
                cols = [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(upto)),
                    pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((upto * 4).astype(np.int32)), pa.py_buffer(ids)]),
                ]
                if decode:
                    raw, ends = tier.decode(ids)
                    ends = np.append(0, ends)[upto].astype(np.int32)
                    cols.append(pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]))
                yield pa.RecordBatch.from_arrays(cols, names=["k", "n_tokens", "token_ids", "decoded"][: len(cols)])

    source = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    out = source.mapInArrow(trimmed(run), f"k {kind}, n_tokens bigint, token_ids binary" + (", decoded binary" if decode else ""))
    return out.withColumnRenamed("k", key)
