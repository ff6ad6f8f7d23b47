"""Operator 13: vectors as short codes, by product quantisation over whole numbers.

A vector is cut into equal parts. Equal parts of one position are one row with a
weight, and the rounds of Lloyd's algorithm run over these distinct rows: a
codebook is of bounded size and goes to all tasks, each of which returns one row
for each entry it met, however many parts it holds. The codes of the distinct
parts are then joined back to the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.tables import written
from searchloom.llm.vectors import LARGE, whole_numbers

#: Distinct parts that are compared with a codebook at once.
SLICE = 8192


def _numbers(a, width: int):
    """An Arrow list column of longs as a matrix of `width` columns."""
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assign(x, book):
    """(index of the nearest entry, its squared distance) for each row of x; ties
    go to the lower index. Exact: large numbers are Python's."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) >= LARGE:
        x, book = x.astype(object), book.astype(object)
    best, far = [np.zeros(0, np.int64)], [np.zeros(0, x.dtype)]
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        d = np.zeros((len(part), len(book)), x.dtype)
        for j in range(x.shape[1]):
            step = part[:, j, None] - book[None, :, j]
            d += step * step
        i = d.argmin(1)
        best.append(i)
        far.append(d[np.arange(len(part)), i])
    return np.concatenate(best), np.concatenate(far)


def _decimals(values):
    from decimal import Decimal

    import pyarrow as pa

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(distinct: DataFrame, books, width: int) -> list:
    """(pos, code, weight, sums) of all parts that each entry is nearest to; at
    most parts x entries rows, of which a task sends each once."""

    def run(batches):
        import pyarrow as pa

        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            pos, x, weight = batch.column(0).to_numpy(), _numbers(batch.column(1), width), batch.column(2).to_numpy()
            for p in np.unique(pos):
                own = np.flatnonzero(pos == p)
                code, _ = assign(x[own], books[p])
                mass = x[own].astype(object) if np.abs(x[own]).max(initial=0) >= LARGE or int(weight[own].sum()) >= LARGE else x[own]
                mass = mass * weight[own][:, None]
                o = np.argsort(code, kind="stable")
                heads = np.flatnonzero(np.append(True, code[o][1:] != code[o][:-1]))
                for c, w, s in zip(code[o][heads], np.add.reduceat(weight[own][o], heads), np.add.reduceat(mass[o], heads, axis=0), strict=True):
                    held = totals.setdefault((int(p), int(c)), [0] * (width + 1))
                    totals[int(p), int(c)] = [h + int(v) for h, v in zip(held, [w, *s], strict=True)]
        if totals:
            keys = list(totals)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * width, pa.int32()), _decimals([v for k in keys for v in totals[k][1:]]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([totals[k][0] for k in keys], pa.int64()), sums], names=["pos", "code", "weight", "sums"])

    rows = distinct.select("pos", "part", "weight").mapInArrow(run, "pos int, code int, weight long, sums array<decimal(38,0)>")
    total = [F.sum(F.col("sums")[j]).cast("decimal(38,0)").alias(f"s{j}") for j in range(width)]
    return rows.groupBy("pos", "code").agg(F.sum("weight").alias("weight"), *total).collect()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 for each row of df whose
    vector is neither null nor holds null or non-finite components.

    A component x becomes floor(scale * x), and a vector is cut into `parts` equal
    parts. A position's codebook starts as that part of the `entries` smallest keys
    (fewer if there are fewer rows). Each round gives every part to the nearest
    entry, ties to the lower index, and replaces each entry by its parts' mean,
    rounded down; an unused entry stays. code holds the indexes of the last
    assignment, two hexadecimal digits each; error is the sum of the squared
    distances, label_error the sum of errors over the rows with that label, nulls
    together, and codebooks_sha256 the digest of the final entries' numbers by
    part, entry and place, with commas between.

    Rows that repeat count each, and equal keys go by their vectors; a null key
    comes last. Vectors shorter than the longest one, or whose length isn't a
    multiple of parts, are filled up with zeros. Numbers beyond 2**55 in size count
    as 2**55; an error beyond a long is the largest long. An empty table gives no
    rows; columns but those named don't matter.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits, so a codebook at most 256 entries")
    spark = df.sparkSession
    rows = whole_numbers(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v")), scale)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"), "vectors")
    dim, most = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0)))))).head()
    result = f"`{key}` {rows.schema['id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if dim is None:
        return spark.createDataFrame([], result)
    width = max(1, -(-dim // parts))
    kind = "long" if most < LARGE else "decimal(38,0)"
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v")))
    cut = rows.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(filled, p * width + 1, width))).alias("pos", "part"))
    distinct = written(cut.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")

    first = rows.orderBy(F.col("id").asc_nulls_last(), "v", "row").limit(entries).select(filled.alias("v")).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(distinct, books, width):
            books[r.pos, r.code] = [int(r[f"s{j}"]) // r.weight for j in range(width)]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pos, x = batch.column(0).to_numpy(), _numbers(batch.column(1), width)
            code, far = np.zeros(len(pos), np.int64), np.zeros(len(pos), object if kind != "long" else np.int64)
            for p in np.unique(pos):
                own = np.flatnonzero(pos == p)
                code[own], far[own] = assign(x[own], books[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(far, pa.int64()) if kind == "long" else _decimals(far)], names=["pos", "part", "code", "error"])

    coded = written(distinct.select("pos", "part").mapInArrow(run, f"pos int, part array<long>, code long, error {kind}"), "coded")
    # eight codes of two digits each make a long
    digits = []
    for at in range(0, parts, 8):
        end = min(at + 8, parts) - 1
        digits.append(F.lpad(F.lower(F.hex(F.expr(f"bit_or(CASE WHEN pos BETWEEN {at} AND {end} THEN shiftleft(code, 8 * ({end} - pos)) ELSE 0L END)"))), 2 * (end - at + 1), "0"))
    total = lambda c: F.sum(c).cast(kind).alias(c)
    by_row = written(cut.join(coded, ["pos", "part"]).groupBy("row").agg(F.concat(*digits).alias("code"), total("error")), "codes")
    scored = written(rows.select("row", "id", "label").join(by_row, "row"), "scored")
    by_label = written(scored.groupBy(F.col("label").alias("of")).agg(F.sum("error").cast("decimal(38,0)").alias("label_error")), "labels")
    fit = lambda c: F.least(F.col(c).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias(c)
    out = scored.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", fit("error"), fit("label_error"), F.lit(digest).alias("codebooks_sha256"))
