"""Operator 2: suffix-array removal of long repeated strings.

A byte goes if a string of `length` bytes around it also starts earlier: in a
document with a smaller key, or earlier in the same one. All starts are judged,
without sorting all suffixes:

1. Anchors. Of the 64 short grams in each window the one of least hash is its
   anchor (leftmost on ties), so windows of equal bytes have the same anchor.
   Successive windows with one anchor are a run; its bytes are its context.
2. Each task sorts the suffixes that start its contexts (deep-shallow sorting);
   equal neighbours repeat the earliest of them, window by window.
3. The earliest ones meet by anchor gram. An equal context elsewhere repeats
   in whole. Where one gram has several contexts, their bytes are fetched and
   the suffixes of all their windows are sorted; equal windows are repeats.
4. Grams with too many contexts for one task aren't compared: the windows of
   their contexts get anchors anew, from fewer and longer grams, and go on from
   2; the last grams are the whole windows, where equal ones are equal contexts.
   Tasks take common grams of their own rows to longer ones by themselves and
   leave one marked row, which sends the gram's contexts of other tasks after
   them. So a common passage reaches no task in whole, and the rows stay in
   proportion to the contexts.

What meets over tasks are 128-bit fingerprints and positions, and bytes only of
contexts whose gram has several; each task sends one row a distinct context,
however often its copies occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.llm.suffixes import padded, sort_suffixes
from searchloom.llm.tables import released, with_rest, written
from searchloom.llm.textcore import SEGMENT, U64, byte_values, flat_bytes, mix, powers, prefix_hash, ranges, segments, span_hash, trimmed

LENGTH, GRAMS = 100, 64
#: Bytes of text whose contexts are sorted together.
SORT_BYTES = 8 << 20
#: Contexts with one gram that one task compares; more go on with longer grams.
CROWD = 256
#: Contexts with one gram among those sorted together from which on it is common.
COMMON = 32
#: Kinds: 0 the earliest with its context, 1 repeats in whole, 2 marks a common gram.
FOUND = "kind int, level int, khash long, chash long, doc long, th long, lo long, hi long"


def anchor_runs(data, off, length: int = LENGTH, grams: int = GRAMS):
    """Runs of windows with one anchor in texts laid end to end: (text, lo, hi,
    gram hash, context hash), lo and hi being the first and last window's start
    in data."""
    n = len(data)
    gram = length - grams + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2
    c = prefix_hash(byte_values()[data])
    _, down = powers(n)
    kh = mix((c[gram:] - c[:-gram]) * down[: n - gram + 1])
    m = (kh & U64(0xFFFFFFFF00000000)) | np.arange(len(kh), dtype=U64)
    done = 1
    while done < grams:
        step = min(done, grams - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    anchor = (m & U64(0xFFFFFFFF)).astype(np.int64)
    lens = np.diff(off)
    big = np.flatnonzero(lens >= length)
    edge = np.zeros(n + 1, np.int64)
    edge[off[big]] += 1
    np.subtract.at(edge, off[big] + lens[big] - length + 1, 1)
    ok = np.cumsum(edge)[: len(anchor)] > 0
    start = ok.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    start[off[big]] = True
    lo = np.flatnonzero(start)
    stop = ok.copy()
    stop[:-1] &= (start[1:]) | ~ok[1:]
    hi = np.flatnonzero(stop)
    text = np.searchsorted(off, lo, side="right") - 1
    return text, lo, hi, kh[anchor[lo]], span_hash(c, lo, hi + length)


def _first_of_groups(order, same, ranks):
    """For sorted strings: (group of each place, the member of least rank of each)."""
    group = np.cumsum(~same) - 1
    o = np.lexsort((ranks[order], group))
    heads = np.flatnonzero(np.append(True, group[o][1:] != group[o][:-1])) if len(order) else np.zeros(0, np.int64)
    return group, order[o][heads]


def _rank_of(*keys):
    """Dense ranks of rows by keys, the first key counting most; equal rows tie."""
    o = np.lexsort(keys[::-1])
    step = np.zeros(len(o), np.int64)
    if len(o):
        step[1:] = np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0)
    out = np.empty(len(o), np.int64)
    out[o] = np.cumsum(step)
    return out


def _signed(h):
    return np.ascontiguousarray(h).view(np.int64)


def _arrow(cols, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c), pa.int32() if k in ("kind", "level") else pa.int64()) for c, k in zip(cols, names, strict=True)], names=names)


def _levels(length: int) -> list[int]:
    """Grams in a window, level by level; one gram is the whole window."""
    most = min(GRAMS, max(1, length - 24))
    return sorted({most, *(g for g in (33, 9, 1) if g < most)}, reverse=True)


def _contexts(length: int, levels: list[int], level: int, many: int, crowd_bytes: bool):
    """Steps 2 and 4 for rows (doc, th, lo, text) of a task, text being a
    document's bytes from lo on: FOUND of the contexts at `level`, and at later
    ones for what is common here; with crowd_bytes the contexts' bytes too."""
    names = [x.split()[0] for x in FOUND.split(", ")] + ["ctx"] * crowd_bytes

    def judged(level, data, doc, th, at, lo, span, kh, ch):
        """at: where each context starts in data; lo: in its document; span: windows less one."""
        buf = padded(data)
        order, same = sort_suffixes(buf, at, span + length)
        rank = _rank_of(doc, th, lo)
        group, head = _first_of_groups(order, same, rank)
        lead = np.empty(len(order), np.int64)
        lead[order] = head[group]
        again = rank[lead] != rank
        kind = np.where(again, 1, -1)
        kind[head] = 0
        key = _signed(mix(kh + U64(level)))
        key[again] = _signed(mix(doc[again].view(U64) * U64(31) + lo[again].astype(U64)))
        deep = np.zeros(0, np.int64)
        if level + 1 < len(levels):
            _, which, size = np.unique(kh[head], return_inverse=True, return_counts=True)
            deep = head[size[which] >= many]
            kind[deep] = -1
            o = deep[np.lexsort((rank[deep], kh[deep]))]
            kind[o[np.append(True, kh[o][1:] != kh[o][:-1])[: len(o)]]] = 2
        pick = np.flatnonzero(kind >= 0)
        if len(pick):
            yield _arrow([kind[pick], np.full(len(pick), level), key[pick], _signed(ch[pick]), doc[pick], th[pick], lo[pick], (lo + span)[pick], *([_bytes_of(data, at[pick], span[pick] + length)] if crowd_bytes else [])], names)
        if len(deep):
            lens = span[deep] + length
            own = data[ranges(at[deep], lens)]
            off = np.append(0, np.cumsum(lens))
            text, a, b, kh, ch = anchor_runs(own, off, length, levels[level + 1])
            yield from judged(level + 1, own, doc[deep][text], th[deep][text], a, lo[deep][text] + a - off[text], b - a, kh, ch)

    def flush(parts):
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        at = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
        cols = [np.concatenate([p[k] for p in parts]) for k in range(8) if k != 3]
        yield from judged(level, cols[0], cols[1], cols[2], at, *cols[3:])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            doc, th, shift = (batch.column(k).to_numpy() for k in (0, 1, 2))
            data, off = flat_bytes(batch.column(3))
            for i, j in segments(off, SEGMENT):
                # a longer text goes in pieces, which share the bytes of one window less one
                whole = j - i > 1 or off[j] - off[i] <= SEGMENT
                for x in (off[i],) if whole else range(off[i], off[j] - length + 1, SEGMENT - length + 1):
                    y = off[j] if whole else min(off[j], x + SEGMENT)
                    own, o = data[x:y], np.clip(off[i : j + 1] - x, 0, y - x)
                    text, a, b, kh, ch = anchor_runs(own, o, length, levels[level])
                    if len(a):
                        lo = a - o[text] + shift[i:j][text] + (0 if whole else x - off[i])
                        parts.append((own, doc[i:j][text], th[i:j][text], a, lo, b - a, kh, ch))
                        held += len(own)
                    if held >= SORT_BYTES:
                        yield from flush(parts)
                        parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _bytes_of(data, at, lens):
    import pyarrow as pa

    off = np.append(0, np.cumsum(lens)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[ranges(at, lens)]))])


def _windows(length: int):
    """Step 3 for rows (khash, doc, th, lo, hi, ctx) sorted by khash: (doc, th,
    lo, hi), the runs of windows that repeat an earlier one of their gram."""
    names = ["doc", "th", "lo", "hi"]

    def flush(doc, th, lo, hi, data, off):
        n_w = hi - lo + 1
        row = np.repeat(np.arange(len(lo)), n_w)
        at = ranges(off[:-1], n_w)
        order, same = sort_suffixes(padded(data), at, np.full(len(at), length))
        pos = at - off[row] + lo[row]
        rank = _rank_of(doc[row], th[row], pos)
        group, head = _first_of_groups(order, same, rank)
        lead = np.empty(len(order), np.int64)
        lead[order] = head[group]
        a = np.flatnonzero(rank[lead] != rank)
        if len(a):
            new = np.append(True, (np.diff(a) != 1) | (row[a][1:] != row[a][:-1]))
            s, e = a[new], a[np.append(new[1:], True)]
            yield _arrow([doc[row[s]], th[row[s]], pos[s], pos[e]], names)

    def run(batches):
        held: list = []
        size = 0

        def join():
            cols = [np.concatenate(x) for x in zip(*(h[:-2] for h in held), strict=True)]
            data = np.concatenate([h[-2] for h in held])
            off = np.append(0, np.cumsum(np.concatenate([np.diff(h[-1]) for h in held])))
            return [*cols, data, off]

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            data, off = flat_bytes(batch.column(5))
            for i, j in segments(off, SEGMENT // 4):
                held.append([*(c[i:j] for c in cols), data[off[i] : off[j]], off[i : j + 1] - off[i]])
                size += int(off[j] - off[i])
                if size < SEGMENT:
                    continue
                khash, doc, th, lo, hi, own, o = join()
                # all groups but the last, which may go on
                cut = int(np.flatnonzero(khash != khash[-1])[-1]) + 1 if khash[0] != khash[-1] else 0
                if cut:
                    yield from flush(doc[:cut], th[:cut], lo[:cut], hi[:cut], own[: o[cut]], o[: cut + 1])
                held = [[khash[cut:], doc[cut:], th[cut:], lo[cut:], hi[cut:], own[o[cut] :], o[cut:] - o[cut]]]
                size = len(held[0][-2])
        if held:
            yield from flush(*join()[1:])

    return run


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, th, text): a null key sorts first; th tells rows with one key apart."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("th"), t.alias("t"))


def _met(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of FOUND after equal contexts have met: again, whether it repeats in
    whole, and for the others contexts, how many its gram has, and marked,
    whether the gram is common somewhere. Grams of one context only go."""
    place = [F.col("doc"), F.col("th"), F.col("lo")]
    same = W.partitionBy("khash", "chash").orderBy(*place)
    gram = W.partitionBy("khash")
    rows = rows.repartition("khash").withColumn("nth", F.rank().over(same)).withColumn("no", F.row_number().over(same))
    rows = rows.withColumn("contexts", F.sum(F.when((F.col("kind") != 1) & (F.col("no") == 1), 1).otherwise(0)).over(gram)).withColumn("marked", F.max(F.col("kind") == 2).over(gram))
    rows = rows.withColumn("again", (F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("nth") > 1)))
    later = F.col("level") > 0  # contexts and marks of later levels wait for those that come after them
    wanted = (F.col("no") == 1) & (F.col("kind") == 0) & ((F.col("contexts") > 1) | F.col("marked") | later)
    return rows.where(F.col("again") | wanted | ((F.col("kind") == 2) & later)).select("again", "kind", "level", "khash", "chash", "doc", "th", "lo", "hi", "contexts", "marked", *more)


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, crowd: int = CROWD, common: int = COMMON) -> DataFrame:
    """(doc, th, spans): for each document with repeats the array of (start, end)
    byte ranges, possibly overlapping, of the strings of `length` bytes that
    also start earlier. crowd and common say how the work is dealt and don't
    change results."""
    levels = _levels(length)
    docs = _keyed(df, text, key)
    small = docs.where(F.octet_length("t") >= length)
    raw = small.select("doc", "th", F.lit(0).cast("long").alias("lo"), "t").mapInArrow(trimmed(_contexts(length, levels, 0, common, False)), FOUND)
    found = written(_met(raw), "contexts")
    ctx = F.substring(F.col("t").cast("binary"), F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo") + length).cast("int")).alias("ctx")
    pool = [written(found.where("NOT again").join(small, ["doc", "th"]).select("kind", "level", "khash", "chash", "doc", "th", "lo", "hi", "contexts", "marked", ctx), "fetched")]
    marks = [written(found.where("again").select("doc", "th", "lo", "hi"), "again")]
    released(found)
    held = [*marks, *pool]
    rows = pool[0].where("level = 0")
    deepest = lambda x: x.agg(F.max("level")).first()[0] or 0
    last, level = deepest(pool[0]), 0
    while level <= last:
        if level:
            union = None
            for x in pool:
                x = x.where(F.col("level") == level).select("kind", "level", "khash", "chash", "doc", "th", "lo", "hi", "ctx")
                union = x if union is None else union.unionByName(x)
            rows = written(_met(union, "ctx"), "longer")
            marks.append(rows.where("again"))
            held.append(rows)
            rows = rows.where("NOT again AND kind = 0")
        few = (F.col("contexts") <= crowd) & ~F.col("marked")
        dealt = rows.where(few & (F.col("contexts") > 1)).select("khash", "doc", "th", "lo", "hi", "ctx").repartition("khash").sortWithinPartitions("khash")
        windows = written(dealt.mapInArrow(trimmed(_windows(length)), "doc long, th long, lo long, hi long"), "windows")
        marks.append(windows)
        held.append(windows)
        if level + 1 < len(levels):
            longer = rows.where(~few).select("doc", "th", "lo", "ctx").mapInArrow(trimmed(_contexts(length, levels, level + 1, common, True)), FOUND + ", ctx binary")
            pool.append(written(longer, "crowds"))
            held.append(pool[-1])
            last = max(last, deepest(pool[-1]))
        level += 1
    span = F.struct(F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    out = None
    for m in marks:
        m = m.select("doc", "th", span.alias("s"))
        out = m if out is None else out.unionByName(m)
    spans = written(out.groupBy("doc", "th").agg(F.collect_list("s").alias("spans")), "spans")
    released(*held)
    return spans


def merge_spans(starts, ends):
    """Maximal runs covered by the ranges, as (starts, ends)."""
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(new[1:], True)]


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep: list[str] | None = None, whole_characters: bool = False, **dealt: int) -> DataFrame:
    """key, n_bytes, spans (maximal removed runs of bytes, start and end), kept
    (the other bytes in order), and the columns of df named in keep.

    A document's bytes are its text's UTF-8; a null text is empty, and texts
    below `length` bytes lose nothing. Rows with a null key count as smallest;
    rows with one key but different texts count as different documents ordered
    by a hash of the text; rows that repeat in whole are one document and all
    get its result; ties don't arise. An empty table gives no rows, and columns
    beside key and text don't matter, whatever their names. Long texts are taken
    whole: windows are judged in pieces of 1 MiB, and a worker holds a text and
    its kept bytes. With whole_characters, runs shrink to whole characters, so
    that kept is valid UTF-8.
    """
    keep = [c for c in (keep or []) if c != key]
    spans = repeated_spans(df, text, key, length, **dealt)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("th"), t.alias("t"), F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("_")]).alias("rest"))
    joined = base.join(spans, ["doc", "th"], "left")
    rows = joined.select("k", "rest", F.col("t"), F.col("spans.start").alias("s"), F.col("spans.end").alias("e"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = flat_bytes(batch.column(2))
            starts, ends = batch.column(3), batch.column(4)
            out_s, out_e, kept = [], [], []
            for r in range(batch.num_rows):
                own = data[off[r] : off[r + 1]]
                if not starts[r].is_valid:
                    out_s.append([])
                    out_e.append([])
                    kept.append(own.tobytes())
                    continue
                s, e = merge_spans(np.asarray(starts[r].values.to_numpy()), np.asarray(ends[r].values.to_numpy()))
                if whole_characters:
                    body = np.append(own, 0)
                    while (inside := (body[s] & 0xC0) == 0x80).any():
                        s = s + inside
                    while (inside := (body[e] & 0xC0) == 0x80).any():
                        e = e - inside
                    s, e = s[s < e], e[s < e]
                edges = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(own)]])
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out_s.append(s.tolist())
                out_e.append(e.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), pa.array(out_s, pa.list_(pa.int64())), pa.array(out_e, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["rest", "k", "n_bytes", "s", "e", "kept"])

    out = rows.select("rest", "k", "t", "s", "e").mapInArrow(trimmed(run), with_rest(rows, k=rows.schema["k"].dataType.simpleString(), n_bytes="bigint", s="array<bigint>", e="array<bigint>", kept="binary"))
    return out.select(F.col("k").alias(key), "n_bytes", F.arrays_zip(F.col("s").alias("start"), F.col("e").alias("end")).alias("spans"), "kept", *[F.col(f"rest.`{c}`").alias(c) for c in keep])
