"""Operator 9: joins of documents by the Jaccard similarity of word shingles.

Parity-sketch join. Sizes fall into bands; a pair's smaller set gives its band,
and with it the largest symmetric difference D that a link allows. The shingles
of a set are dealt by hash into more than D parts, and each part's parity sketch
is the exclusive or of its hashes: two linked sets differ in at most D parts, so
they agree in one (pigeonhole). Sets that agree in a part are compared by bit
sketches, whose Hamming distance is at most the symmetric difference, and what
remains is verified on whole sets.

Links only matter for who is connected, so pairs inside what is connected
already aren't compared. First each set is verified against the one earlier set
with which it shares most parts. Then, in the groups of a part that still hold
several components, sets outside the group's largest component ask: each names
the nearest few sets of other components that its bit sketch allows, these are
verified and connected, and sets that may have more to name ask again, for eight
times as many, from where they stopped. Before that, each asks once in the largest
of its groups alone: near sets share most parts, and would be named in each of
them. So what is named stays in proportion to the sets, as long as near sets link,
and still every possible link is verified or lies inside a component.

A row is told apart by its key and a hash of its text. A part that many sets of
one task share is dealt out by the least of them, which alone meets the sets of
other tasks, so that no task gets a common part's sets in whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.llm.components import components
from searchloom.llm.tables import released, written
from searchloom.llm.textcore import SEGMENT, U64, byte_values, flat_bytes, mix, prefix_hash, ranges, segments, span_hash, trimmed, worker_cache

#: Rows of a group that ask in one task, and that are asked there.
BLOCK = 2048
#: Sets of a segment from which on a part they share is dealt out.
COMMON = 32
#: Sets that each asking one names in the first round; eight times more in each later one.
NAMED = 4
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (32, 9, 10, 11, 12, 13)


def _bytes_table():
    def make():
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        blank = np.zeros(256, bool)
        blank[list(BLANKS)] = True
        return lower, blank

    return worker_cache("jaccard_bytes", make)


def shingle_sets(data, off, words: int):
    """For texts laid end to end, each text's distinct shingle hashes, sorted."""
    import xxhash

    lower, blank = _bytes_table()
    n_texts = len(off) - 1
    n = len(data)
    none = np.zeros(0, U64)
    if not n:
        return [none] * n_texts
    inside = ~blank[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    h = span_hash(prefix_hash(byte_values()[lower[data]]), a, b)
    for k in np.flatnonzero(b - a >= LONG_WORD):  # regular words of that length can share a polynomial hash
        h[k] = xxhash.xxh3_64_intdigest(lower[data[a[k] : b[k]]].tobytes())
    bounds = np.searchsorted(a, off)
    odd = [U64(x) for x in worker_cache(("odd", words), lambda: (np.random.default_rng(5).integers(1, 1 << 62, words + 1, dtype=U64) * U64(2) + U64(1)).tolist())]
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, U64)
        for k in range(words):
            s += h[k : k + len(s)] * odd[k]
        s = mix(s)
    else:
        s = none
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= words:
            out.append(np.unique(s[i : j - words + 1]))
        elif j > i:
            total = odd[words] * U64(j - i)
            with np.errstate(over="ignore"):
                for k in range(i, j):
                    total = total + h[k] * odd[k - i]
            out.append(mix(np.array([total], U64)))
        else:
            out.append(none)
    return out


class Bands:
    """Size bands for links of |A & B| * den >= |A | B| * num.

    Band i holds sizes from edge[i] up to edge[i + 1]; no link joins sets more
    than one band apart. In configuration i, for pairs whose smaller set is in
    band i: differ[i] is the largest symmetric difference of a link, parts[i]
    the number of parts and bits[i] that of a bit sketch.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edge, self.differ, self.parts, self.bits = [1], [], [], []

    def _grow(self):
        e = self.edge[-1]
        nxt = max(e + 1, -(-e * self.den // self.num))
        self.edge.append(nxt)
        d = (nxt - 1) * (self.den - self.num) // self.num
        m = d + 1
        if d:  # more parts than differ + 1, as some are empty in both and tell nothing
            m += 1 + math.ceil(2 * m * math.exp(-e / m))
        self.differ.append(d)
        self.parts.append(m)
        self.bits.append(max(64, 1 << (16 * d).bit_length()))

    def of(self, n: int) -> int:
        while self.edge[-1] <= n:
            self._grow()
        return int(np.searchsorted(self.edge, n, side="right")) - 1

    def configurations(self, n: int):
        """Those in which a set of n takes part, as the smaller set and as the larger."""
        i = self.of(n)
        return [i, i - 1] if i else [i]


def part_keys(s, i: int, bands: Bands):
    """Keys of the parts of a set in configuration i. Empty parts have none,
    unless so many are empty that two such sets could agree in empty ones only."""
    m = bands.parts[i]
    if m == 1:
        return mix(np.array([np.bitwise_xor.reduce(s) + U64(i)], U64))
    part = (mix(s ^ U64(0x5851F42D4C957F2D)) % U64(m)).astype(np.int64)
    order = np.argsort(part)
    p = part[order]
    at = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    parity = np.bitwise_xor.reduceat(s[order], at)
    p = p[at]
    if len(p) <= bands.differ[i]:
        full = np.zeros(m, U64)
        full[p] = parity
        parity, p = full, np.arange(m)
    return mix(mix(parity) + (p.astype(U64) << U64(20)) + U64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def bit_sketch(s, bits: int) -> bytes:
    """A bit for each hash value modulo bits: the parity of the shingles there."""
    at = (mix(s + U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _batches(batches, words):
    """(docs, text hashes, sets) by segments of Arrow batches (doc, th, text)."""
    for batch in batches:
        data, off = flat_bytes(batch.column(2))
        for i, j in segments(off, SEGMENT):
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)


def _set_hashes(s):
    """Two hashes of a whole set."""
    return (int(mix(s).sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(s).view(np.int64))) if len(s) else (0, 0)


def _describe(words: int):
    """(doc, th, n, h1, h2) of each text."""

    def run(batches):
        import pyarrow as pa

        for docs, th, sets in _batches(batches, words):
            h = [_set_hashes(s) for s in sets]
            yield pa.RecordBatch.from_arrays([docs, th, pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in h], pa.int64()), pa.array([x for _, x in h], pa.int64())], names=["doc", "th", "n", "h1", "h2"])

    return run


def _sketches(words: int, num: int, den: int):
    """(doc, th, n, own, low): the bit sketches of both configurations."""

    def run(batches):
        import pyarrow as pa

        bands = worker_cache(("bands", num, den), lambda: Bands(num, den))
        for docs, th, sets in _batches(batches, words):
            sk = [[bit_sketch(s, bands.bits[i]) for i in bands.configurations(len(s))] if len(s) else [b""] for s in sets]
            yield pa.RecordBatch.from_arrays([docs, th, pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in sk], pa.binary()), pa.array([x[-1] for x in sk], pa.binary())], names=["doc", "th", "n", "own", "low"])

    return run


def _keys(words: int, num: int, den: int, many: int):
    """(key, spot, doc, th): the part keys of each text, once for equal sets of a
    task's segment, by the least of their rows. spot is 0, but for keys that
    `many` sets of the segment share, where it names the least of these; that
    one has a row at 0 too."""

    def run(batches):
        import pyarrow as pa

        bands = worker_cache(("bands", num, den), lambda: Bands(num, den))
        for docs, th, sets in _batches(batches, words):
            ids, ths = docs.to_numpy(), th.to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ths, ids))] = np.arange(len(ids))
            first: dict = {}
            for k, s in enumerate(sets):
                if len(s):
                    name = (len(s), s.tobytes() if len(s) < 64 else (*_set_hashes(s), int(s[0]), int(s[-1])))
                    if name not in first or rank[k] < rank[first[name]]:
                        first[name] = k
            keys = [(k, np.concatenate([part_keys(sets[k], i, bands) for i in bands.configurations(len(sets[k]))])) for k in first.values()]
            if not keys:
                continue
            key, own = np.concatenate([x for _, x in keys]), np.repeat([k for k, _ in keys], [len(x) for _, x in keys])
            order = np.lexsort((rank[own], key))
            key, own = key[order], own[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(head, len(key)))
            least = own[head]
            common = np.flatnonzero(size >= many)
            spot = np.zeros(len(key), U64)
            if len(common):
                at = ranges(head[common], size[common])
                who = np.repeat(least[common], size[common])
                spot[at] = mix(mix(ids[who].view(U64)) ^ ths[who].view(U64)) | U64(1)
                key, spot, own = np.concatenate([key, key[head[common]]]), np.append(spot, np.zeros(len(common), U64)), np.concatenate([own, least[common]])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(spot.view(np.int64)), pa.array(ids[own]), pa.array(ths[own])], names=["key", "spot", "doc", "th"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): the keys of the rows pairs (a, ath, b, bth) whose sets link, by whole sets."""
    of = lambda c: texts.select(F.col("doc").alias(c), F.col("th").alias(f"{c}th"), F.col("t").alias(f"t{c}"))
    both = pairs.join(of("b"), ["b", "bth"]).join(of("a"), ["a", "ath"]).select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = flat_bytes(batch.column(3))
            da, oa = flat_bytes(batch.column(2))
            ids = batch.column(0).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            last, mine = None, None
            for i, j in segments(off, SEGMENT):
                for k, s in enumerate(shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words), i):
                    own = da[oa[k] : oa[k + 1]]
                    if last is None or last[0] != ids[k] or len(last[1]) != len(own) or not np.array_equal(last[1], own):
                        last, mine = (ids[k], own), shingle_sets(own, np.array([0, len(own)]), words)[0]
                    same = len(np.intersect1d(mine, s, assume_unique=True))
                    keep[k] = same * den >= (len(mine) + len(s) - same) * num and same > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(trimmed(run), "a long, b long").where("a <> b")


def _name_nearest(num: int, den: int, most: int):
    """(doc, th, far, pd, pt): for the asking rows of groups (key, p, q), the
    `most` nearest rows (pd, pt) of other components that may link and come
    after the place (far, pd, pt) where the row stopped. Rows are (key, p, q,
    role, doc, th, n, comp, far, pd, pt, own, low), sorted by group, many groups
    at once; role 0 is asked, 1 asks, 2 does both."""
    names = ["key", "p", "q", "role", "doc", "th", "n", "comp", "far", "pd", "pt"]

    def asked_of(c):
        """(asking, asked) rows of one group, by index."""
        new = np.append(True, (c["key"][1:] != c["key"][:-1]) | (c["p"][1:] != c["p"][:-1]) | (c["q"][1:] != c["q"][:-1]))
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        asks = np.flatnonzero(c["role"] > 0)
        for i, j in segments(np.append(0, np.cumsum(size[group[asks]])), 1 << 19):
            own = asks[i:j]
            left = np.repeat(own, size[group[own]])
            right = ranges(first[group[own]], size[group[own]])
            small, large = np.minimum(c["n"][left], c["n"][right]), np.maximum(c["n"][left], c["n"][right])
            ok = (c["role"][right] != 1) & (c["comp"][left] != c["comp"][right]) & (small * den >= large * num)
            yield left[ok], right[ok]

    def nearest(c, left, right, far):
        """The first `most` of each asking row's places."""
        x = [c["doc"][left], c["th"][left], far, c["doc"][right], c["th"][right]]
        o = np.lexsort(x[::-1])
        x = [v[o] for v in x]
        again = np.zeros(len(o), bool)
        again[1:] = np.all([v[1:] == v[:-1] for v in x], axis=0)
        x = [v[~again] for v in x]
        new = np.append(True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]))[: len(x[0])]
        at = np.flatnonzero(new)
        nth = np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new))))
        return [v[nth < most] for v in x]

    def flush(c):
        bands = worker_cache(("bands", num, den), lambda: Bands(num, den))
        sizes, which = np.unique(c["n"], return_inverse=True)
        band = np.array([bands.of(int(n)) for n in sizes])[which]
        found = []
        for left, right in asked_of(c):
            swap = c["n"][left] > c["n"][right]
            a, b = np.where(swap, right, left), np.where(swap, left, right)  # the smaller set, the larger
            far = np.full(len(a), -1)
            for i in np.unique(band[a]):
                own = np.flatnonzero(band[a] == i)
                step = max(1, (1 << 22) // (bands.bits[i] // 8))
                for at in range(0, len(own), step):
                    k = own[at : at + step]
                    p, q = a[k], b[k]
                    # own of the smaller and, a band above, low of the larger are of configuration i
                    other = np.where(band[q] == i, c["own"][q], c["low"][q])
                    bits = lambda v: np.frombuffer(b"".join(v.tolist()), np.uint64).reshape(len(v), -1)
                    far[k] = np.bitwise_count(bits(c["own"][p]) ^ bits(other)).sum(1)
            hit = far <= (c["n"][a] + c["n"][b]) * (den - num) // (den + num)
            x, y = (c["far"][left], c["pd"][left], c["pt"][left]), (far, c["doc"][right], c["th"][right])
            hit &= (y[0] > x[0]) | ((y[0] == x[0]) & ((y[1] > x[1]) | ((y[1] == x[1]) & (y[2] > x[2]))))
            found.append(nearest(c, left[hit], right[hit], far[hit]))
        doc, th, far, pd, pt = (np.concatenate(v) if found else np.zeros(0, np.int64) for v in (zip(*found, strict=True) if found else [[]] * 5))
        at = {"doc": np.append(doc, pd), "th": np.append(th, pt)}  # the lists of all chunks, cut once more
        return nearest(at, np.arange(len(doc)), np.arange(len(doc)) + len(doc), far)

    def run(batches):
        import pyarrow as pa

        held = None

        def arrow(found):
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["doc", "th", "far", "pd", "pt"])

        for batch in batches:
            c = {k: batch.column(i).to_numpy() for i, k in enumerate(names)}
            for i, k in ((11, "own"), (12, "low")):
                c[k] = np.array(batch.column(i).to_pylist() + [None], object)[:-1]
            held = c if held is None else {k: np.concatenate([held[k], c[k]]) for k in c}
            if len(held["key"]) < 20_000:
                continue
            other = np.flatnonzero((held["key"] != held["key"][-1]) | (held["p"] != held["p"][-1]) | (held["q"] != held["q"][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if cut:
                yield arrow(flush({k: v[:cut] for k, v in held.items()}))
                held = {k: v[cut:] for k, v in held.items()}
        if held is not None and len(held["key"]):
            yield arrow(flush(held))

    return run


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, size, doc, th, asks): the rows of parts whose sets are of several
    components, one part of those with the same rows; rows outside the part's
    largest component ask. size is the part's number of rows."""
    of = written(_with_component(shared.select("key", "doc", "th").distinct(), labels), "labelled")
    whole = lambda x, y: [F.expr(f"bit_xor({v})").alias(n) for v, n in ((x, "f1"), (y, "f2"))]
    parts = of.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), *whole("xxhash64(doc, th)", "xxhash64(th, doc, 1)"))
    keys = parts.groupBy("key").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("rows", "comp")).alias("big"), *whole("f1", "f2")).where("comps > 1")
    keys = written(keys.groupBy("rows", "f1", "f2").agg(F.min(F.struct("key", "big.comp")).alias("k")).select("k.key", F.col("rows").alias("size"), F.col("k.comp").alias("big")), "mixed")
    out = written(of.join(keys, "key").select("key", "size", "doc", "th", (F.col("comp") != F.col("big")).alias("asks")), "open")
    released(of, keys)
    return out


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("doc"), F.col("component")), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _connected(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the links (a, b) have joined their components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    step = written(components(edges), "steps")
    nodes = labels.unionByName(step.join(labels, "node", "left_anti"))
    return written(nodes.join(step.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")


def _late(open_rows: DataFrame, labels: DataFrame, texts: DataFrame, words: int, num: int, den: int, block: int, named: int) -> DataFrame:
    """labels after all links between components that rows of open_rows still have."""
    sketches = written(texts.join(open_rows.select("doc", "th").distinct(), ["doc", "th"], "left_semi").select("doc", "th", "t").mapInArrow(trimmed(_sketches(words, num, den)), "doc long, th long, n long, own binary, low binary"), "sketches")
    once = written(open_rows.where("asks").groupBy("doc", "th").agg(F.max(F.struct("size", "key")).alias("m")).select("doc", "th", "m.key", F.lit(True).alias("once")), "once")
    stopped, first = None, True
    while True:
        rows = open_rows
        if first:  # each in the largest of its groups
            rows = rows.join(once, ["key", "doc", "th"], "left").withColumn("asks", F.col("once").isNotNull()).drop("once")
        rows = _with_component(rows, labels)
        if stopped is None:
            rows = rows.withColumns({"far": F.lit(-1).cast("long"), "pd": F.lit(0).cast("long"), "pt": F.lit(0).cast("long")})
        else:  # those that named as many as they might ask on
            rows = rows.join(stopped, ["doc", "th"], "left").withColumn("asks", F.col("asks") & F.col("far").isNotNull()).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("far", "pd", "pt")})
        rows = written(rows.select("key", "doc", "th", "asks", "comp", "far", "pd", "pt"), "round")
        groups = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("asks").cast("int")).alias("asking")).where("lo <> hi AND asking > 0")
        groups = written(groups.select("key", F.ceil(F.col("asking") / block).cast("int").alias("ps"), F.ceil(F.col("rows") / block).cast("int").alias("qs")), "groups")
        dealt = rows.join(groups, "key").join(sketches, ["doc", "th"])
        own = lambda n: F.pmod(F.xxhash64("doc", "th"), F.col(n)).cast("int")
        alone = (F.col("ps") == 1) & (F.col("qs") == 1)
        place = lambda p, q, role: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(role).alias("role"))
        at = F.when(alone, F.array(F.when(F.col("asks"), place(F.lit(0), F.lit(0), 2)).otherwise(place(F.lit(0), F.lit(0), 0)))).otherwise(
            F.concat(F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: place(p, own("qs"), 0)), F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: place(own("ps"), q, 1))).otherwise(F.array().cast("array<struct<p:int,q:int,role:int>>")))
        )
        dealt = dealt.withColumn("at", F.explode(at)).select("key", "at.p", "at.q", "at.role", "doc", "th", "n", "comp", "far", "pd", "pt", "own", "low")
        dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        found = dealt.mapInArrow(trimmed(_name_nearest(num, den, named)), "doc long, th long, far long, pd long, pt long").distinct()
        nth = F.row_number().over(W.partitionBy("doc", "th").orderBy("far", "pd", "pt"))
        found = written(found.withColumn("nth", nth).where(F.col("nth") <= named), "named")
        released(rows, groups)
        if not first and found.isEmpty():
            return labels
        least, most = F.least(F.struct(F.col("doc").alias("d"), F.col("th").alias("h")), F.struct(F.col("pd").alias("d"), F.col("pt").alias("h"))), F.greatest(F.struct(F.col("doc").alias("d"), F.col("th").alias("h")), F.struct(F.col("pd").alias("d"), F.col("pt").alias("h")))
        pairs = found.select(least.alias("x"), most.alias("y")).distinct().select(F.col("x.d").alias("a"), F.col("x.h").alias("ath"), F.col("y.d").alias("b"), F.col("y.h").alias("bth"))
        links = written(_verify(written(pairs, "pairs"), texts, words, num, den), "late")
        if not links.isEmpty():
            labels = _connected(labels, links)
        if first:
            first = False
            released(once)
            continue
        stopped = written(found.where(F.col("nth") == named).select("doc", "th", "far", "pd", "pt"), "stopped")
        named *= 8
        if stopped.isEmpty():
            return labels


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, num: int = 80, den: int = 100, common: int = COMMON, block: int = BLOCK, named: int = NAMED) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set of
    distinct shingles of `words` words and the smallest key it is connected to by
    links, itself included. Sets link when |A & B| * den >= |A | B| * num.

    Words are runs of anything but white space (space and the ASCII controls 9
    to 13) of the text with A-Z in lower case; a text of fewer words has the
    whole sequence as its one shingle. A null or wordless text has no shingle
    and links with nothing. Rows with a null key take no part and have a null
    component; rows with one key are one node with the links of all its texts,
    and rows that repeat in whole are one row of it. Ties don't arise. An empty
    table gives no rows; other columns don't matter, whatever their names.
    Shingles are told apart by 64-bit hashes. Texts are taken whole; a worker
    holds about 60 bytes a byte of its longest text. common, block and named say
    how the work is dealt and don't change results.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    all_docs = df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(t).alias("th"), t.alias("t"))
    docs = all_docs.where("doc IS NOT NULL")
    sets = written(all_docs.mapInArrow(trimmed(_describe(words)), "doc long, th long, n long, h1 long, h2 long"), "sets")
    known = sets.where("n > 0 AND doc IS NOT NULL")
    first = written(known.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc", "th")).alias("f"), F.max(F.struct("doc", "th")).alias("l")).where("f <> l").select("n", "h1", "h2", "f"), "firsts")
    copies = written(known.join(first, ["n", "h1", "h2"]).where("doc <> f.doc OR th <> f.th").select(F.col("f.doc").alias("a"), F.col("doc").alias("b"), "th").distinct(), "copies")

    by_key = W.partitionBy("key", "spot").orderBy("doc", "th")
    least, after = F.first(F.struct("doc", "th")).over(by_key), F.lead(F.struct("doc", "th")).over(by_key)
    keys = docs.mapInArrow(trimmed(_keys(words, num, den, common)), "key long, spot long, doc long, th long").repartition("key", "spot")
    keys = keys.withColumn("f", least).withColumn("next", after).withColumn("led", (F.col("doc") != F.col("f.doc")) | (F.col("th") != F.col("f.th"))).where("led OR next <> f")
    raw = written(keys.select("key", "doc", "th", "led", F.col("f.doc").alias("pivot"), F.col("f.th").alias("pth")), "raw")
    shared = written(raw.join(copies.select(F.col("b").alias("doc"), "th").distinct(), ["doc", "th"], "left_anti"), "shared")
    released(raw, first)

    stars = shared.where("led").groupBy("doc", "th", "pivot", "pth").agg(F.count(F.lit(1)).alias("parts"))
    best = stars.groupBy("doc", "th").agg(F.max(F.struct("parts", F.bitwise_not("pivot").alias("p"), F.bitwise_not("pth").alias("h"))).alias("m"))
    best = written(best.select(F.bitwise_not("m.p").alias("a"), F.bitwise_not("m.h").alias("ath"), F.col("doc").alias("b"), F.col("th").alias("bth")), "stars")
    asked = best.select(F.col("a").alias("doc"), F.col("ath").alias("th")).unionByName(shared.select("doc", "th")).distinct()
    texts = written(docs.join(asked, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]), "texts")
    links = written(_verify(best, texts, words, num, den), "links")
    labels = components(copies.select("a", "b").unionByName(links))
    open_rows = _open(shared, labels)
    released(best, shared)
    if not open_rows.isEmpty():
        labels = _late(open_rows, labels, texts, words, num, den, block, named)
    released(texts, links, copies, open_rows)
    out = sets.select("doc", F.col("n").alias("n_shingles")).join(labels.select(F.col("node").alias("doc"), F.col("component")), "doc", "left")
    return out.select(F.col("doc").alias(key), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
