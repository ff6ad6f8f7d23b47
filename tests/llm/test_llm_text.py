"""Byte-level BPE, packing, suffix sorting, repeats, Jaccard joins."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from searchloom.llm import bpe, byte_bpe, jaccard, packing, repeats
from searchloom.llm.components import components
from searchloom.llm.suffixes import padded, sort_suffixes

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, "  ", "it's 'sample ''s don't I'll  we've'  \n\n 'x \n's 123abc'd x  ", "\t\tx  \n y's", "日本語 テキスト 😀 ½́", "a\r\n\r\n  b", "x" * 5000, "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>é  ", "<|endof", "text|>", "it's"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c", "d", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "c", "d", 1), (None, "null key", "c", "d", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, t string, doc int")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys, list(range(3000)))
    assert h.lookup(keys).tolist() == list(range(3000))
    assert set(h.lookup([b"x", b"", b"3000"]).tolist()) == {-1}
    assert sorted(h.slot_value.tolist()) == list(range(3000))


def test_bpe_like_tiktoken(docs, small):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for df in (docs, small):
        texts = df.select("doc_id", "text").collect()
        out = byte_bpe.encode(df, RANKS, decode=True).collect()
        assert len(out) == len(texts)
        want = {(r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in texts}
        assert {(r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist()), bytes(r.decoded)) for r in out} == want
        assert all(r.n_tokens * 4 == len(r.token_ids) for r in out)
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


def test_ids_of_words_with_one_hash():
    """The 1024 letters of this word and of its mirror have one polynomial hash."""
    a = "ab"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    encoder = bpe.Encoder(bpe.TwoTier(bpe.read_ranks(RANKS)))
    for n in (512, 1024, 2048):
        x = a[:n]
        y = x.translate(str.maketrans("ab", "ba"))
        for texts in ([x, "hi " + y, y + " " + x], [y], [x + " so"]):
            raw = [t.encode() for t in texts]
            ids, upto = encoder(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            assert [ids[i:j].tolist() for i, j in zip(upto[:-1], upto[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab'strev ldm1\n\t é😀-", max_size=60), min_size=1, max_size=8))
def test_pre_tokens_like_the_pattern(texts):
    import regex

    for t in texts:
        if t:
            cp = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            at = np.flatnonzero(bpe.pre_token_starts(cp, np.array([0])))
            assert at.tolist() == [m.start() for m in regex.finditer(P.PATTERN, t)]


def _check_packing(rows, want):
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    for key, ids in want:
        found = {(r.start, r.length, r.ids_crc32) for r in pieces[(key, len(ids))]}
        at = 0
        while at < len(ids):
            n = next(n for s, n, c in found if s == at and c == zlib.crc32(ids[at : at + n].tobytes()))
            at += n


def test_packing(docs, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (docs, small.repartition(3)):
        want = [(r.doc_id, np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], np.uint32)) for r in df.select("doc_id", "text").collect()]
        rows = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), special=bpe.added_tokens(P.path("byte_bpe_50k.json"))).collect()
        _check_packing(rows, want)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_packer_keeps_its_bound():
    rng = np.random.default_rng(1)
    p, n = packing.Packer(64, 4), 0
    out = []
    for k in range(500):
        size = int(rng.integers(1, 150))
        n += size
        p.add(k, np.arange(size, dtype=np.uint32))
        assert len(p.open) <= 4
        out += p.emitted()
    assert all(sum(len(x[1]) for x in s) == 64 for s in out)
    out += p.finish()
    assert sum(len(x[1]) for s in out for x in s) == n


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_suffix_order(data):
    text = data.draw(st.binary(min_size=1, max_size=12)) * data.draw(st.integers(1, 20))
    buf = np.frombuffer(text, np.uint8)
    starts = np.array(data.draw(st.lists(st.integers(0, len(text) - 1), min_size=1, max_size=60)))
    limits = np.minimum(len(text) - starts, data.draw(st.integers(1, 120)))
    order, same = sort_suffixes(padded(buf), starts, limits)
    strings = [text[a : a + n] for a, n in zip(starts, limits, strict=True)]
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    assert same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]


def brute_repeats(rows, length):
    seen, out = {}, {}
    for key, text in sorted(rows):
        b = text.encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                mark[i : i + length] = b"\1" * length
            else:
                seen[b[i : i + length]] = 1
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[key] = (len(b), sum(mark), spans, bytes(x for x, y in zip(b, mark, strict=True) if not y))
    return out


def test_repeats_like_brute_force(spark, small):
    rng = np.random.default_rng(4)
    pieces = ["".join(rng.choice(list("abcé d"), 60)) for _ in range(6)]
    rows = [(i, "".join(pieces[j] for j in rng.integers(0, 6, rng.integers(0, 9)))) for i in range(60)] + [(100, "ab" * 300), (101, "a" * 99), (102, "a" * 400), (103, "")]
    cases = [(rows, 100), (rows, 40), ([(r.doc_id, r.text) for r in small.collect()], 100)]
    for given_rows, length in cases:
        df = spark.createDataFrame(given_rows, "doc_id long, text string").withColumn("th", F.lit(1)).withColumn("lo", F.lit("x")).repartition(3)
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df, length=length).collect()}
        assert got == brute_repeats(given_rows, length)


@pytest.mark.parametrize("dealt", [{}, {"crowd": 8}, {"crowd": 2, "common": 3}, {"crowd": 300, "common": 6}])
@pytest.mark.parametrize("size", [50, 80, 150])
def test_repeats_crowded_gram(spark, dealt, size):
    """A passage in many documents, whose gram's contexts go on with longer grams,
    in some tasks by themselves."""
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh "), size))
    tails = ["".join(rng.choice(list("uvw "), 60)) for _ in range(7)]
    rows = [(i, "".join(rng.choice(list("xyz "), 80)) + passage + (tails[i % 7] if i % 3 else "".join(rng.choice(list("uvw "), 80)))) for i in range(80)]
    df = spark.createDataFrame([(k, t, 3 * (k < 50) + k % 3 * (k >= 50)) for k, t in rows], "doc_id long, text string, p int").repartition(4, "p")
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df, **dealt).collect()}
    assert got == brute_repeats(rows, 100)


def test_repeats_rows_in_proportion(spark, monkeypatch):
    """A passage that all documents share costs rows in proportion to them."""
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh "), 130))
    made = []
    kept = repeats.written
    monkeypatch.setattr(repeats, "written", lambda d, name: (out := kept(d, name), made.append(out.count()))[0])
    for n in (300, 600):
        rows = [(i, "".join(rng.choice(list("xyz "), 120)) + passage + "".join(rng.choice(list("uvw "), 120))) for i in range(n)]
        repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).count()
        assert max(made) < 24 * n
        made.clear()


def test_repeats_in_pieces():
    """Windows of a text over one segment are judged in pieces."""
    rng = np.random.default_rng(7)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    rows = [(1, text + text[500:900]), (2, text[100:1500])]
    import pyarrow as pa

    keep = repeats.SEGMENT
    repeats.SEGMENT = 700
    try:
        found = []
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([0, 0]), pa.array([0, 0]), pa.array([t for _, t in rows])], names=["doc", "th", "lo", "t"])
        for out in repeats._contexts(100, [64, 33, 9, 1], 0, 1000, False)(iter([batch])):
            found += [r for r in out.to_pylist()]
    finally:
        repeats.SEGMENT = keep
    starts = {k: sorted(x for r in found if r["doc"] == k for x in range(r["lo"], r["hi"] + 1)) for k, _ in rows}
    assert all(starts[k] == list(range(len(t) - 99)) for k, t in rows)


def test_repeats_odd_rows(spark):
    t = "".join(np.random.default_rng(9).choice(list("abcdefghij"), 150))
    rows = [(1, t), (1, t), (2, t), (None, t), (3, None), (2, "short"), (4, "é" * 120 + t)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id is not None, r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in repeats.remove_repeats(df).collect()), key=str)
    assert [x for x in out if x[1] is None] == [(False, None, 150, 0)]
    assert [x[3] for x in out if x[1] == 1] == [150, 150]
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    whole = repeats.remove_repeats(spark.createDataFrame([(1, "é" * 130), (2, "aé" + "é" * 130)], "doc_id long, text string"), whole_characters=True)
    assert all(bytes(r.kept).decode() is not None for r in whole.collect())


def brute_classes(rows, words, num):
    tab = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for k, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(tab))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80), (1, 50)])
def test_classes_like_brute_force(spark, small, words, num):
    rng = np.random.default_rng(num)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(12):
        base = rng.choice(vocab, rng.integers(1, 60)).tolist()
        for _ in range(5):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(t).upper() if g % 2 else "\n".join(t)))
    rows += [(200, ""), (201, None), (202, " \t "), (203, "one"), (204, "ONE")]
    for given_rows in (rows, [(r.doc_id, r.text) for r in small.collect()] if num != 50 else rows):
        df = spark.createDataFrame(given_rows, "doc_id long, text string").withColumn("doc", F.lit("x")).repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, words=words, num=num).collect()}
        assert got == brute_classes(given_rows, words, num)


@pytest.mark.parametrize("edits", [8, 14])
def test_classes_of_a_large_group(spark, edits, monkeypatch):
    """One large group of near copies, of which many don't link with its first."""
    rng = np.random.default_rng(edits)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(400):
        t = list(base)
        for at in rng.choice(150, rng.integers(0, edits), replace=False):
            t[at] = f"x{k}-{at}"
        rows.append((k if k else 1000, " ".join(t)))
    rows += [(2000 + k, " ".join([*base[:75], *(f"y{k}-{i}" for i in range(75))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = []
    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda d, name: (out := kept(d, name), sizes.append((name, out.count())))[0])
    want = brute_classes(rows, 5, 80)
    for dealt in ({}, {"common": 4, "block": 16, "named": 1}):
        sizes.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, words=5, num=80, **dealt).collect()}
        assert got == want
        if not dealt:
            assert all(n <= 8 * len(rows) for name, n in sizes if name in ("named", "pairs", "stars", "copies", "links", "late"))


def test_near_sets_are_not_named_in_each_part_they_share(spark, monkeypatch):
    """What tasks name, before repeats are dropped, when parts lie in many tasks."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        t = [f"w{i}" for i in range(150)]
        for at in rng.choice(150, rng.integers(0, 14), replace=False):
            t[at] = f"x{k}-{at}"
        rows.append((k, " ".join(t)))
    named, naming = spark.sparkContext.accumulator(0), jaccard._name_nearest

    def counted(*given):
        run = naming(*given)

        def each(batches):
            for batch in run(batches):
                named.add(batch.num_rows)
                yield batch

        return each

    monkeypatch.setattr(jaccard, "_name_nearest", counted)
    many = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=80).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_classes(rows, 5, 80)
    assert named.value <= len(rows)  # by all their parts at once: 697


def test_classes_of_rows_with_one_key(spark):
    """Rows (2, t1), (9, t1), (9, t3), (5, t2): t2 and t3 link, so all three keys do."""
    t1, t2 = " ".join(f"a{i}" for i in range(200)), [f"b{i}" for i in range(200)]
    rows = [(2, t1), (9, t1), (9, " ".join([*t2[:-1], "z"])), (5, " ".join(t2)), *[(9, t1)] * 40]
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90).collect()}
    assert got == {2: 2, 9: 2, 5: 2}


def test_long_regular_words_differ(spark):
    word = "ab"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word)]
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_classes_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (7, "x")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (None, None), (2, 2), (7, 7)], key=str)
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_bound_every_link():
    b = jaccard.Bands(80, 100)
    for n in (1, 2, 5, 17, 100, 999):
        i = b.of(n)
        assert b.edge[i] <= n < b.edge[i + 1] and b.of(-(-n * 100 // 80)) <= i + 1
        for m in range(n, n * 100 // 80 + 1):
            most = (n + m) * 20 // 180
            assert most <= b.differ[i] < b.parts[i]


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_query_digests(spark):
    from searchloom.llm.registry import QUERIES

    rows = QUERIES["op4_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
