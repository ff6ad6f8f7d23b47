"""Operators 1, 11, 12 and 13 on odd rows, against plain loops and their SQL."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from searchloom.llm import codes, exact, ranked, vectors
from searchloom.llm.registry import ORACLES, QUERIES

TEXTS = [
    "", None, " \t\n", "a b", "ab", "a\x0bb ", "a b", "É a", "é A", "x" * 70 + " tail", "x" * 70 + "tail", "x" * 70 + "liat", "word " * 30_000, "word" * 30_000,
    "alpha beta alpha", "beta", "ALPHA, beta-gamma", "日本 alpha 日本", "alpha beta alpha", "x" * 64 + "aabb", "x" * 64 + "bbaa",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 23, t, "n", 1, True) for i, t in enumerate(TEXTS)] + [(None, "a b", "n", 1, True), (4, "ab", "n", 1, True), (4, "other", "n", 1, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n int, met boolean")


def _same(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    want = sorted(res.fetchall(), key=repr)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(cols).collect()), key=repr) == want
    return want


# exact duplicates
@pytest.mark.parametrize("slots", [exact.SLOTS, 3])
def test_duplicates_like_a_loop(docs, slots):
    out = exact.duplicates(docs, keep=["text", "digest", "n", "met"], slots=slots).collect()
    groups: dict[str, list] = {}
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in docs.collect():
        groups.setdefault(bare(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    got = Counter((bare(r.text), r.doc_id, r.keep_id, r.group_size) for r in out)
    assert got == Counter((t, k, min(g)[2], len(g)) for t, g in groups.items() for _, _, k in g)
    assert Counter(bare(r.text) for r in out if r.kept) == Counter(groups.keys())
    assert all(r.digest is None or r.digest == hashlib.sha256(bare(r.text).encode()).hexdigest() for r in out)
    assert all(r.digest for r in out if r.group_size > 1) and {(r.n, r.met) for r in out} == {(1, True)}


def test_whole_texts_are_read_for_shared_beginnings_alone(docs):
    out = {r.text: r.digest for r in exact.duplicates(docs, keep=["text"]).collect()}
    assert out["beta"] is None and out["other"] is None and out["é A"] is None  # alone with their length, or with their beginning
    assert out["x" * 64 + "aabb"] and out["x" * 64 + "bbaa"]  # equal in length and beginning
    assert exact.duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_query(spark, docs, tmp_path):
    clean = docs.where("NOT (doc_id = 4 AND text = 'ab')")  # two rows alike in all that counts: SQL takes any
    assert len(_same(spark, tmp_path, "op11_exact_dedup", documents=clean)) == clean.count()


def test_exact_dedup_is_native(docs):
    plan = exact.duplicates(docs, digests=True)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)


# ranked search
def _ranked(docs, items, k=10):
    """Each item's best documents by plain loops over all of them."""
    take = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(take(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, text in items:
        found = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(take(text)) & set(b))
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_like_a_loop(spark, docs):
    items = [(1, "Alpha GAMMA"), (2, None), (3, "日本 beta beta"), (4, "nothing here"), (5, "a b word x"), (6, "")]
    q = spark.createDataFrame([(i, t, 0) for i, t in [*items, (None, "alpha")]], "item_id long, text string, rank int")
    want = _ranked([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(map(tuple, ranked.search(ranked.index(docs), q).collect()), key=repr) == want
    assert ranked.search(ranked.index(docs.limit(0)), q).count() == 0
    assert ranked.search(ranked.index(docs), q.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1_000_000, 400])
def test_ranked_search_over_many_blocks(spark, pairs, monkeypatch):
    rng = np.random.default_rng(7)
    vocab = np.array([f"w{i}" for i in range(300)])
    p = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 40), p=p / p.sum())) for _ in range(3000)]
    texts[500:1500] = ["w7 w100 w200"] * 1000  # ties beyond any limit
    rows = list(zip(rng.permutation(3000).tolist(), texts, strict=True))
    items = [(i, " ".join(rng.choice(vocab, 8))) for i in range(60)] + [(99, "w100 w200")]
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 100)
    monkeypatch.setattr(ranked, "PAIRS", pairs)
    blocks = ranked.index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert blocks.count() > 20
    got = ranked.search(blocks, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == _ranked(rows, items)


def test_max_tree_opens_few_ranges():
    rng = np.random.default_rng(3)
    n = 4096
    place = np.sort(rng.choice(n, 3000, replace=False))
    impact = rng.integers(1, 1000, 3000)
    impact[[10, 1500]] = 10**6
    tree = ranked.MaxTree(np.zeros(3000, np.int64), place, impact, n)
    assert tree.tops[-1].tolist() == [10**6]
    best = ranked._Best(2)
    opened = ranked._descend(tree, 10**6, np.zeros(1, np.int64), np.ones(1, np.int64), best, np.zeros(n, bool), np.arange(n))
    assert best.doc.tolist() == place[[10, 1500]].tolist() and opened <= 6


def test_ranked_query(spark, docs, tmp_path):
    q = spark.createDataFrame([(1, "Alpha GAMMA"), (3, "日本 beta beta"), (4, "nothing"), (5, "ab word")], "item_id long, text string")
    assert _same(spark, tmp_path, "op12_ranked_search", documents=docs, benchmark=q)


# vector codes
def _codes(rows, parts=16, entries=64, rounds=2):
    """Codes and errors by Lloyd's rounds over all parts, one by one."""
    kept = [(k, lab, [math.floor(256 * float(np.float64(x))) for x in v]) for k, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = max(len(v) for *_, v in kept)
    w = -(-w // parts)
    cut = [[(v + [0] * (w * parts - len(v)))[p * w : (p + 1) * w] for p in range(parts)] for *_, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), i) for i, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own: dict[int, list] = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for i, xs in own.items():
                books[p][i] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    of: Counter = Counter()
    for (_, lab, _), e in zip(kept, error, strict=True):
        of[lab] += e
    return sorted(((k, "".join(f"{i:02x}" for _, i in f), e, of[lab], sha) for (k, lab, _), f, e in zip(kept, found, error, strict=True)), key=repr)


def _vectors(rng, n, dim):
    rows = [(i, int(rng.integers(0, 4)) if rng.random() < 0.8 else None, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(n)]  # a vector that half of all rows have
    return rows


@pytest.mark.parametrize("dim", [64, 32, 16])
def test_codes_like_a_loop(spark, tmp_path, dim):
    rows = _vectors(np.random.default_rng(dim), 90, dim)
    nan = float("nan")
    df = spark.createDataFrame([*rows, (2000, 1, None), (2001, 1, [nan] * dim), (2002, 2, [None] * dim)], "vec_id long, label int, embedding array<double>")
    assert _same(spark, tmp_path, "op13_vector_codes", embeddings=df) == _codes(rows)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 7 if i else None, None, [float(x) for x in rng.normal(size=int(rng.integers(0, 9)))]) for i in range(30)]
    rows += [(3, 2, [1e9, -1e9, 0.5]), (4, 2, [1e9, -1e9, 0.25]), (5, 2, [3e9])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS row", "2 AS pos", "'x' AS code")
    got = sorted(map(tuple, codes.compress(df, entries=3, parts=3).collect()), key=repr)
    top = (1 << 63) - 1
    assert got == sorted(((k, c, min(e, top), min(s, top), h) for k, c, e, s, h in _codes(rows, 3, 3)), key=repr)
    assert codes.compress(df.limit(0)).count() == 0


# exact top-k
def test_topk_of_large_components(spark):
    rows = [(0, [1e8, 0.0]), (1, [1e8, 1.0]), (2, [-1e8, 3.0]), (3, [9e7, 0.0]), (4, [9e7, 5e7]), (5, [1e30, 0.0]), (6, [])]
    df = vectors.whole_numbers(spark.createDataFrame(rows, "vec_id long, v array<double>"), 256.0)
    ints = {r.vec_id: (list(r.v) + [0, 0])[:2] for r in df.collect()}
    assert ints[5] == [1 << 55, 0] and ints[1] == [25_600_000_000, 256]
    top, low = (1 << 63) - 1, -(1 << 63)
    want = []
    for q, v in ints.items():
        best = sorted((-(v[0] * c[0] + v[1] * c[1]), k) for k, c in ints.items() if k != q)[:4]
        want += [(q, r, k, max(low, min(top, -s))) for r, (s, k) in enumerate(best, 1)]
    got = vectors.exact_topk(df, df, 4, vector="v")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert vectors.exact_topk(df.limit(0), df, 4, vector="v").count() == 0
