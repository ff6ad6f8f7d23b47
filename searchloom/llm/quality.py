"""Operator 3: quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words, the last one shorter. A passage is
encoded from its shares of character kinds, its word statistics and hashed
words; gated attention weighs the passages, and the weighted sum is classified.
Encoder, attention and classifier are learned together from document labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.jaccard import BLANKS
from searchloom.llm.labelled import sample
from searchloom.llm.tables import with_rest
from searchloom.llm.textcore import SEGMENT, U64, byte_values, flat_bytes, prefix_hash, segments, span_hash, trimmed, worker_cache

PASSAGE, HASHED, HIDDEN, GATES = 64, 48, 24, 12
KINDS, STATS = 16, 9


def byte_kinds():
    def make():
        t = np.full(256, 15, np.int64)  # other symbols
        t[list(BLANKS)] = 0
        t[10] = 1
        t[97:123] = 2
        t[65:91] = 3
        t[48:58] = 4
        t[128:] = 5
        for k, chars in enumerate((".", ",;:", "!?", "|", "*#", "$%&", "<>/\\", "\"'`", "()[]{}"), 6):
            t[[ord(c) for c in chars]] = k
        return t

    return worker_cache("byte_kinds", make)


def passages(data, off):
    """(features, bounds): a row for each passage of texts laid end to end, and
    where each text's rows start. Every text has a row, of zeros if it has no word."""
    n, n_texts = len(data), len(off) - 1
    kind = byte_kinds()[data]
    solid = kind > 1
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end[:-1] &= ~solid[1:] | first[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    at = np.searchsorted(a, off)
    n_words = np.diff(at)
    n_rows = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.append(0, np.cumsum(n_rows))
    x = np.zeros((int(bounds[-1]), KINDS + STATS + HASHED), np.float32)
    if not len(a):
        return x, bounds
    text = np.repeat(np.arange(n_texts), n_words)
    row = bounds[text] + (np.arange(len(a)) - at[text]) // PASSAGE
    # a byte belongs to the passage of the word before it
    fresh = np.append(True, row[1:] != row[:-1])
    edges = np.append(a[fresh], n)
    held = row[fresh]
    of_byte = np.repeat(held, np.diff(edges))
    sizes = np.zeros(len(x))
    counts = np.bincount(of_byte * KINDS + kind[edges[0] :], minlength=len(x) * KINDS).reshape(len(x), KINDS)
    sizes = np.maximum(counts.sum(1, keepdims=True), 1)
    x[:, :KINDS] = np.sqrt(counts / sizes)
    words = np.bincount(row, minlength=len(x)).astype(np.float64)
    per = lambda v: np.bincount(row, weights=v, minlength=len(x)) / np.maximum(words, 1)
    h = span_hash(prefix_hash(byte_values()[data]), a, b)
    lens = (b - a).astype(np.float64)
    top, tail = kind[a], kind[b - 1]
    same = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    order = np.lexsort((h, row))
    again = np.zeros(len(a))
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    far = np.zeros(len(a))  # a word of the same text from an earlier passage, in a run of such
    if len(a) > 8:
        pair = np.append(h[:-1] * U64(3) + h[1:], U64(0))
        o = np.lexsort((np.arange(len(a)), pair, text))
        far[o[1:]] = (pair[o][1:] == pair[o][:-1]) & (text[o][1:] == text[o][:-1])
    upper = np.append(0, np.cumsum(kind == 3))
    x[:, KINDS : KINDS + STATS] = np.column_stack([
        np.log1p(words) / 5, per(np.minimum(lens, 40)) / 10, per(lens <= 3), per(top == 3), per((upper[b] - upper[a]) >= np.maximum(lens - 2, 2)),
        per(same), per(again), per((tail >= 8) & (tail <= 11)), per(far),
    ])
    slot = (h % U64(HASHED)).astype(np.int64)
    x[:, KINDS + STATS :] = np.sqrt(np.bincount(row * HASHED + slot, minlength=len(x) * HASHED).reshape(len(x), HASHED) / np.maximum(words, 1)[:, None])
    return x, bounds


class Attention:
    """h = tanh(We x), a = softmax of wg (tanh(V h) * sigmoid(U h)) over a bag,
    and a logistic classifier on the sum of a h."""

    NAMES = ("mean", "scale", "we", "be", "v", "u", "wg", "wc", "bc")

    def __init__(self, dims: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(dims), np.ones(dims)
        self.we, self.be = r.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN)
        self.v, self.u = (r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)) for _ in range(2))
        self.wg = r.normal(0, GATES**-0.5, GATES)
        self.wc, self.bc = r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)

    def forward(self, x, bounds):
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ self.we + self.be)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        s = (t * g) @ self.wg
        starts, sizes = bounds[:-1], np.diff(bounds)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(bag @ self.wc + self.bc, -30, 30)))
        return p, (z, h, t, g, a, bag)

    def gradients(self, x, bounds, y, load):
        p, (z, h, t, g, a, bag) = self.forward(x, bounds)
        sizes = np.diff(bounds)
        d = load * (p - y) / len(y)
        d_bag = np.repeat(d[:, None] * self.wc, sizes, axis=0)
        d_a = (d_bag * h).sum(1)
        d_s = a * (d_a - np.repeat(np.add.reduceat(a * d_a, bounds[:-1]), sizes))
        d_tg = d_s[:, None] * self.wg
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h = a[:, None] * d_bag + d_t @ self.v.T + d_g @ self.u.T
        d_z = d_h * (1 - h * h)
        return {"we": z.T @ d_z, "be": d_z.sum(0), "v": h.T @ d_t, "u": h.T @ d_g, "wg": (t * g).T @ d_s, "wc": bag.T @ d, "bc": d.sum(keepdims=True)}


def fit(texts: list[str], ys: list[int], prior: float | None = None, epochs: int = 30, batch: int = 64) -> Attention | None:
    """The model for labelled texts, for a share prior of label 1 (default: as in
    ys); None if a class is missing. Adam, with weight decay."""
    y = np.asarray(ys, np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(t) for t in raw]))
    data = np.frombuffer(b"".join(raw), np.uint8)
    xs, counts = [], []
    for i, j in segments(off, SEGMENT):
        x, b = passages(data[off[i] : off[j]], off[i : j + 1] - off[i])
        xs.append(x)
        counts.append(np.diff(b))
    x, bounds = np.concatenate(xs).astype(np.float64), np.append(0, np.cumsum(np.concatenate(counts)))
    model = Attention(x.shape[1])
    model.mean, model.scale = x.mean(0), x.std(0) + 0.02
    prior = prior or float(y.mean())
    load = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    names = Attention.NAMES[2:]
    m1, m2 = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    rng, step = np.random.default_rng(2), 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            own = np.sort(order[i : i + batch])
            rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in own])
            b = np.append(0, np.cumsum(bounds[own + 1] - bounds[own]))
            step += 1
            for k, grad in model.gradients(x[rows], b, y[own], load[own]).items():
                value = getattr(model, k)
                grad = grad + 1e-4 * value
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.99 * m2[k] + 0.01 * grad * grad
                setattr(model, k, value - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8))
    return model


def score(df: DataFrame, model: Attention | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep and score, the probability that the whole text
    has quality label 1. Null, empty and wordless texts are a bag of one blank
    passage; without a model, as when a class has no document, all score 1, so that
    a filter keeps them. Rows are independent, so rows that repeat score alike and
    ties don't arise; an empty table gives no rows. Texts of any length are scored
    whole. keep may name columns of any names but `score`."""
    keep = keep or ["doc_id"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            for i, j in segments(off, SEGMENT):
                if own is None:
                    s = np.ones(j - i)
                else:
                    x, bounds = passages(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    s = own.forward(x, bounds)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s)], names=["rest", "score"])

    source = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"), F.col(text).cast("string").alias("t"))
    out = source.mapInArrow(trimmed(run), with_rest(source, score="double"))
    return out.select("rest.*", "score")


def train(docs: DataFrame, labels: DataFrame, condition, text: str = "text", key: str = "doc_id", label: str = "quality") -> Attention | None:
    """The model fitted on the labelled documents for which condition holds."""
    return fit(*sample(docs, labels, label, condition, text, key))
