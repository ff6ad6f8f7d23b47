"""Operator 8: toxicity by a subsequence string kernel, Nyström landmarks and a
support vector machine.

The kernel counts common subsequences of three letters, gaps included, each
weighted by DECAY to the lengths they span in both strings, and is normalised.
Characters between the letters of a word lengthen the spans on both sides of the
normalisation, so an insult written with gaps or inserted characters stays
close to itself. Words are mapped by their kernel with landmark words (Nyström)
and a linear machine with squared hinge loss is trained on labelled sentences:
all words of clean ones against each toxic one's witness, its highest word.

A sentence scores as its highest word and a text as its highest sentence. As the
machine is linear in the landmarks' subsequences, they fold into one table of
weights, and a word costs a sum over its own subsequences.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.bpe import LETTER, NUMBER, SPACE, class_table
from searchloom.llm.labelled import fitted, without_copies
from searchloom.llm.tables import with_rest
from searchloom.llm.textcore import SEGMENT, U64, flat_bytes, mix, powers, segments, trimmed, worker_cache, worker_slot

DECAY, LANDMARKS, LONGEST = 0.65, 256, 24
CODES = 64
#: Characters between the letters of a spelled-out word, and letters of words that may be pieces, at most.
APART, PIECE = 6, 3
#: Codes of a word's start and end, which are part of its subsequences.
START, END = 62, 63
#: Characters read as the letters they stand for inside a word.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def letter_codes():
    """1 to 59 for each letter, whatever its case, 0 for what isn't one. Latin
    letters up to U+00FF have codes of their own; those of other scripts take the
    same codes in turn, so that neighbours in an alphabet have different ones."""

    def make():
        t = np.zeros(0x110000, np.uint8)
        cls = class_table()
        letters = np.flatnonzero((cls == LETTER) | (cls == NUMBER))
        t[letters] = [1 + ord(chr(c).lower()[0]) % 57 for c in letters.tolist()]
        own = {chr(c): c - 96 for c in range(97, 123)} | {chr(c): 27 + c - 0xDF for c in range(0xDF, 0x100) if c != 0xF7 and c != 0xDF}
        own["ß"] = 27
        for ch, code in own.items():
            t[ord(ch)] = min(code, 59)
            up = ch.upper()
            if len(up) == 1 and ord(up) < 0x250:
                t[ord(up)] = min(code, 59)
        for ch, as_letter in LOOKS.items():
            t[ord(ch)] = own[as_letter]
        return t

    return worker_cache("letter_codes", make)


def words_of(cp, starts):
    """(a, b, n): where the words of texts laid end to end start and end, and of
    how many they are made. Words are runs without white space, trimmed to letters
    and digits; a run of one-letter words, each at most APART characters behind
    the one before, is one word, with gaps."""
    n = len(cp)
    cls = class_table()[cp]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    solid = cls != SPACE
    inner = (cls == LETTER) | (cls == NUMBER)
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end[:-1] &= ~solid[1:] | first[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    place = np.flatnonzero(inner)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    x, y = np.searchsorted(place, a), np.searchsorted(place, b)
    has = y > x
    a, b = place[x[has]], place[y[has] - 1] + 1
    one = (b - a) == 1
    near = np.zeros(len(a), bool)  # a one-letter word right after another one
    near[1:] = one[1:] & one[:-1] & (a[1:] - b[:-1] <= APART) & (np.searchsorted(starts, a[1:], side="right") == np.searchsorted(starts, a[:-1], side="right"))
    head = np.flatnonzero(~near)
    after = np.append(head[1:], len(a))
    return a[head], b[after - 1], after - head


def instances(cp, starts):
    """(codes, a, b, text): the letter codes of texts laid end to end, where in them
    the strings that are scored start and end, and their texts. These are the
    words; the letters of a spelled-out word with wider gaps, set at one gap each
    (behind the texts' own codes); and short words next to each other as one, with
    their gap, as they may be pieces of a word."""
    codes = letter_codes()[cp]
    a, b, n = words_of(cp, starts)
    text = np.searchsorted(starts, a, side="right") - 1
    if not len(a):
        return codes, a, b, text
    size = b - a
    wide = np.flatnonzero((n > 1) & (size > 2 * n - 1))
    if len(wide):
        cls = class_table()
        drawn, extra = [], []
        for i in wide.tolist():
            own = cp[a[i] : b[i]]
            own = codes[a[i] : b[i]][(cls[own] == LETTER) | (cls[own] == NUMBER)]
            spaced = np.zeros(2 * len(own) - 1, codes.dtype)
            spaced[::2] = own
            drawn.append(spaced)
            extra.append(len(spaced))
        end = len(codes) + np.cumsum(extra)
        codes = np.concatenate([codes, *drawn])
        a[wide], b[wide] = end - extra, end
    two = np.flatnonzero((size[:-1] <= PIECE) & (size[1:] <= PIECE) & (size[:-1] + size[1:] > PIECE) & (n[:-1] == 1) & (n[1:] == 1) & (a[1:] - b[:-1] <= 2) & (text[1:] == text[:-1]))
    return codes, np.concatenate([a, a[two]]), np.concatenate([b, b[two + 1]]), np.concatenate([text, text[two]])


def triples(length: int):
    """Index triples i < j < k below length, and DECAY to their spans."""

    def make():
        t = np.array(list(itertools.combinations(range(length), 3)), np.int64).reshape(-1, 3)
        return t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)

    return worker_cache(("triples", length, DECAY), make)


def features(codes):
    """(subsequence, weight) arrays of words of one length: rows of letter codes.
    Subsequences that pass a gap character weigh 0."""
    t, w = triples(codes.shape[1])
    c = codes.astype(np.int32)
    x, y, z = c[:, t[:, 0]], c[:, t[:, 1]], c[:, t[:, 2]]
    return (x * CODES + y) * CODES + z, w * ((x > 0) & (y > 0) & (z > 0))


def norms(sub, weight):
    """Square root of each word's kernel with itself."""
    order = np.argsort(sub, axis=1)
    s, w = np.take_along_axis(sub, order, 1), np.take_along_axis(weight, order, 1).astype(np.float64)
    total = np.cumsum(w, axis=1)
    last = np.ones(s.shape, bool)
    last[:, :-1] = s[:, 1:] != s[:, :-1]
    out = np.zeros(len(s))
    rows, cols = np.nonzero(last)
    upto = total[rows, cols]
    new = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
    each = upto - np.where(new, 0, np.append(0, upto[:-1]))
    np.add.at(out, rows, each * each)
    return np.sqrt(out)


def by_length(codes_flat, a, b, most: int = 50_000):
    """Groups (rows, codes matrix, with START and END) of words with one length
    from 3 to LONGEST."""
    lens = b - a
    for length in np.unique(lens):
        if 3 <= length <= LONGEST:
            rows = np.flatnonzero(lens == length)
            step = max(1, most * 10 // len(triples(int(length) + 2)[0]))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                out = np.empty((len(own), length + 2), np.uint8)
                out[:, 0], out[:, -1] = START, END
                out[:, 1:-1] = codes_flat[a[own][:, None] + np.arange(length)]
                yield own, out


class Machine:
    """The trained machine, folded: a word's margin is its subsequences' weights
    summed over its norm, plus bias; slope and shift turn a margin into a
    probability."""

    def __init__(self, table, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift
        self.marks, self.beta = [], np.zeros(0)  # landmarks and their weights, which table folds

    def margins(self, codes_flat, a, b):
        out = np.full(len(a), -np.inf)
        for rows, codes in by_length(codes_flat, a, b):
            sub, w = features(codes)
            norm = norms(sub, w)
            with np.errstate(divide="ignore", invalid="ignore"):
                m = (self.table[sub] * w).sum(1) / norm
            out[rows] = np.where(norm > 0, m, 0) + self.bias
        return out

    def scores(self, cp, starts):
        """Score of each of the texts laid end to end in cp, empty ones too."""
        n = len(starts) - 1
        best = np.full(n, -np.inf)
        codes, a, b, text = instances(cp, starts)
        if len(a):
            # a longer word counts as its overlapping stretches
            long = b - a > LONGEST
            la, lb = a[long], b[long]
            k = -(-(lb - la - LONGEST) // (LONGEST // 2)) + 1
            nth = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            sa = np.minimum(np.repeat(la, k) + nth * (LONGEST // 2), np.repeat(lb, k) - LONGEST)
            text = np.concatenate([text[~long], np.repeat(text[long], k)])
            a, b = np.concatenate([a[~long], sa]), np.concatenate([b[~long], sa + LONGEST])
            _, example, which = np.unique(_word_hash(codes, a, b), return_index=True, return_inverse=True)
            m = self.margins(codes, a[example], b[example])[which]
            np.maximum.at(best, text, m)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(best, -4) + self.shift, -30, 30)))


def _flat(texts):
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def _kernel(words, marks):
    """Normalised kernels of words (bytes of letter codes) with landmarks."""
    out = np.zeros((len(words), len(marks)), np.float32)
    flat = lambda ws: (np.frombuffer(b"".join(ws), np.uint8), np.cumsum([0, *map(len, ws)])[:-1], np.cumsum([0, *map(len, ws)])[1:])
    row = np.full(CODES**3, -1, np.int32)
    cells = []
    for own, codes in by_length(*flat(marks)):
        sub, w = features(codes)
        for i, s, x, norm in zip(own, sub, w, norms(sub, w), strict=True):
            if norm:
                cells.append((i, s, x / norm))
    used = np.unique(np.concatenate([s for _, s, _ in cells]))
    row[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(marks)), np.float32)
    for i, s, x in cells:
        np.add.at(table[:, i], row[s], x)
    for own, codes in by_length(*flat(words), most=1_000):
        sub, w = features(codes)
        norm = norms(sub, w)
        out[own] = np.einsum("nt,ntm->nm", w, table[row[sub]]) / np.maximum(norm, 1e-9)[:, None]
    return out, table, used


def _hinge(x, y, weight, ridge):
    """Linear machine with squared hinge loss, by Newton steps; the last column
    of x is 1 and not regularised."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        xs = x[on] * weight[on, None]
        new = np.linalg.solve(xs.T @ x[on] + np.diag(reg), xs.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new
    return w


def _vocabulary(texts: list[str]):
    """(words, as bytes of letter codes; distinct (text, word) rows), taking some
    texts at a time."""
    ids: dict[bytes, int] = {}
    rows = []
    size = np.append(0, np.cumsum([len(t) for t in texts]))
    for i, j in segments(size, 1 << 17):
        cp, starts = _flat(texts[i:j])
        codes, a, b, text = instances(cp, starts)
        doc = text + i
        keep = (b - a >= 3) & (b - a <= LONGEST)
        a, b, doc = a[keep], b[keep], doc[keep]
        h = _word_hash(codes, a, b)
        _, example, which = np.unique(h, return_index=True, return_inverse=True)
        raw = codes.tobytes()
        own = np.fromiter((ids.setdefault(raw[x:y], len(ids)) for x, y in zip(a[example].tolist(), b[example].tolist(), strict=True)), np.int64, len(example))
        rows.append(np.unique(doc << 32 | own[which]))
    cells = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return list(ids), np.column_stack([cells >> 32, cells & 0xFFFFFFFF])


def _word_hash(codes, a, b):
    up, down = powers(len(codes))
    c = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * up[: len(codes)], out=c[1:])
    return mix((c[b] - c[a]) * down[a] + (b - a).astype(U64))


def fit(texts: list[str], ys: list[int], prior: float | None = None, landmarks: int = LANDMARKS) -> Machine | None:
    """The machine for labelled texts, with probabilities for a share prior of
    toxic ones (default: as in ys); None if a class is missing."""
    prior = prior or float(np.mean(ys or [0]))
    texts, ys = without_copies(texts, ys)
    y = np.asarray(ys)
    if not (y == 1).any() or not (y == 0).any():
        return None
    names, pairs = _vocabulary(texts)
    if not names:
        return None
    toxic = y[pairs[:, 0]] == 1
    pos = np.bincount(pairs[toxic, 1], minlength=len(names)).astype(float)
    neg = np.bincount(pairs[~toxic, 1], minlength=len(names)).astype(float)
    n_pos, n_neg = (y == 1).sum(), (y == 0).sum()
    odds = np.log((pos + 0.05) / (n_pos + 1)) - np.log((neg + 0.05) / (n_neg + 1))
    # how far the split of a word's texts is from that of all (log-likelihood ratio)
    share = n_pos / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(pos > 0, pos * np.log(pos / ((pos + neg) * share)), 0) + np.where(neg > 0, neg * np.log(neg / ((pos + neg) * (1 - share))), 0))
    likely = (odds > 1.5) & (g2 > 20)
    if not likely.any():
        likely[np.argmax(odds)] = True
    lead = np.flatnonzero(likely)
    lead = lead[np.argsort(-g2[lead], kind="stable")][: landmarks * 3 // 4]
    clean = np.flatnonzero((neg >= 1) & (odds <= 1) & ~likely)
    flat = lambda rows: (np.frombuffer(b"".join(names[i] for i in rows), np.uint8), *(np.cumsum([0, *(len(names[i]) for i in rows)])[k] for k in (slice(None, -1), slice(1, None))))
    mean = np.zeros(CODES**3, np.float32)
    for _, c in by_length(*flat(lead)):
        sub, w = features(c)
        np.add.at(mean, sub, w / np.maximum(norms(sub, w), 1e-9)[:, None].astype(np.float32))
    mean[0] = 0
    close = Machine(mean, 0.0, 1.0, 0.0).margins(*flat(clean)) if len(clean) else np.zeros(0)
    order = np.argsort(-close * np.sqrt(neg[clean]), kind="stable")
    rng = np.random.default_rng(3)
    pool = np.unique(np.concatenate([clean[order[:5000]], clean[rng.permutation(len(clean))[:5000]]]))
    hard = clean[order[: landmarks // 4]]
    marks = [names[i] for i in [*lead, *hard]]
    k_mm, _, _ = _kernel(marks, marks)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # instances: likely insults and every pooled clean word, then the words that the machine itself picks
    inst = np.unique(np.concatenate([np.flatnonzero(likely | ((odds > 3) & (pos >= 2))), pool, lead, hard]))
    k, table, used = _kernel([names[i] for i in inst], marks)
    x = np.column_stack([k @ root, np.ones(len(inst))])
    at = np.full(len(names), -1)
    at[inst] = np.arange(len(inst))
    own = pairs[(at[pairs[:, 1]] >= 0)]
    d, i = own[:, 0], at[own[:, 1]]
    witness = odds[inst].copy()
    for _ in range(4):
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, d, witness[i])
        seen = np.zeros(len(inst))
        hit = (y[d] == 1) & (witness[i] >= best[d])
        np.add.at(seen, i[hit], 1)
        yes = np.flatnonzero(likely[inst] | ((seen > 0) & (odds[inst] > 1.5) & (witness > -0.5)))
        no = np.flatnonzero((neg[inst] > 0) & (odds[inst] <= 1) & ~likely[inst])
        rows = np.concatenate([yes, no])
        target = np.concatenate([np.ones(len(yes)), -np.ones(len(no))])
        load = np.concatenate([np.sqrt(np.maximum(seen[yes], pos[inst[yes]])) * 2, np.minimum(neg[inst[no]], 50)])
        w = _hinge(x[rows], target, load, 0.1)
        witness = x @ w
    beta = root @ w[:-1]
    fold = np.zeros(CODES**3, np.float32)
    fold[used] = table[:-1] @ beta
    machine = Machine(fold, float(w[-1]), 1.0, 0.0)
    machine.marks, machine.beta = marks, beta
    # margins of whole training texts to probabilities
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, pairs[:, 0], machine.margins(*flat(range(len(names))))[pairs[:, 1]])
    m = np.maximum(best, -4)
    p = np.array([1.0, 0.0])
    load = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p[0] * m + p[1], -30, 30)))
        off = load * (q - y)
        g = np.array([(off * m).sum(), off.sum()]) + 1e-2 * np.array([p[0] - 1, 0])
        s = load * q * (1 - q)
        hess = np.array([[(s * m * m).sum(), (s * m).sum()], [(s * m).sum(), s.sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, g)
        p -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    machine.slope, machine.shift = float(max(p[0], 0.1)), float(p[1])
    return machine


def score(df: DataFrame, machine: Machine | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep and score, the probability that the whole text
    is toxic. Null and empty texts, and texts without a word of three letters,
    score as the least toxic do; without a machine all score 0. Rows are
    independent, so rows that repeat score alike and ties don't arise; an empty
    table gives no rows. Texts are scored whole, in about 60 bytes a character of
    the longest. keep may name columns of any names but `score`."""
    keep = keep or ["doc_id"]
    shared = df.sparkSession.sparkContext.broadcast(machine)  # a table of fixed size

    def run(batches):
        import pyarrow as pa

        own = worker_slot(("toxicity", id(shared)), lambda: shared.value)
        for batch in batches:
            data, off = flat_bytes(batch.column(0).field(place) if batch.num_columns == 1 else batch.column(1))
            for i, j in segments(off, SEGMENT):
                part = data[off[i] : off[j]]
                cp = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                starts = np.append(0, np.cumsum((part & 0xC0) != 0x80))[off[i : j + 1] - off[i]]
                s = own.scores(cp, starts) if own is not None else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s)], names=["rest", "score"])

    place = keep.index(text) if text in keep and df.schema[text].dataType.simpleString() == "string" else None
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"), *([] if place is not None else [F.col(text).cast("string").alias("t")]))
    out = source.mapInArrow(trimmed(run), with_rest(source, score="double"))
    return out.select("rest.*", "score")


def train(docs: DataFrame, labels: DataFrame, condition, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Machine | None:
    """The machine fitted on the labelled documents for which condition holds."""
    made = fitted(lambda *given: (m := fit(*given)) and vars(m), docs, labels, label, condition, text, key)
    if made is None:
        return None
    machine = Machine(None, 0.0, 1.0, 0.0)
    vars(machine).update(made)
    return machine
