"""Byte-level BPE: vectorised pre-tokens, a minimal perfect hash for those in
the vocabulary, and a heap over linked bytes for the others.
"""

from __future__ import annotations

import base64
import heapq
import json
import re

import numpy as np

from searchloom.llm.textcore import U64, mix, powers, ranges, worker_cache

#: Code points of Unicode's White_Space, as the pattern's \s has them.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Entries kept of pre-tokens met before; beyond that the cache starts again.
CACHE_ENTRIES = 250_000


def class_table():
    """SPACE, LETTER, NUMBER or OTHER for each code point."""

    def make():
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, text):
                table[ord(text[m.start()]) : ord(text[m.end() - 1]) + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[SPACES] = SPACE
        return table

    return worker_cache("class_table", make)


def symbol_values():
    return worker_cache("symbol_values", lambda: np.random.default_rng(7).integers(1, 1 << 63, 0x110000, dtype=U64) * U64(2) + U64(1))


def pre_token_starts(cp, doc_starts):
    """Mask of the code points at which a match of the pattern starts.

    cp: code points of texts laid end to end; doc_starts: where each non-empty
    text starts. A run of white space leaves its last character to what follows
    when that is a space, and otherwise as a token of its own.
    """
    n = len(cp)
    cls = class_table()[cp]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    st = first.copy()
    st[1:] |= cls[1:] != cls[:-1]
    i = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~first[1:]) + 1
    st[i[cp[i - 1] == 32]] = False
    st[i - 1] = True
    a = np.flatnonzero((cp == 39) & st)
    if len(a):
        at = lambda k: np.where((a + k < n), cp[np.minimum(a + k, n - 1)], 0)
        new = lambda k: np.where((a + k < n), first[np.minimum(a + k, n - 1)], True)
        c1, c2 = at(1), at(2)
        one = ~new(1) & np.isin(c1, [ord(x) for x in "stmd"])
        pair = np.zeros(len(a), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (c1 == ord(x)) & (c2 == ord(y))
        pair &= ~new(1) & ~new(2)
        for hit, k in ((one, 2), (pair, 3)):
            b = a[hit]
            st[b + 1] = False
            if k == 3:
                st[b + 2] = False
            nxt = b + k
            st[nxt[nxt < n]] = True
    return st


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: hash and displace.

    Buckets of several keys get a seed that sends all their keys to free slots;
    buckets of one key name their slot. lookup() compares the bytes, so strings
    outside the set are told apart exactly.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        import xxhash

        n = len(keys)
        self.n, self.m = n, max(1, n // 4)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), U64, n)
        bucket = (h % U64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.m + 1))
        sizes = np.diff(bounds)
        self.seed = np.zeros(self.m, np.int64)
        self.slot_key: list[bytes] = [b""] * n
        self.slot_value = np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size < 2:
                break
            own = order[bounds[b] : bounds[b + 1]]
            done, step = 0, 16
            while True:
                tries = np.arange(done + 1, done + step + 1, dtype=U64)
                slots = (mix(h[own][None, :] ^ mix(tries[:, None])) % U64(n)).astype(np.int64)
                ok = ~taken[slots].any(1)
                s = np.sort(slots, 1)
                ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    k = int(ok.argmax())
                    self.seed[b] = int(tries[k])
                    taken[slots[k]] = True
                    for i, x in zip(own, slots[k], strict=True):
                        self.slot_key[x], self.slot_value[x] = keys[i], values[i]
                    break
                done, step = done + step, min(4096, step * 4)
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            i, x = order[bounds[b]], int(next(free))
            self.seed[b] = -1 - x
            self.slot_key[x], self.slot_value[x] = keys[i], values[i]

    def slots(self, h):
        """The one slot at which a key of each hash can be."""
        seed = self.seed[(h % U64(self.m)).astype(np.int64)]
        away = (mix(h ^ mix(np.maximum(seed, 0).astype(U64))) % U64(self.n)).astype(np.int64)
        return np.where(seed < 0, -1 - seed, away)

    def lookup(self, tokens: list[bytes]):
        """Values of the tokens, -1 for those that aren't keys."""
        import xxhash

        h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), U64, len(tokens))
        slot = self.slots(h)
        key = self.slot_key
        same = np.fromiter((key[s] == t for s, t in zip(slot.tolist(), tokens, strict=True)), bool, len(tokens))
        return np.where(same, self.slot_value[slot], -1)


def merge_with_heap(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: the pair of least rank, the leftmost first, merges
    until no pair has a rank. Parts are a linked list over the bytes; the heap
    holds rank, start and end of each pair, packed into one integer."""
    n = len(token)
    rank = ranks.get
    bits = n.bit_length()
    two, low = 2 * bits, (1 << bits) - 1
    end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r << two) | (i << bits) | (i + 2) for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i, stop = (x >> bits) & low, x & low
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has merged since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            k = end[stop]
            if (r := rank(token[i:k])) is not None:
                push(heap, (r << two) | (i << bits) | k)
        p = before[i]
        if p >= 0 and (r := rank(token[p:stop])) is not None:
            push(heap, (r << two) | (p << bits) | stop)
    out, i = [], 0
    while i < n:
        k = end[i]
        out.append(ranks[token[i:k]])
        i = k
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TwoTier:
    """Ids of pre-tokens by a rank file: perfect hash first, then the heap."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for k, v in ranks.items():
            parts[v] = k
        self.lens = np.fromiter(map(len, parts), np.int64, size)
        self.starts = np.cumsum(self.lens) - self.lens
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, tokens: list[bytes]) -> list[list[int]]:
        found = self.whole.lookup(tokens).tolist()
        return [[i] if i >= 0 else merge_with_heap(t, self.ranks) for i, t in zip(found, tokens, strict=True)]

    def decode(self, ids):
        """(bytes of all ids, where each id's bytes end)."""
        lens = self.lens[ids]
        return self.blob[ranges(self.starts[ids], lens)], np.cumsum(lens)


def added_tokens(path: str) -> dict[bytes, int]:
    """The tokens that a tokenizers file matches as whole strings, before any
    pre-token, and their ids. Only plain ones are known here."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("added tokens that take white space, single words or normalised text aren't supported")
    return {t["content"].encode(): t["id"] for t in found}


def special_places(data, offsets, special: dict[bytes, int]):
    """(start, end, id) of the special strings in texts laid end to end, leftmost
    first, the longest of those that start at one place."""
    raw = data.tobytes()
    if not any(x in raw for x in special):
        return []
    pattern = re.compile(b"|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)))
    out = []
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out += [(m.start(), m.end(), special[m[0]]) for m in pattern.finditer(raw, i, j)]
    return out


class Encoder:
    """Whole texts to ids. Pre-tokens are hashed together and each distinct one
    is encoded once; what a hash finds is compared character by character, and
    what differs is encoded by itself. encode is a function of a list of byte
    strings; strings in special have the ids given there."""

    def __init__(self, encode, special: dict[bytes, int] | None = None):
        self.encode, self.special = encode, special or {}
        self.reset()

    def reset(self):
        self.slot: dict[int, int] = {}
        self.known = 0
        self.off, self.len, self.char_off, self.char_len = (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0
        self.chars, self.char_used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, tokens: list[str]) -> range:
        """The entries made for tokens, one each."""
        first = self.known
        for token, ids in zip(tokens, self.encode([t.encode("utf-8", "surrogatepass") for t in tokens]), strict=True):
            k, n = self.known, len(token)
            if k >= len(self.off):
                self.off, self.len, self.char_off, self.char_len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len, self.char_off, self.char_len))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.char_used + n > len(self.chars):
                self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
            self.off[k], self.len[k], self.char_off[k], self.char_len[k] = self.used, len(ids), self.char_used, n
            self.pool[self.used : self.used + len(ids)] = ids
            self.chars[self.char_used : self.char_used + n] = np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.used += len(ids)
            self.char_used += n
            self.known += 1
        return range(first, self.known)

    def __call__(self, data, offsets):
        """(ids as uint32, n + 1 offsets into them) of texts given as flat UTF-8."""
        places = special_places(data, offsets, self.special) if self.special else []
        if not places:
            return self._plain(data, offsets)
        start, end, special = (np.array(x, np.int64) for x in zip(*places, strict=True))
        cuts = np.sort(np.concatenate([offsets, start, end]))
        ids, upto = self._plain(data, cuts)
        lens = np.diff(upto)
        at = np.searchsorted(cuts, start, side="right") - 1  # the pieces that are special strings
        plain = np.ones(len(lens), bool)
        plain[at] = False
        sizes = np.where(plain, lens, 1)
        begin = np.append(0, np.cumsum(sizes))
        out = np.empty(begin[-1], np.uint32)
        out[ranges(begin[:-1][plain], lens[plain])] = ids[ranges(upto[:-1][plain], lens[plain])]
        out[begin[at]] = special
        return out, begin[np.searchsorted(cuts, offsets)]

    def _plain(self, data, offsets):
        n_docs = len(offsets) - 1
        text = data.tobytes().decode("utf-8", "surrogatepass")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        if n == len(data):
            starts = offsets
        else:
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            starts = chars[offsets]
        st = pre_token_starts(cp, starts[:-1][starts[1:] > starts[:-1]])
        begin = np.flatnonzero(st)
        end = np.append(begin[1:], n)
        up, down = powers(n)
        c = np.zeros(n + 1, U64)
        np.cumsum(symbol_values()[cp] * up[:n], out=c[1:])
        h = mix((c[end] - c[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))
        order = np.argsort(h)
        hs = h[order]
        new = np.append(True, hs[1:] != hs[:-1])
        distinct, example = hs[new].tolist(), order[new]
        if self.known + len(distinct) > CACHE_ENTRIES and self.known:
            self.reset()
        get = self.slot.get
        slots = [get(x, -1) for x in distinct]
        missing = [i for i, s in enumerate(slots) if s < 0]
        if missing:
            tokens = [text[a:b] for a, b in zip(begin[example[missing]].tolist(), end[example[missing]].tolist(), strict=True)]
            for i, k in zip(missing, self._learn(tokens), strict=True):
                self.slot[distinct[i]] = slots[i] = k
        which = np.empty(len(h), np.int64)
        which[order] = np.asarray(slots, np.int64)[np.cumsum(new) - 1]
        size = end - begin
        wrong = self.char_len[which] != size
        if not wrong.any():  # the pre-tokens are the text, one after the other
            off = self.chars[ranges(self.char_off[which], size)] != cp
            if off.any():
                wrong = np.logical_or.reduceat(off, begin)
        else:
            wrong = np.fromiter((w or not np.array_equal(self.chars[s : s + m], cp[b : b + m]) for w, s, b, m in zip(wrong, self.char_off[which].tolist(), begin.tolist(), size.tolist(), strict=True)), bool, len(which))
        if wrong.any():
            k = np.flatnonzero(wrong)
            which[k] = self._learn([text[a:b] for a, b in zip(begin[k].tolist(), end[k].tolist(), strict=True)])
        lens = self.len[which]
        ids = self.pool[ranges(self.off[which], lens)]
        upto = np.append(0, np.cumsum(lens))
        return ids, upto[np.searchsorted(begin, starts)]
