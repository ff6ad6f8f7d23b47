"""Cutting of one text: front matter, headings, sections and spans, by character."""

from __future__ import annotations

import re

#: The characters of Unicode's White_Space.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
HEADING = re.compile(r"^(#{1,3} .+)$", re.MULTILINE)


def late_break(text: str, lo: int, hi: int) -> int:
    """Behind the last line feed in text[lo:hi], else behind the stop of its last
    stop and space, else hi."""
    for mark in ("\n", ". "):
        i = text.rfind(mark, lo, hi)
        if i >= 0:
            return i + 1
    return hi


def spans(text: str, size: int, overlap: int, tail: int = 0) -> list[tuple[int, int]]:
    """Windows of size with late breaks, overlapping, covering all; a last one
    below tail is balanced with the one before it."""
    n, start, out = len(text), 0, []
    advance = max(1, size - 2 * overlap)
    while start < n:
        end = n if start + size >= n else late_break(text, start + size - overlap, start + size)
        out.append((start, end))
        start = n if end >= n else max(end - overlap, start + advance)
    if len(out) > 1 and out[-1][1] - out[-1][0] < tail:
        first = out[-2][0]
        middle = first + (n - first + overlap + 1) // 2
        middle = late_break(text, middle - overlap, middle)
        out[-2:] = [(first, middle), (middle - overlap, n)]
    return out


def pieces(text: str, size: int, overlap: int, tail: int = 0) -> list[str]:
    """The stripped texts of the spans, without blank ones."""
    cut = (text[a:b].strip(BLANKS) for a, b in spans(text, size, overlap, tail))
    return [x for x in cut if x]


def without_front_matter(text: str) -> str:
    """The text behind a block between lines of three dashes at its start."""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    return text[end + 4 :].lstrip("\n") if end >= 0 else text


def sections(text: str, least: int) -> list[tuple[str, str]]:
    """(header, span) at headings of level 1 to 3, adjacent ones joined until each
    has `least` characters; what is left over joins the last. The header is that
    of the group's distinct headings."""
    starts = [m.start() for m in HEADING.finditer(text)]
    edges = [0, *(s for s in starts if s), len(text)]
    groups: list[list[str]] = []
    whole = True
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        span = text[a:b]
        if whole or not groups:
            groups.append([])
        groups[-1].append(span)
        whole = sum(map(len, groups[-1])) >= least
    if not whole and len(groups) > 1:
        rest = groups.pop()
        groups[-1] += rest
    heads = lambda g: dict.fromkeys(m[1].strip(BLANKS) for m in map(HEADING.match, g) if m)
    return [(" | ".join(heads(g))[:300], "".join(g)) for g in groups]


def file_chunks(text: str, size: int, overlap: int, least: int, empty: int) -> list[tuple[str, int, str]]:
    """(header, section number, chunk) of a Markdown file, in order; none if its
    body has fewer than `empty` characters."""
    body = without_front_matter(text)
    if len(body.strip(BLANKS)) < empty:
        return []
    return [(header, i, x) for i, (header, span) in enumerate(sections(body, least)) for x in pieces(span, size, overlap, least)]
