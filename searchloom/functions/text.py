"""Text expressions: trimming, newlines, hashes, tokens and folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_EDGE = r"[^\p{L}\p{N}\p{Co}]+"


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped, with null for what is then empty."""
    return F.nullif(strip(c), F.lit(""))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def legacy_hash(c: Column) -> Column:
    """MD5 of the text with line feeds as its only line ends."""
    return F.md5(newlines(c).cast("binary"))


def decode_strict(content: Column) -> Column:
    """UTF-8 text of the bytes, null if they aren't valid."""
    return F.try_validate_utf8(content.cast("string"))


def _accents() -> tuple[str, str]:
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a.isalpha() and a == a.lower() and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case, without diacritics; ligatures and eszett stay. ASCII has none to
    look for."""
    accented, plain = _accents()
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.regexp_replace(F.translate(F.lower(c), accented, plain), r"\p{Mn}", ""))


def index_tokens(c: Column) -> Column:
    """The folded tokens of a text, in order, with repeats."""
    return F.filter(F.split(fold(c), TOKEN_EDGE), lambda x: x != "")


def query_tokens(c: Column) -> Column:
    """The word tokens of a query, as written."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))


def title_case(c: Column) -> Column:
    """Upper case after any non-letter, lower case after a letter."""
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")
