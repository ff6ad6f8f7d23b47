"""Operator 11: exact duplicates by progressive refinement, in DataFrame functions.

Rows are told apart by ever dearer facts, and a level reads only what the level
before could not tell apart:

1. by the length of the normalised text,
2. of the lengths that several rows have, by a hash of the text's beginning,
3. of the beginnings that several rows have, by SHA-256 of the whole text.

Levels 1 and 2 group slim rows without text. What they leave goes to the next
level as the slots (a hash modulo SLOTS) of the values that several rows have:
at most SLOTS numbers, whatever the data's size, so they are broadcast, and no
text is shuffled. Two values in one slot cost a hash that wasn't needed and
change no result. Groups are combined in each task before they meet; the join of
rows and groups has written tables on both sides, so that a hot group's part can
be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.llm.tables import released, written

#: The characters that don't count (fixed values of the contract).
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Characters of a text's beginning, and the slots of values that several rows have.
PREFIX, SLOTS = 64, 1 << 20


def normalised(text: Column) -> Column:
    """The text without BLANKS; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _crowded(rows: DataFrame, by: tuple[str, ...], slots: int) -> DataFrame:
    """(slot, met) for each slot of a value of `by` that two rows or more have: at
    most `slots` rows."""
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return written(many.select(_slot(by, slots).alias("slot")).distinct().withColumn("met", F.lit(True)), "crowded")


def _slot(by: tuple[str, ...], slots: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int")


def duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | list[str] = (), digests: bool = False, slots: int = SLOTS) -> DataFrame:
    """One row for each row of df: the columns of keep, key, keep_id, group_size,
    kept, digest.

    Texts are equal when their normalised forms are. Of equal ones that with the
    most characters as given stays, then the one of smallest key; keep_id is its
    key. digest is the lower-case hexadecimal SHA-256 of the normalised text; it is
    null for rows that were told apart by less, unless digests asks for it.

    A null text is an empty one, and empty texts are equal. A null key comes after
    all others; of rows that repeat a key and a length one stays, whichever. Texts
    of any length are read whole. An empty table gives no rows. Columns outside of
    keep don't matter, whatever their names; one of keep that has a result's name
    gives way to it.
    """
    names = ("keep_id", "group_size", "kept", "digest", key)
    rest = F.struct(*[F.col(f"`{c}`") for c in keep if c not in names], F.lit(None).cast("boolean").alias("__none"))
    given = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), rest.alias("rest")).withColumn("bare", normalised(F.col("t")))
    given = given.withColumns({"n": F.octet_length("bare"), "head": F.xxhash64(F.substring("bare", 1, PREFIX))})

    slim = written(given.select("n", "head"), "slim")
    lengths = _crowded(slim, ("n",), slots)
    alike = slim.withColumn("slot", _slot(("n",), slots)).join(F.broadcast(lengths), "slot", "left_semi")  # at most SLOTS rows
    heads = _crowded(alike, ("n", "head"), slots)
    released(slim, lengths)

    rows = given.withColumn("slot", _slot(("n", "head"), slots)).join(F.broadcast(heads), "slot", "left")  # at most SLOTS rows
    rows = rows.withColumn("met", F.coalesce("met", F.lit(False)))
    full = F.sha2(F.col("bare").cast("binary"), 256)
    rows = rows.select("k", "rest", "n", "head", "met", F.length(F.coalesce("t", F.lit(""))).alias("chars"), F.when(F.col("met") | F.lit(digests), full).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "hashed")
    released(heads)

    best = F.min(F.struct(-F.col("chars"), F.col("k").isNull(), F.col("k").alias("k"), F.col("row").alias("row"))).alias("best")
    by = ["n", "head", "digest"]
    groups = written(rows.where("met").groupBy(*by).agg(F.count(F.lit(1)).alias("size"), best), "groups")
    met = rows.where("met").join(groups.select(*by, "size", F.col("best.k").alias("stays"), F.col("best.row").alias("stays_row")), by)
    met = met.select("rest", "k", F.col("stays").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("stays_row")).alias("kept"), "digest")
    lone = rows.where("NOT met").select("rest", "k", F.col("k").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    out = met.unionByName(lone)
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in keep if c not in names], F.col("k").alias(key), "keep_id", "group_size", "kept", "digest")
