"""Fail-closed generations of remote documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.contracts import JOB_BYTES, JOB_PAGES
from searchloom.sources.scratch import written


def step(previous: DataFrame, attempt: DataFrame, enumeration_complete: bool, source_disabled: bool = False, source_kind: str = "wiki") -> DataFrame:
    """(source_uid, kind, status, content_hash, carried) after one attempt.

    previous: source_uid, status, content_hash, kind (document or tombstone).
    attempt: source_uid, outcome (ok, failed or null), seen, content_hash.
    One full outer join by source_uid; rows that vanish are filtered out. A
    disabled source has no documents and one tombstone, of the source itself.
    """
    p = previous.select("source_uid", F.col("status").alias("old_status"), F.col("content_hash").alias("old_hash"), F.col("kind").alias("old_kind"))
    if source_disabled:
        spark = previous.sparkSession
        return spark.createDataFrame([(source_kind, "source_tombstone", None, None, False)], "source_uid string, kind string, status string, content_hash string, carried boolean")
    j = p.join(attempt, "source_uid", "full_outer")
    ok, failed, seen = F.coalesce(F.col("outcome") == "ok", F.lit(False)), F.coalesce(F.col("outcome") == "failed", F.lit(False)), F.coalesce("seen", F.lit(False))
    was = F.coalesce(F.col("old_kind") == "document", F.lit(False))
    buried = F.coalesce(F.col("old_kind") == "tombstone", F.lit(False))
    gone = was & ~ok & F.lit(enumeration_complete) & ~seen
    late = was & ~ok & ~gone
    kind = F.when(ok | late, "document").when(gone | (buried & ~seen), "tombstone")
    status = F.when(ok, "fresh").when(late & (failed | F.lit(not enumeration_complete)), "stale").when(late, F.col("old_status"))
    rows = j.withColumn("k", kind).where("k IS NOT NULL")
    return rows.select("source_uid", F.col("k").alias("kind"), status.alias("status"), F.when(ok, F.col("content_hash")).when(late, F.col("old_hash")).alias("content_hash"), F.coalesce(late & (failed | F.lit(not enumeration_complete) | (F.col("old_status") == "stale")), F.lit(False)).alias("carried"))


def violations(attempt: DataFrame, previous: DataFrame) -> DataFrame:
    """(source_uid, violation) of an attempt that must not be published: repeated,
    both ok and failed, not seen, or seen and new without an outcome."""
    g = attempt.groupBy("source_uid").agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.bool_or(F.col("seen")).alias("seen"))
    known = previous.where("kind = 'document'").select("source_uid", F.lit(True).alias("known"))
    rows = g.join(known, "source_uid", "left")
    what = F.when(F.col("ok") > 1, "duplicate").when((F.col("ok") > 0) & (F.col("failed") > 0), "ok_and_failed").when(((F.col("ok") > 0) | (F.col("failed") > 0)) & ~F.coalesce("seen", F.lit(False)), "not_seen").when(F.coalesce("seen", F.lit(False)) & (F.col("ok") + F.col("failed") == 0) & F.col("known").isNull(), "unhandled_new")
    return rows.select("source_uid", what.alias("violation")).where("violation IS NOT NULL")


def counts(generation: DataFrame, attempt: DataFrame) -> DataFrame:
    """One row: seen, converted, failed, carry_forward, tombstones, status."""
    a = attempt.agg(F.count_if(F.col("seen")).alias("seen"), F.count_if(F.col("outcome") == "ok").alias("converted"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    g = generation.agg(F.count_if(F.col("carried")).alias("carry_forward"), F.count_if(F.col("kind") == "tombstone").alias("tombstones"))
    bad = (F.col("failed") > 0) | (F.col("carry_forward") > 0)
    return a.crossJoin(g).withColumn("status", F.when(bad, "degraded").otherwise("ok"))  # one row each


def path_collisions(documents: DataFrame, owner: str = "source_uid") -> DataFrame:
    return documents.groupBy("path").agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def retention(generations: DataFrame, keep: int, current: str) -> DataFrame:
    """generations (generation_id, mtime) to delete: all but the newest `keep` and
    the current one."""
    newest = generations.orderBy(F.desc("mtime"), F.desc("generation_id")).limit(keep)
    return generations.join(newest.select("generation_id"), "generation_id", "left_anti").where(F.col("generation_id") != current)


def eligibility(pages: DataFrame, spaces: list[str]) -> DataFrame:
    """(page_id, space, state) of remote pages: bad_id, outside the allowlist,
    duplicate, or eligible; one row an id."""
    g = pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("space").alias("space"))
    state = F.when(~F.coalesce(F.col("page_id").rlike("^[0-9]+$"), F.lit(False)), "bad_id").when(~F.coalesce(F.col("space").isin(*spaces), F.lit(False)), "outside").when(F.col("n") > 1, "duplicate").otherwise("eligible")
    return g.select("page_id", "space", state.alias("state"))


def attachment_collisions(attachments: DataFrame) -> DataFrame:
    """(page_id, name) of attachment names that a page has twice, whatever the case."""
    return attachments.groupBy("page_id", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def changed_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages (page_id, revision) whose revision is new or differs from known's."""
    j = pages.join(known.select("page_id", F.col("revision").alias("old")), "page_id", "left")
    return j.where(~F.col("revision").eqNullSafe(F.col("old"))).select("page_id", "revision", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("change"))


def revision_key(updated: Column, created: Column) -> Column:
    return F.concat(F.coalesce(updated, F.lit("null")), F.lit("|"), F.coalesce(created, F.lit("null")))


def failure_threshold(attempt: DataFrame, limit: float) -> DataFrame:
    """One row: total, failed, rate, exceeded (strictly above the limit)."""
    total, failed = F.count("outcome"), F.count_if(F.col("outcome") == "failed")
    rate = F.coalesce(failed / F.nullif(total, F.lit(0)), F.lit(0.0))
    return attempt.agg(total.alias("total"), failed.alias("failed"), F.round(rate, 6).alias("rate"), (rate > limit).alias("exceeded"))


#: Rows of consecutive places that one task sees together, with those that follow them in one batch.
STRETCH = 8192


def placed(pages: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """(g, o, z, r, s): each page's place in its group by order, from 0, and the
    sizes before it, summed. Sorted in ranges over all groups at once; a range's
    totals, a row for each group it meets, are added up to where the next starts."""
    rows = pages.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("z"))
    rows = written(rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o").withColumn("p", F.spark_partition_id()), "ranges")
    total = rows.groupBy("p", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("zs"))
    before = W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range that has the group
    total = total.select("p", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("zs").over(before), F.lit(0)).alias("z0"))
    here = W.partitionBy("p", "g").orderBy("o")  # of one range
    rows = rows.withColumn("r", F.row_number().over(here) - 1).withColumn("s", F.sum("z").over(here.rowsBetween(W.unboundedPreceding, 0)) - F.col("z"))
    total = total.withColumnsRenamed({"p": "tp", "g": "tg"})
    j = rows.join(total, (F.col("p") == F.col("tp")) & F.col("g").eqNullSafe(F.col("tg"))).select("g", "o", "z", (F.col("r") + F.col("n0")).alias("r"), (F.col("s") + F.col("z0")).alias("s"))
    return written(j, "placed")


def _following(r, s, z, max_pages: int, max_bytes: int):
    """For rows of consecutive places: the place at which the batch that starts at
    each one's ends, by search in the sums."""
    import numpy as np

    full = np.searchsorted(s + z, s + max_bytes, side="right")  # the first whose end is over the limit
    return r[0] + np.minimum(np.arange(len(r)) + max_pages, full)


def job_batches(pages: DataFrame, group: str, order: str, size: str, max_pages: int = JOB_PAGES, max_bytes: int = JOB_BYTES, stretch: int = STRETCH) -> DataFrame:
    """(group, order, batch) of pages: stable greedy jobs within each group, each
    of at most max_pages and max_bytes; batch is null for a page over max_bytes.

    Where a batch that starts at a page ends follows from the sums of sizes before
    the pages, and doesn't depend on where other batches start. So stretches of
    consecutive places, each with the max_pages that follow it, find at once where
    they are left from each place at which they may be entered; pointer doubling
    along these finds the one place at which each is entered, in as many rounds as
    the number of stretches has digits in base two; and each stretch then numbers
    its batches, from the number of those before it. No task holds a group.
    """
    import numpy as np

    stretch = max(stretch, max_pages)
    kind = pages.schema[group].dataType.simpleString()
    small = pages.where(F.coalesce(F.col(size), F.lit(0)) <= max_bytes).withColumn(size, F.coalesce(F.col(size), F.lit(0)))
    rows = placed(small, group, order, size)
    own = (F.col("r") / stretch).cast("long")
    late = F.when((F.col("r") % stretch < max_pages) & (F.col("r") >= stretch), F.array(own, own - 1)).otherwise(F.array(own))
    seen = rows.withColumn("b", F.explode(late))

    def leave(table):
        import pyarrow as pa

        t = table.sort_by("r")
        r, s, z = (t.column(c).to_numpy() for c in ("r", "s", "z"))
        b = t.column("b")[0].as_py()
        n = int(np.searchsorted(r, (b + 1) * stretch))  # those of its own
        after = _following(r, s, z, max_pages, max_bytes)[:n] - r[0]
        out, starts = after.copy(), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                out[i], starts[i] = out[after[i]], starts[after[i]] + 1
        entries = np.arange(min(n, max_pages) if b else 1)
        g = pa.array([t.column("g")[0].as_py()] * len(entries), t.schema.field("g").type)
        return pa.table({"g": g, "b": pa.array([b] * len(entries), pa.int64()), "entry": pa.array(r[0] + entries), "leave": pa.array(r[0] + out[entries]), "starts": pa.array(starts[entries])})

    jumps = written(seen.groupBy("g", "b").applyInArrow(leave, f"g {kind}, b long, entry long, leave long, starts long"), "jumps")
    marks, hops = jumps.where("entry = 0").select("g", "entry"), jumps.select("g", "entry", "leave")
    last = jumps.agg(F.max("b")).head()[0] or 0
    for turn in range(int(last).bit_length()):
        to = hops.select(F.col("g").alias("hg"), F.col("entry").alias("he"), F.col("leave").alias("hl"))
        reached = marks.join(to, F.col("g").eqNullSafe(F.col("hg")) & (F.col("entry") == F.col("he"))).select("g", F.col("hl").alias("entry"))
        further = hops.join(to, F.col("g").eqNullSafe(F.col("hg")) & (F.col("leave") == F.col("he")), "left").select("g", "entry", F.coalesce("hl", "leave").alias("leave"))
        marks, hops = written(marks.unionByName(reached).distinct(), f"marks-{turn}"), written(further, f"hops-{turn}")
    to = marks.select(F.col("g").alias("hg"), F.col("entry").alias("he"))
    entered = jumps.join(to, F.col("g").eqNullSafe(F.col("hg")) & (F.col("entry") == F.col("he")), "left_semi")
    # the last stretch of a group may lie within one batch, and is entered nowhere
    entered = entered.unionByName(jumps.select("g", "b").distinct().withColumns({"entry": (F.col("b") + 1) * stretch, "leave": F.lit(0).cast("long"), "starts": F.lit(0).cast("long")}))
    entered = entered.groupBy("g", "b").agg(F.min("entry").alias("entry"), F.max("starts").alias("starts"))
    before = W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # a row for each stretch
    entered = written(entered.select("g", "b", "entry", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("first")), "entered")

    def number(table):
        import pyarrow as pa

        t = table.sort_by("r")
        r, s, z = (t.column(c).to_numpy() for c in ("r", "s", "z"))
        b, entry, first = (t.column(c)[0].as_py() for c in ("b", "entry", "first"))
        n = int(np.searchsorted(r, (b + 1) * stretch))
        after = _following(r, s, z, max_pages, max_bytes) - r[0]
        starts, at = [], entry - r[0]
        while at < n:
            starts.append(at)
            at = int(after[at])
        batch = first - 1 + np.searchsorted(starts, np.arange(n), side="right")
        return pa.table({"g": t.column("g").slice(0, n), "o": t.column("o").slice(0, n), "batch": pa.array(batch, pa.int32())})

    to = entered.select(F.col("g").alias("hg"), F.col("b").alias("hb"), "entry", "first")
    met = seen.join(to, F.col("g").eqNullSafe(F.col("hg")) & (F.col("b") == F.col("hb"))).drop("hg", "hb")
    done = met.groupBy("g", "b").applyInArrow(number, f"g {kind}, o long, batch int")
    over = pages.where(F.col(size) > max_bytes).select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.lit(None).cast("int").alias("batch"))
    return done.unionByName(over).select(F.col("g").alias(group), F.col("o").alias(order), "batch")


def catch_up_due(now: Column, last_success: Column, interval_seconds: Column) -> Column:
    """Whether a source is due; one that never succeeded is."""
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(last_success) >= interval_seconds, F.lit(True))


def backoff(attempt: Column, initial: float, multiplier: float, maximum: float) -> Column:
    """Seconds to wait after the given attempt (from 1), without jitter."""
    return F.least(F.lit(float(maximum)), F.lit(float(initial)) * F.pow(F.lit(float(multiplier)), attempt - 1))


def credential_state(available: Column, expires: Column, now: Column, warn_seconds: int) -> Column:
    left = F.unix_seconds(expires) - F.unix_seconds(now)
    return F.when(~available, "error").when(left <= 0, "error").when(left <= warn_seconds, "degraded").otherwise("ok")


def index_location(legacy: Column, configured: Column, pointed_to_legacy: Column) -> Column:
    """Where an index lives: configured_legacy, conflict, required, ready or empty."""
    return F.when(pointed_to_legacy, "configured_legacy").when(legacy & configured, "conflict").when(legacy, "required").when(configured, "ready").otherwise("empty")
