"""Fusion of ranked branches, caps per path, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchloom.contracts import RERANKED, RRF_K


def ranked(hits: DataFrame, *order, by: tuple[str, ...] = (), branch: str) -> DataFrame:
    """hits with branch and rank (from 1), within each query if by is given."""
    over = W.partitionBy(*by).orderBy(*order) if by else W.partitionBy(F.lit(branch)).orderBy(*order)
    return hits.withColumn("branch", F.lit(branch)).withColumn("rank", F.row_number().over(over))


def rrf(branches: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, rrf, best_rank, lexical_only, fused_rank) of rows (by, branch,
    rank, id), and distance and bm25 where they have them. A repeated id
    accumulates; ties go to the better rank, then id."""
    facts = [F.max(c).alias(c) for c in ("distance", "bm25") if c in branches.columns]
    g = branches.groupBy(*by, "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), (~F.bool_or(F.col("branch") == "vector")).alias("lexical_only"), *facts)
    order = [F.desc(F.round("rrf", 12)), "best_rank", "id"]
    over = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)  # without by, at most two branches of candidates
    return g.withColumn("fused_rank", F.row_number().over(over))


def cap_per_path(fused: DataFrame, cap: int | None, window: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """fused (by, fused_rank, path) with capped_rank: hits below the cap of their
    path come first while the window has room, the others keep their order behind."""
    if cap is None:
        return fused.withColumn("capped_rank", F.col("fused_rank"))
    in_path = F.row_number().over(W.partitionBy(*by, "path").orderBy("fused_rank"))
    rows = fused.withColumn("__ok", (in_path <= cap).cast("int"))
    so_far = F.sum("__ok").over(W.partitionBy(*by).orderBy("fused_rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__in", (F.col("__ok") == 1) & (so_far <= window))
    return rows.withColumn("capped_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("__in"), "fused_rank"))).drop("__ok", "__in")


def multiplicity(fused: DataFrame, window: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The most hits of one path within the first `window` of each query."""
    return fused.where(F.col("fused_rank") <= window).groupBy(*by, "path").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max("n").alias("multiplicity"))


def rerank(hits: DataFrame, score: Callable[[DataFrame], DataFrame], first: int = RERANKED) -> tuple[DataFrame, str | None]:
    """(hits, reason): the first hits by score, which adds a column rerank_score;
    only they survive. If score fails, be it in a task, all hits in fused order,
    and why: the scored rows, at most `first`, are taken to the driver here."""
    spark = hits.sparkSession
    try:
        scored = score(hits.where(F.col("fused_rank") <= first))
        if "rerank_score" not in scored.columns:
            raise ValueError("no rerank_score")
        held = spark.createDataFrame(scored.toArrow())
        held = held.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in scored.schema])
        over = W.orderBy(F.desc("rerank_score"), "fused_rank")  # at most `first` rows
        return held.withColumn("final_rank", F.row_number().over(over)), None
    except Exception as error:  # a failing reranker degrades the search
        return hits.withColumn("final_rank", F.col("fused_rank")), f"reranker failed: {error}"


def warm(make: Callable[[], Callable]) -> tuple[Callable | None, str | None]:
    """(reranker, reason): make() is called once a process; of one that fails the
    reason is kept, so that searches go on without it and don't try again."""
    if make not in _WARM:
        try:
            _WARM[make] = (make(), None)
        except Exception as error:  # searches go on without a reranker
            _WARM[make] = (None, f"reranker unavailable: {error}")
    return _WARM[make]


_WARM: dict[Callable, tuple[Callable | None, str | None]] = {}


def overlap_score(query_tokens: list[str], text: str = "chunk") -> Callable[[DataFrame], DataFrame]:
    """A reranker that counts how many of the query's distinct tokens a text has."""
    from searchloom.functions.text import index_tokens

    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query_tokens)])
    return lambda hits: hits.withColumn("rerank_score", F.size(F.array_intersect(wanted, index_tokens(F.col(text)))).cast("double"))
