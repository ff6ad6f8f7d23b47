"""Hybrid search as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.contracts import RERANKED
from searchloom.operators import fusion
from searchloom.operators.filters import clamp_k
from searchloom.sources.index import Index, Scan


@dataclass
class SearchResults:
    """Hits, in final_rank order, and how they were found."""

    hits: DataFrame
    mode: str
    reason: str | None = None


def fused(source: Index | Scan, phrases: list[list[str]], query_vector: list[float], condition: Column | None = None) -> DataFrame:
    """(id, rrf, best_rank, lexical_only, fused_rank, distance, bm25) of both
    branches' candidates; the condition is on the filter columns."""
    v = fusion.ranked(source.vector(query_vector, condition), F.round("distance", 9), "id", branch="vector")
    v = v.select("branch", "rank", "id", "distance", F.lit(None).cast("double").alias("bm25"))
    x = fusion.ranked(source.lexical(phrases, condition), F.round("bm25", 9), "id", branch="lexical")
    x = x.select("branch", "rank", "id", F.lit(None).cast("double").alias("distance"), "bm25")
    return fusion.rrf(v.unionByName(x))  # at most 80 rows


def search(source: Index | Scan, phrases: list[list[str]], query_vector: list[float], k: int = 10, condition: Column | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, lexical_problem: str | None = None) -> SearchResults:
    """The k best chunks of an index, clamped to 1..10, with their columns.

    An index that another embedder made is refused before anything is read.
    Without a usable lexical index, which an Index tells by itself, the vector
    branch answers alone, with k candidates. Otherwise both branches are fused and, with a reranker, the
    first 20 reranked; if that fails, when planned or when run, the fused order
    stands.
    """
    k = clamp_k(k)
    if isinstance(source, Index):
        source.check()
        lexical_problem = lexical_problem or source.problem()
    if lexical_problem:
        v = fusion.ranked(source.vector(query_vector, condition, k), F.round("distance", 9), "id", branch="vector")
        v = v.select("id", F.col("rank").alias("final_rank"), "distance", F.lit(False).alias("lexical_only"))
        return SearchResults(source.hydrate(v), "vector-only", lexical_problem)
    hits = fused(source, phrases, query_vector, condition)
    if reranker is None:
        best = hits.where(F.col("fused_rank") <= k)
        return SearchResults(source.hydrate(best).withColumn("final_rank", F.col("fused_rank")), "hybrid", "no reranker")
    out, reason = fusion.rerank(source.hydrate(hits.where(F.col("fused_rank") <= RERANKED)), reranker)
    return SearchResults(out.where(F.col("final_rank") <= k), "hybrid" if reason else "hybrid+rerank", reason)
