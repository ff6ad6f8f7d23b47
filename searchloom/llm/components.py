"""Connected components over an edge table, in rounds of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.tables import released, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the
    smallest node reachable. An empty table gives no rows.

    Each round hooks every node to its smallest neighbour if that is smaller,
    follows the hooks to their roots by pointer jumping, and goes on with the
    edges between different roots. Every step is an aggregate or a join by node
    over written tables, so a node with very many edges is combined before the
    shuffle and its part of a join can be split.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "hooks")
        if root.isEmpty():
            break
        while True:
            up = root.select(F.col("node").alias("component"), F.col("component").alias("next"))
            jumped = written(root.join(up, "component").select("node", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved")), "jumps")
            released(root)
            root = jumped
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = root
        else:
            step = root.select(F.col("node").alias("component"), F.col("component").alias("next"))
            old = labels
            labels = written(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            released(old)
        of = lambda c: root.select(F.col("node").alias(c), F.col("component").alias(f"r{c}"))  # noqa: B023, E731
        left = edges
        edges = written(edges.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        released(left, *([root] if root is not labels else []))
    last = labels if labels is not None else root
    out = last.select("node", "component")
    out._written = last._written
    return out
