"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import fewer, staged, stored, unstaged


def _to_least(links: DataFrame) -> DataFrame:
    """(node, other) rows -> (node, least of the node and its others)."""
    return links.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60, size: int | None = None) -> DataFrame:
    """(node, component) for each node that has a link; component is the least node reachable.

    Each step is two aggregations and two joins, staged in the shared folder; the number of steps
    grows with the logarithm of the longest path. Self links and repeated links are harmless; no
    links give an empty table. size: bytes of the staged tables that the links come from, if known."""
    edges = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).where("node <> other").distinct()
    edges = staged(edges if size is None else fewer(edges, size), "edges")
    for _ in range(most):
        size = 2 * stored(edges)
        # settled: no node has two others, and no other is itself a node
        doubled = edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        chained = edges.select(F.col("other").alias("node")).join(edges.select("node"), "node", "left_semi")
        if not fewer(doubled, size).select("node").union(fewer(chained, size)).limit(1).count():
            break
        both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = both.join(_to_least(both), "node").where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        down = fewer(large, size).select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).where("node <> other").distinct()
        small = fewer(fewer(down, size).join(_to_least(down), "node"), size)
        edges, before = staged(
            fewer(small.select(F.col("other").alias("node"), F.col("least").alias("other"))
            .union(small.select("node", F.col("least").alias("other")))
            .where("node <> other")
            .distinct(), size),
            "edges",
        ), edges
        unstaged(before)
    else:
        raise RuntimeError("components did not settle")
    found = edges.select("node", F.col("other").alias("component")).union(
        fewer(edges.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct(), size)
    )
    found = staged(found, "components")
    unstaged(edges)
    return found
