"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b), two columns of one type; root is the component's
    smallest node. Links to itself and null nodes are left out.

    Every round moves each node's links to its smallest neighbour; the number of rounds grows with the
    logarithm of the longest chain. Each round is a table in the shared folder. Minimums combine before
    their shuffle, and the joins are plain ones that Spark can split where a node has very many links.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(least).distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
