"""Connected components of an undirected graph given as edges, by star contraction.

Large-star and small-star steps alternate until nothing changes.  Each step is an
aggregate (smallest neighbour) and a join; no neighbour lists are gathered, so a
node with very many edges is split like any skewed key.  Lineage is cut by
``checkpoint()`` after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.session import cut_lineage


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): each edge with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one type); root is the smallest node connected to it."""
    edges = cut_lineage(edges.select("u", "v").filter("u <> v")
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the smallest neighbour
        large = (_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")))
        # small star: smaller neighbours, and the node itself, move to the smallest one
        small = _with_least(large.distinct())
        new = (small.select(F.col("v").alias("u"), F.col("least").alias("v"))
               .unionByName(small.select("u", F.col("least").alias("v"))).filter("u <> v").distinct())
        new = cut_lineage(new)
        moved = new.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not moved:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
