"""Connected components of a graph, in joins and aggregates of pre-summed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node that each node of ``edges`` (a, b) reaches.

    Every round hangs each node on the least of itself and its neighbours, follows those pointers to their roots, and
    contracts the edges to roots; what is left shrinks by half at least. Nodes are then led through all rounds' roots.
    Minima are summed up before they are shuffled, so a hub costs no more than its edges; each round is a written table.
    """
    links = stage(edges.filter("a <> b").select("a", "b").distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
        roots = stage(roots, "roots")
        while True:  # pointers go to ever smaller nodes; doubling ends after as many steps as the log of the chain
            up = roots.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            jumped = roots.join(up, F.col("root") == F.col("mid")).select("node", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved"))
            jumped = stage(jumped, "roots")
            roots = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        rounds.append(roots)
        left, right = (roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
        links = links.join(left, "a").join(right, "b").filter("ra <> rb")
        links = stage(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = rounds[0].select("node", F.col("root").alias("component"))
    for later in rounds[1:]:
        later = later.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        found = found.join(later, F.col("component") == F.col("mid"), "left").select("node", F.coalesce("top", "component").alias("component"))
    return found
