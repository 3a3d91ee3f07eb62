"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); nodes share a root if a path joins them.

    Each round joins every node to its smallest neighbour and contracts the graph, so with node ids that are hashes
    a round leaves a constant part of the nodes: rounds grow with the logarithm of the graph. Rounds are written to the
    shared folder; only "is there an edge left" comes to the driver. Null ends and loops are left out; an empty edge
    list gives an empty result.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a is not null and b is not null and a <> b").distinct(), purpose)
    labels = None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")), purpose)
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            hop = step.select(F.col("node").alias("root"), "to")
            labels = written(labels.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), purpose)
        ends = left
        for end in ("a", "b"):
            ends = ends.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        left = written(ends.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                       .filter("a <> b").distinct(), purpose)
    return labels
