"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """links a, b -> node, root: the smallest node that each node of a link can reach.

    Every node takes its smallest neighbour as parent, parents are followed twice, and what links the
    trees found so far is the next, smaller graph, until none is left. Rows stay one for each node or
    link; a node with very many links is joined on, never gathered: the side with its many rows is the one
    that adaptive execution splits, as the other has one row for each node."""
    edges = common.store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    found: DataFrame | None = None
    while found is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
        up = common.store(both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("root")), "parents")
        for _ in range(2):
            next_ = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            up = up.join(next_, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
        up = common.store(up, "parents")
        step = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = up if found is None else common.store(found.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")
        edges = edges.join(step.withColumnsRenamed({"_n": "a", "_r": "ra"}), "a").join(step.withColumnsRenamed({"_n": "b", "_r": "rb"}), "b")
        edges = common.store(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct(), "links")
    return found
