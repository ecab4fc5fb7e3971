"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the same for all nodes of a component.

    Each round points every node at its smallest neighbour (or itself), shortens the pointers once, and
    goes on with the links between pointers; each round leaves at most half of the nodes. Minima are
    partial aggregates, joins are on one row per node, and every round is a written table.
    """
    links = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")), "pointers")
        jump = point.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        point = settle(point.join(jump, F.col("to") == F.col("_n")).select("node", F.col("_t").alias("to")), "pointers")
        jump = point.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        if roots is None:
            roots = point.withColumnRenamed("to", "root")
        else:
            roots = settle(roots.join(jump, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_t", "root").alias("root")), "roots")
        near = links.join(jump, F.col("a") == F.col("_n")).select(F.col("_t").alias("a"), "b")
        near = near.join(jump, F.col("b") == F.col("_n")).select("a", F.col("_t").alias("b"))
        links = settle(near.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return roots
