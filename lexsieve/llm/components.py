"""Connected components by alternating stars, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.sources.shared import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of a node are linked to the least of them instead.

    The least neighbour is found by a partial minimum and joined back, so no list of neighbours is
    ever gathered; Spark splits the join where one node has very many.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = sides.join(least, "a")
    if large:
        new = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = new.unionByName(least.filter("a != m").select("a", F.col("m").alias("b")))
    return new.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the label is the least node reachable.

    Each round is written to the shared folder, so a lost executor costs one round at most;
    the number of rounds grows with the logarithm of the longest chain. Edges to itself keep
    a node in the result. Only a count and a checksum per round reach the driver.
    """
    higher, lower = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = settle(edges.select(higher, lower).filter("a != b").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = settle(_star(_star(now, large=True), large=False))
    # At the end every node but the least of its component has one edge, to that least one.
    found = now.groupBy("a").agg(F.min("b").alias("label"))
    return nodes.join(found, F.col("node") == F.col("a"), "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
