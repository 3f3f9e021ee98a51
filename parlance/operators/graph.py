"""Connected components by alternating large-star and small-star joins.

Each star step is a grouped minimum (pre-aggregated where the links are read) joined back to the links, so the links of one node
are never gathered: a node that a third of all links meet costs a skewed join, which AQE splits. Each step is written to the
shared folder, and the loop ends when a step changes no link.

Defined results: links with a null end are ignored; a link from a node to itself makes the node a component; repeated links
count once; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the links with the least node of its component. Nodes are of any one ordered type."""
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = materialize(e.unionByName(e.select("a", F.col("a").alias("b"))).unionByName(e.select(F.col("b").alias("a"), "b")).distinct(), "links")
    if e.isEmpty():
        return e.toDF("node", "component")
    before = None
    while True:
        # Links of a node to itself keep single nodes; the stars work on the rest.
        stars = _large_star(e).unionByName(e.filter("a = b"))
        e = materialize(_small_star(materialize(stars, "large")), "small")
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("b")).toDF("node", "component")


def leaders(links: DataFrame) -> DataFrame:
    """(node, leader): the greedy grouping in order of node over links (a, b, similar nodes), each member under its least adjacent leader.

    A node leads if all its smaller neighbours are members; it is a member if one of them leads. Rounds over open links until none
    is left; this is what a pass over the nodes in order would give. Nodes without links are not listed (each leads itself).
    """
    e = links.select(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier")).filter("later <> earlier").distinct()
    e = materialize(e, "links")
    all_links, found = e, None
    nodes = e.select(F.explode(F.array("later", "earlier")).alias("node")).distinct()
    while not e.isEmpty():
        lead = e.select(F.col("earlier").alias("node")).distinct().join(e.select(F.col("later").alias("node")).distinct(), "node", "left_anti")
        members = materialize(e.join(lead.withColumnRenamed("node", "earlier"), "earlier", "left_semi").select(F.col("later").alias("node")).distinct(), "members")
        found = members if found is None else found.unionByName(members)
        e = e.join(members.withColumnRenamed("node", "later"), "later", "left_anti").join(members.withColumnRenamed("node", "earlier"), "earlier", "left_anti")
        e = materialize(e, "links")
    if found is None:
        return nodes.select("node", F.col("node").alias("leader"))
    leading = nodes.join(found, "node", "left_anti")
    joined = all_links.join(leading.withColumnRenamed("node", "earlier"), "earlier", "left_semi").groupBy(F.col("later").alias("node")).agg(F.min("earlier").alias("leader"))
    return leading.select("node", F.col("node").alias("leader")).unionByName(found.join(joined, "node").select("node", "leader"))
