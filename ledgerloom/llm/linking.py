"""From bucket tables to classes: pivot stars first, then what stars cannot show, then connected components.

A bucket table has key, node, main (bool): a pair of nodes is a candidate if
both are in a bucket and one of them is main there.  Stars test every node
against one pivot of each of its buckets, so a bucket of any size costs as many
tests as it has rows.  Afterwards only buckets that still hold several classes
are looked at again, and there only pairs across classes, so no link is lost.
All tables stay in the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize


#: Rows of the edge tables that go to one file.
EDGES_A_FILE = 1_000_000


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of buckets with several nodes, one of them main at least, and the bucket's pivot."""
    by_key = buckets.groupBy("key").agg(F.min(F.when(F.col("main"), F.col("node"))).alias("pivot"), F.min("node").alias("low"), F.max("node").alias("top"))
    return materialize(buckets.join(by_key.where("pivot is not null and low < top").select("key", "pivot"), "key"), "buckets")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for nodes that have any.

    Large and small stars by turns, until the edges are stars around the
    smallest nodes, which takes about log(n) rounds.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    files = 1 + e.count() // EDGES_A_FILE
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        to_least = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(small.select(F.explode(to_least).alias("x")).select("x.u", "x.v").where("u <> v").distinct(), "edges", files)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one has none."""
    ends = e.select("u", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("m")))
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("m").alias("m")).where("n > 1 or (n > 0 and m > 0)").count() == 0


def merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) of the classes of first, joined by the links (a, b) found since.

    Only the links go through rounds, as edges between classes; a class is
    named by its smallest node, and so is what they are joined to.
    """
    of_node = first.select("node", "component")
    for end in ("a", "b"):
        more = more.join(of_node.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined = components(more.select("a", "b"))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    kept = of_node.join(to, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.join(of_node.select("node"), "node", "left_anti")  # nodes that had no class of several
    return kept.unionByName(alone.select("node", "component"))


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the nodes with links; verify keeps the linked ones of the pairs (a, b)."""
    shared = shared_buckets(materialize(buckets, "keys"))
    stars = shared.where("node <> pivot").select(*_pair("node", "pivot")).distinct()
    linked = materialize(verify(stars), "links")
    first = components(linked)
    classed = shared.join(first, "node", "left").select("key", "node", "main", F.coalesce("component", "node").alias("c"))
    mixed = classed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("top")).where("low < top").select("key")
    open_ = materialize(classed.join(mixed, "key", "left_semi"), "open")
    x, y = open_.where("main").alias("x"), open_.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & (~F.col("y.main") | (F.col("x.node") < F.col("y.node"))))
    rest = across.select(*_pair("x.node", "y.node")).distinct().join(stars, ["a", "b"], "left_anti")
    more = materialize(verify(rest), "links")
    return merged(first, more)
