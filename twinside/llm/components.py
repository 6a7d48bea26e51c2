"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinside.session import settle


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node.

    Large-star and small-star steps alternate until nothing changes: each node
    hands its larger (then its smaller) neighbours to the smallest one. A
    node's smallest neighbour is a map-side minimum; the join that hands it out
    is an equi join, whose skewed partitions Spark splits. Every round is
    written to the shared folder. Null nodes are left out.
    """
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := summary(now)) != before:
        before = state
        near = both_ways(now)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(star.filter("u <> v").distinct(), "edges")
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        star = now.join(least, "u")
        star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = settle(star.filter("u <> v").distinct(), "edges")
    named = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def rooted(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest (u, v) in which every v stands once, below a smaller u; roots have no row.

    Every round doubles the steps a node has jumped, so the rounds are the logarithm of the longest chain.
    """
    now = settle(parents.select(F.col("v").alias("node"), F.col("u").alias("component")), "rooted")
    while True:
        ahead = now.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        step = settle(now.join(ahead, "component", "left").select("node", F.coalesce("beyond", "component").alias("component"), F.col("beyond").isNotNull().alias("moved")), "rooted")
        now = step.select("node", "component")
        if step.filter("moved").isEmpty():
            return now


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (u, v) between components (node, component) are added; only components that links touch are searched."""
    at = lambda df, c: df.join(named.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    edges = at(at(links.select("u", "v"), "u"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")).filter("u <> v")
    joined = settle(components(edges), "joined")
    alone = joined.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    beyond = joined.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
    return settle(named.unionByName(alone).join(beyond, "component", "left").select("node", F.coalesce("beyond", "component").alias("component")), "named")
