"""Connected components by alternating large-star and small-star steps, each an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node (or only its larger ones) to the smallest of the node and its neighbours.

    ``edges`` has u and v. The smallest is an aggregate with partial sums, and the join can split a node that has
    very many neighbours, so no node is gathered in one place.
    """
    smallest = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(smallest, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From undirected edges (a, b) of long ids: node, component (the smallest id that can be reached).

    Nodes without an edge do not appear. Null ends, loops and repeated edges are ignored. Every round is written to
    the shared folder, so a lost executor costs one round at most.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "components")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, larger_only=True)
        last, edges = edges, materialise(_to_smallest(large, larger_only=False), "components")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def widened(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more edges (a, b): only the components that the new edges touch are looked at.

    Ends that no label has are components of their own so far. Which node names a component is left open. Written.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    every = labels.select("node", "component").unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    every = materialise(every, "labels")
    of = lambda side, name: every.select(F.col("node").alias(side), F.col("component").alias(name))
    between = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(between).select(F.col("node").alias("component"), F.col("component").alias("now"))
    out = materialise(every.join(found, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
    discard(every)
    return out
