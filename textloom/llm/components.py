"""Connected components of a graph too large for one machine, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v). Large-star links every larger neighbour of a node to the least of its
    neighbourhood; small-star links every smaller neighbour, and the node itself, to the least one.

    The least is an aggregate that is combined before the shuffle and joined back, so that no neighbourhood is ever
    collected: a node with a third of all edges costs rows, not one task's memory.
    """
    pair = edges.select("u", "v")
    if large:
        pair = pair.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pair.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pair.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 60) -> DataFrame:
    """``(node, component)`` of all nodes of the undirected ``edges``; the component's id is its least node.

    Loops, doubled edges and either direction are allowed; edges with a null end are left out; an empty graph gives no
    rows. Every round is written to the shared folder, and the loop ends when a round changes nothing (a logarithmic
    number of rounds for all but contrived graphs); ``rounds`` guards against a loop without end and raises if reached.
    """
    x, y = F.col(a), F.col(b)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    nodes = now = materialize(now, "edges")
    seen = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, large=True), large=False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = nodes.select(F.col("v").alias("node")).distinct().join(now, F.col("node") == F.col("u"), "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

