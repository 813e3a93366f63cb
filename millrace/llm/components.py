"""Connected components of a graph that is too large for one machine.

Every round takes each node to its smallest neighbour (or itself), contracts the
graph along that map and drops loops and repeated edges.  A star is gone after one
round and a path halves, so the number of rounds grows with the logarithm of the
longest path.  The label of a node is the composition of the rounds' maps.

Both sides of every join are tables in the shared folder, so that a hub with a large
share of all edges is split by adaptive execution instead of meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node."""
    now = scratch.cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    label: DataFrame | None = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = scratch.cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        if label is None:
            after = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            mapped = label.join(up, label.component == up.u, "left")
            after = scratch.cut(mapped.select("node", F.coalesce("p", "component").alias("component")))
        left = now.join(up.select("u", F.col("p").alias("pu")), "u").select("v", "pu")
        step = scratch.cut(left)
        right = step.join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        new = scratch.cut(right.filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        scratch.drop(now, step)
        now, label = new, after
    if label is None:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label
