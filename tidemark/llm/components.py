"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation (minimum of the neighbours, combined before the shuffle) and an equi-join, so a node with very
many edges is split by adaptive execution and never meets in one task.  Every iteration is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

#: A bound against a faulty loop; the number of iterations grows with the logarithm of the size of a component.
MAX_ITERATIONS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v with v < u.  Connects neighbours to the least of a node's neighbourhood."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:  # larger neighbours move to the least
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the node and its smaller neighbours move to the least
        out = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str, files: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that is not its component's smallest.

    ``edges`` has two columns of one type.  Loops, repeated edges and edges with a null end count for nothing.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen = None
    for k in range(MAX_ITERATIONS):
        watch = Observation()
        step = now if k == 0 else _star(_star(now, True), False)
        sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")]
        now = scratch.write(step.observe(watch, *sums), f"{name}-{k}", files)
        state = (watch.get["n"], watch.get["s"])
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
    raise RuntimeError("components did not settle")
