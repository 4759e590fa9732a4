"""Connected components over an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any orderable type to (node, component): the smallest node reachable, for every node with an edge.

    Each round replaces the edges by as many or fewer with the same components; the minima combine before the shuffle,
    so a node with any number of edges is no bottleneck. About log(longest path) rounds, each written to the shared folder.
    Edges to the node itself and repeated edges do no harm; without edges the result is empty.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    while True:
        # large star: neighbours above the node go to the smallest neighbour
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: neighbours below the node, and the node, go to the smallest
        below = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = below.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = staged(small.where("u <> v").distinct(), "components")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
