"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): one root for all nodes that the edges (u, v) connect, by contraction.

    Every node points to the least of its neighbours, where that one points to, and the edges between the classes are what the next
    round works on. Node ids should be hashes: neighbours are then in random order, and the classes shrink by a constant factor a round, however
    long the paths are. Minima are combined before they are shuffled and the joins are plain equi-joins, so a hub is split at run time.
    """
    edges = cut_lineage(edges.select("u", "v").distinct())
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not (edges := edges.where("u <> v")).isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        jump = near.select(F.col("u").alias("m"), F.col("m").alias("far"))
        to = cut_lineage(near.join(jump, "m").select(F.col("u").alias("root"), F.col("far").alias("next")))
        left, right = (to.select(F.col("root").alias(c), F.col("next").alias(n)) for c, n in (("u", "a"), ("v", "b")))
        roots = cut_lineage(roots.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        edges = cut_lineage(edges.join(left, "u").join(right, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    return roots
