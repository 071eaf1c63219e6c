"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, root: the least node of its component, for every node that has a link.

    Each round takes the least root among a node and its neighbours, then the root of that root; chains shorten by doubling. Every round
    is written to the shared folder, so a lost executor costs one round at most.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        stepped = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("step"))
        above = roots.select(F.col("node").alias("step"), F.col("root").alias("above"))
        moved = cut_lineage(stepped.join(above, "step").select("node", "old", F.least("step", "above").alias("root")))
        if moved.where("root != old").isEmpty():
            return moved.select("node", "root")
        roots = moved.select("node", "root")
