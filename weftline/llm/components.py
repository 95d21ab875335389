"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) -> (node, root): each node that has a link, with the smallest node it reaches.

    Each round sends the label of one end of a link to the other end and to that
    end's label, keeps the least, and jumps to the label's label; rounds grow as
    the logarithm of the longest path.  Aggregation takes the least before the
    shuffle, so a node with many links sends one row per task.  Links to itself
    or with a null end are left out; no links give an empty table.
    """
    links = links.where(F.col("a") != F.col("b")).select("a", "b")
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), f"{name}-labels")
    while True:
        mine = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        other = labels.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        met = both.join(mine, "a").join(other, "b").where(F.col("root_b") < F.col("root_a"))
        told = met.select(F.explode(F.array("a", "root_a")).alias("node"), "root_b").groupBy("node").agg(F.min("root_b").alias("told"))
        hooked = labels.join(told, "node", "left").select("node", F.least("root", "told").alias("root"), F.col("told").isNotNull().alias("moved"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = stage(
            hooked.join(up, "root", "left").select("node", F.least("root", "above").alias("root"), (F.col("moved") | (F.col("above") < F.col("root"))).alias("moved")),
            f"{name}-labels",
        )
        labels = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return labels
