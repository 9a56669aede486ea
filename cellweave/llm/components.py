"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """v and root (the least node that v reaches) for every node of edges(a, b), both long and not null.

    Each round takes the least label among a node's neighbours and then the label of its label, and is written to the
    shared folder; rounds go as the logarithm of the longest chain.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels.v == near.a).select("v", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        hooked = materialize(hooked, "labels")
        up = hooked.select(F.col("v").alias("parent"), F.col("root").alias("above"))
        jumped = hooked.join(up, hooked.root == up.parent, "left").select("v", F.least("root", F.coalesce("above", "root")).alias("root"), "old")
        jumped = materialize(jumped, "labels")
        labels = jumped.select("v", "root")
        if jumped.where("root <> old").limit(1).count() == 0:
            return labels
