"""Connected components by repeated least labels and pointer jumps, on joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (a, b): the least node that can be reached.

    Each round gives a node the least label of its neighbours and then the label of that label, so the
    rounds grow with the logarithm of a component's width in all but contrived graphs. Each is written to
    the shared folder; only a count of changes reaches the driver. No group is gathered: least labels are
    sums with a map side, whatever the degree of a node.
    """
    both = written(edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        roots = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        new = written(step.join(roots, "next").select("node", F.least("next", "jump").alias("component"), (F.least("next", "jump") != F.col("component")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels
