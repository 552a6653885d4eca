"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """links: a, b. (node, component) for each node of a link; component is the smallest node that can be reached. Links
    with a null end are left out.

    Each round takes the smallest neighbour of each node, follows these to their ends, and puts the ends in place of the
    nodes: a link inside one of these groups is gone, so that most links meet labels once, however many rounds follow."""
    kept = links.where("a is not null and b is not null")
    edges = saved(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.least("a", "b").alias("least")).union(edges.select("b", F.least("a", "b")))
        ends = _ends(saved(both.groupBy("node").agg(F.min("least").alias("component"))))
        if labels is None:
            labels = ends
        else:
            further = ends.select(F.col("node").alias("component"), F.col("component").alias("upper"))
            labels = saved(labels.join(further, "component", "left").select("node", F.coalesce("upper", "component").alias("component")))
        low, high = (ends.select(F.col("node").alias(side), F.col("component").alias(f"{side}_end")) for side in ("a", "b"))
        moved = edges.join(low, "a").select("a_end", "b").join(high, "b").where("a_end <> b_end")
        edges = saved(moved.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def _ends(nearer: DataFrame) -> DataFrame:
    """(node, component) with each component, a smaller node or the node itself, followed to its end."""
    while True:
        up = nearer.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        jumped = saved(nearer.join(up, "component").select("node", "component", "upper"))
        nearer = jumped.select("node", F.col("upper").alias("component"))
        if jumped.where("upper <> component").isEmpty():
            return nearer
