"""Connected components by alternating large-star and small-star steps.

Each step links nodes to the smallest one that they see; all work is joins and minima that combine before the shuffle,
and every round is a table in the shared folder. Ends when a round changes nothing: every component is then a star
around its smallest node; nodes only ever move to smaller ones, so it does end, after about as many rounds as the longest
path's logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another: root is the component's smallest node. Nulls and loops are no links."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = stored(e.distinct())
    seen = _state(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stored(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        old, e = e, stored(small.distinct())
        drop_stored(large)
        drop_stored(old)
        now = _state(e)
        if now == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, root) after more links (a, b) between their components or single nodes."""
    if edges.isEmpty():
        return labels
    roots = labels.select("node", "root")
    for c in ("a", "b"):
        edges = edges.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    merged = components(edges)
    moved = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
    out = labels.join(moved, labels["root"] == moved["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    # Roots that moved, and single nodes, aren't in labels as nodes.
    return stored(out.unionByName(merged))


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
