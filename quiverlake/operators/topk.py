"""Ordered lists of the nearest: keep, merge, trim and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, key: str = "qid", distance: str = "distance", tie: str = "vec_id") -> DataFrame:
    """The k nearest of each key with ``rank`` from 1; ties go to the smaller id. Spark trims each partition before the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy(key).orderBy(distance, tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge(a: DataFrame, b: DataFrame, k: int, key: str = "qid", tie: str = "vec_id", distinct: bool = True) -> DataFrame:
    """Two partial lists as one of at most k, without entries that both hold."""
    both = a.select(key, tie, "distance").unionByName(b.select(key, tie, "distance"))
    return top_k(both.dropDuplicates([key, tie]) if distinct else both, k, key, tie=tie)


def pop_back(lists: DataFrame, n: int = 1, key: str = "qid") -> DataFrame:
    """Without the n worst of each list."""
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    return lists.withColumn("_size", size).where(F.col("rank") <= F.col("_size") - n).drop("_size")


def ordered(lists: DataFrame, order: str = "decreasing_similarity", key: str = "qid") -> DataFrame:
    """decreasing_similarity: nearest first; increasing_similarity: farthest first, ranks counted from there; unsorted."""
    if order == "increasing_similarity":
        size = F.count(F.lit(1)).over(Window.partitionBy(key))
        return lists.withColumn("rank", (size - F.col("rank") + 1).cast("int"))
    if order not in ("decreasing_similarity", "unsorted"):
        raise ValueError(f"unknown order: {order}")
    return lists
