"""Distances and centroids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance: differences as doubles, summed from the left."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def squared_l2_int(a: Column | str, b: Column | str) -> Column:
    """The same for integer vectors, exact in any order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


METRICS = {"l2": squared_l2, "l2_int": squared_l2_int}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}; known: {sorted(METRICS)}")
    return METRICS[name]


def more_similar(to_a: Column, to_b: Column) -> Column:
    """1 if a is closer than b, 0 if equal, -1 otherwise."""
    return F.signum(to_b - to_a).cast("int")


def comparator(name: str):
    """``more_similar`` for a metric's distances, by its name: smaller ones are more similar in every metric that there is."""
    metric(name)
    return more_similar


def quantised(vector: Column | str) -> Column:
    """Components in [-1, 1] as integers 0 to 255."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor((x.cast("double") + 1.0) * 127.5).cast("int"))


def centroids(rows: DataFrame, by: list[str], vector: str = "vec", integer: bool = True) -> DataFrame:
    """Mean of each component for each group, as column ``vec`` and count ``n``; integer means are cut to whole numbers.

    Components are summed one by one, so sums combine before the shuffle and no group is gathered."""
    mean = F.expr("sum_x div n").cast("int") if integer else F.col("sum_x") / F.col("n")
    parts = rows.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i")
    parts = parts.agg(F.sum(F.col("x").cast("long" if integer else "double")).alias("sum_x"), F.count(F.lit(1)).alias("n")).withColumn("m", mean)
    out = parts.groupBy(*by) if by else parts.groupBy()
    return out.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"), F.max("n").alias("n"))
