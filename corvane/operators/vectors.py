"""Similarity of embedding columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, centroid): the mean vector of each group, from partial sums per dimension."""
    long = rows.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    parts = long.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("parts"))
    return parts.select(group, F.transform("parts", lambda p: p["x"]).alias("centroid"))
