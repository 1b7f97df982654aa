"""Vectors in double precision over float arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parts of one in which components are added up.
UNITS = float(1 << 32)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def mean_vector(rows: DataFrame, group: str, vector: str, into: str = "centroid") -> DataFrame:
    """(group, centroid array<float>): the mean of each group's vectors, position by position; partial sums travel, not vectors.

    Components are added up as whole multiples of 2^-32, so the sum does not depend on the order of rows; components beyond 2^30 are an error.
    """
    each = rows.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("pos", "x"))
    whole = F.floor(F.col("x").cast("double") * UNITS + 0.5).cast("long")
    means = each.groupBy(group, "pos").agg((F.sum(whole).cast("double") / F.count(F.lit(1)) / UNITS).cast("float").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["x"]).alias(into))
