"""Vector expressions over array columns; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles; the cosine if both are of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """True cosine of two arrays; null if either is a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def l2_to_cosine(distance: Column) -> Column:
    """Cosine of two unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2


def unit(a: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def pool(df: DataFrame, key: str | list[str], vector: str, how: str = "avg") -> DataFrame:
    """(key..., vector): element-wise mean (``avg``) or maximum (``max``) of each group, at unit length."""
    keys = [key] if isinstance(key, str) else key
    places = df.select(*keys, F.posexplode(doubles(vector)).alias("_place", "_x"))
    one = places.groupBy(*keys, "_place").agg((F.avg if how == "avg" else F.max)("_x").alias("_x"))
    whole = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "_x"))).alias("_v"))
    return whole.select(*keys, unit(F.transform("_v", lambda p: p["_x"])).alias(vector))
