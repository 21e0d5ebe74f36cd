"""Vectors as ARRAY columns: products, norms, distances and element-wise means, all JVM-side.

Components are cast to double before any product.  A null vector gives null; vectors of unequal length give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n)).otherwise(as_double(v))


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def scale(v, s) -> Column:
    return F.transform(_c(v), lambda x: x * s)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each group: one row a component is shuffled after map-side sums."""
    parts = df.select(*keys, F.posexplode(as_double(vector)).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["x"]).alias(out))


def component_stats(df: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, mean, std): mean and population deviation of each component."""
    parts = df.select(*keys, F.posexplode(as_double(vector)).alias("pos", "x"))
    return parts.groupBy(*keys, "pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def cross(a, b) -> Column:
    """Cross product of 3-vectors."""
    a, b = _c(a), _c(b)
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
