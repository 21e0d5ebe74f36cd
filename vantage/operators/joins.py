"""Join helpers: broadcasts behind a check of size, lookups with a default, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut

#: Bytes up to which a table is sent to all executors.
BROADCAST_BYTES = 16_000_000


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, about: 8 a number, the length of a text, the sum of what it holds."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 8
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        size = F.size(c) * 8 + 16
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + _bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _bytes(F.map_values(c), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(8)).cast("long")


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it takes at most `most` bytes; else unmarked, so that the join shuffles. Its plan is
    cut, so that weighing and join do not both compute it."""
    df = cut(df)
    return F.broadcast(df) if weight(df) <= most else df


def weight(df: DataFrame) -> int:
    """Bytes that df takes, about."""
    of_row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.agg(F.sum(of_row)).collect()[0][0] or 0  # one row


def reconcile(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, expected, actual, status): found, modified, missing or new, by a full outer join."""
    e = expected.select(key, F.col(digest).alias("expected"), F.lit(True).alias("__e"))
    a = actual.select(key, F.col(digest).alias("actual"), F.lit(True).alias("__a"))
    j = e.join(a, key, "full_outer")
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "new").when(F.col("expected").eqNullSafe(F.col("actual")), "found").otherwise("modified")
    return j.select(key, "expected", "actual", status.alias("status"))


def split_present(wanted: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """wanted with column present: whether the key is in the listing."""
    return wanted.join(listing.select(key).distinct().withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def include_exclude(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    if include is not None:
        df = df.join(include.select(key), key, "left_semi")
    return df.join(exclude.select(key), key, "left_anti") if exclude is not None else df


def require_subset(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """df; fails at run time if a key is not allowed."""
    marked = df.join(allowed.select(key).distinct().withColumn("__ok", F.lit(True)), key, "left")
    return marked.where(F.coalesce("__ok", F.raise_error(F.concat(F.lit("unknown key: "), F.col(key).cast("string"))).cast("boolean"))).drop("__ok")


def align(df: DataFrame, keys: DataFrame, key: str, value: str, default=None, missing: str = "default") -> DataFrame:
    """One row a key of `keys`, in its columns, with value; what is missing is skipped, defaulted or an error."""
    j = keys.join(df.select(key, value), key, "inner" if missing == "skip" else "left")
    if missing == "error":
        return j.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("no value for "), F.col(key).cast("string"))).cast(dict(df.dtypes)[value])))
    return j if default is None or missing == "skip" else j.withColumn(value, F.coalesce(value, F.lit(default)))


def rename(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Keys replaced by names(key, name) where given."""
    n = names.select(F.col(key).alias("__k"), "name")
    return df.join(n, F.col(key) == F.col("__k"), "left").withColumn(key, F.coalesce("name", key)).drop("__k", "name")


def last_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Union by name in which later tables override earlier rows of a key."""
    return first_wins(tables[::-1], key)


def first_wins(tables: list[DataFrame], key: str | list[str]) -> DataFrame:
    """Union by name in which the earliest table that has a key wins (priority of inputs)."""
    keys = [key] if isinstance(key, str) else key
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("__priority", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in every.columns if c not in keys)), "__priority").alias("__r"))
    return best.select(*keys, *(f"__r.{c}" for c in every.columns if c not in (*keys, "__priority")))


def compare_configs(expected: DataFrame, actual: DataFrame, bidirectional: bool = True) -> DataFrame:
    """(path, expected, actual, change) of (path, value) tables: missing, changed and, if bidirectional, unknown fields."""
    e = expected.select("path", F.col("value").alias("expected"), F.lit(1).alias("__e"))
    a = actual.select("path", F.col("value").alias("actual"), F.lit(1).alias("__a"))
    j = e.join(a, "path", "full_outer")
    change = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unknown").when(~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    out = j.select("path", "expected", "actual", change.alias("change")).where("change IS NOT NULL")
    return out if bidirectional else out.where("change <> 'unknown'")


def cached_values(wanted: DataFrame, cache: DataFrame, key: str = "key", checks: tuple[str, ...] = ("config_hash", "object_hash", "data_hash"), value: str = "value", required: bool = False) -> DataFrame:
    """wanted with the cached value where key and all hashes agree, else null (or an error if required)."""
    on = [key, *checks]
    out = wanted.join(cache.select(*on, value), on, "left")
    if required:
        out = out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("not cached: "), F.col(key).cast("string"))).cast(dict(cache.dtypes)[value])))
    return out
