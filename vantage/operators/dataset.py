"""Data-set preparation: filters, limits per category, stratified and seeded sampling, batches, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import uniform
from .joins import checked


def filter_items(items: DataFrame, categories: DataFrame | None = None, uids: DataFrame | None = None, per_category: int | None = None) -> DataFrame:
    """Items of the given categories and uids, at most per_category of each in list order (pos, then uid)."""
    if categories is not None:
        items = items.join(categories.select("category").distinct(), "category", "left_semi")
    if uids is not None:
        items = items.join(uids.select("uid").distinct(), "uid", "left_semi")
    return first_per_group(items, ["category"], ["pos", "uid"], per_category) if per_category is not None else items


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the window keeps n rows a group before its shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def last_category(items: DataFrame) -> DataFrame:
    """(uid, category): of a uid in several categories the last in list order."""
    return items.groupBy("uid").agg(F.max_by("category", F.struct("pos", "category")).alias("category"))


def categories_of_size(items: DataFrame, least: int) -> DataFrame:
    """(category, n) of categories with at least so many items, by name."""
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("category")


def seeded_sample(df: DataFrame, keys: list[str], key: str, n, seed: str, exact: bool = False) -> DataFrame:
    """n rows of each group without replacement, in order of a hash of seed, group and row key.

    n is a number or a column.  With exact, a group with fewer rows is an error."""
    tag = F.concat_ws("/", F.lit(seed), *(F.col(k).cast("string") for k in keys))
    w = Window.partitionBy(*keys).orderBy(uniform(tag, F.col(key)), key)
    want = F.lit(n) if isinstance(n, int) else n
    out = df.withColumn("__n", F.row_number().over(w))
    if exact:
        size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        out = out.withColumn("__ok", F.when(size >= want, F.lit(True)).otherwise(F.raise_error(F.lit("too few rows in a group")).cast("boolean"))).where("__ok").drop("__ok")
    return out.where(F.col("__n") <= want).drop("__n")


def sample_limit(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in order of a seeded hash: a distributed top-n."""
    return df.orderBy(uniform(F.lit(seed), F.col(key)), key).limit(n)


def random_views(views: DataFrame, counts: DataFrame, seed: str) -> DataFrame:
    """For each uid the number of views given in counts (uid, n), drawn without replacement; uids with fewer are left out."""
    w = Window.partitionBy("uid")
    tag = F.concat_ws("/", F.lit(seed), F.col("uid").cast("string"))
    v = views.join(counts, "uid").withColumn("__size", F.count(F.lit(1)).over(w)).where("__size >= n")
    v = v.withColumn("__r", F.row_number().over(w.orderBy(uniform(tag, F.col("view")), "view")))
    return v.where("__r <= n").drop("__r", "__size", "n")


def ranked(df: DataFrame, keys: list[str], order: list[Column], weight: str | None = None) -> DataFrame:
    """df with rank, from 1 by group in the given order; with a weight also running, its sum up to the row, and whole,
    its sum over the group (a null weight counts as 0).  A null key is a group.

    Rows are dealt in ranges of keys and order, then numbered within: a group of any size is spread over many tasks, if
    its order has few ties.  Between the steps there is a row for each range and group in it."""
    names = [f"__k{i}" for i in range(len(keys))]
    add = F.lit(0) if weight is None else F.coalesce(weight, F.lit(0))
    ranged = df.repartitionByRange(*(F.col(k) for k in keys), *order)
    ranged = cut(ranged.withColumns({"__p": F.spark_partition_id(), "__w": add}))
    sizes = ranged.groupBy("__p", *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w"))
    group = Window.partitionBy(*names)
    before = group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("__p").alias("__q"), *names, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("__w0"), F.sum("w").over(group).alias("whole"),
    )
    same = F.col("__p") == F.col("__q")
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    own = Window.partitionBy("__p", *keys).orderBy(*order)
    out = ranged.join(checked(starts), same)
    new = {"rank": F.col("__n0") + F.row_number().over(own)}
    if weight is not None:
        new |= {"running": F.col("__w0") + F.sum("__w").over(own.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.col("whole")}
    return out.select(*df.columns, *(c.alias(k) for k, c in new.items()))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with column batch: rows in key order, `size` a batch."""
    return ranked(df, [], [F.col(key)]).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long")).drop("rank")


def union_annotations(tables: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """Union by name of the tables whose source is wanted: others are not read; missing columns are null."""
    wanted = [t.withColumn("source_name", F.lit(k)) for k, t in tables.items() if only is None or k in only]
    out = wanted[0]
    for t in wanted[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def group_map(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """A row a group with the map name -> value; a repeated name keeps its smallest value."""
    one = df.groupBy(*keys, name).agg(F.min(value).alias(value))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("entries"))


def require_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value); fails at run time if a key has several values."""
    g = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ok = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(F.raise_error(F.concat(F.lit("several values for "), F.col(key).cast("string"))).cast(dict(df.dtypes)[value]))
    return g.select(key, ok.alias(value))
