"""Digests of configurations kept as JSON in a column, and the seeds of items derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import derive_seed

#: Fields of a configuration that say where it runs and not what it computes.
PLACE = ("_target", "device")
#: Levels of nesting that a configuration may have.
DEPTH = 16


def leaves(configs: DataFrame, key: str = "key", config: str = "config") -> DataFrame:
    """(key, path, value): the leaves of each JSON configuration, with their paths (`.name` and `[place]`) and JSON values.

    Objects and lists are exploded level by level as variants; empty ones are leaves.  Text that is no JSON is an error."""
    spark = configs.sparkSession
    rows = configs.select(F.col(key).alias("key"), F.lit("").alias("path"), F.parse_json(config).alias("value"))
    done = None
    for _ in range(DEPTH):
        inner = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<") & ~F.to_json("value").isin("{}", "[]")
        flat = rows.where(~inner).select("key", "path", F.to_json("value").alias("value"))
        done = flat if done is None else done.unionByName(flat)
        held = rows.where(inner).select("key", "path", F.col("value").alias("v"))
        held = cut(held.withColumn("v", F.to_json("v"))).withColumn("v", F.parse_json("v"))
        if held.isEmpty():
            return done
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        part = held.withColumnRenamed("key", "__key").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        rows = part.select(F.col("__key").alias("key"), F.concat("path", name).alias("path"), "value")
    raise ValueError(f"a configuration has more than {DEPTH} levels")


def config_digests(configs: DataFrame, key: str = "key", config: str = "config", dropped: tuple[str, ...] = PLACE) -> DataFrame:
    """(key, digest): SHA-1 of a configuration's leaves, `path=value` each and a line end after it, in order of the path;
    the dropped top-level fields and all below them do not count, nor does the order of fields."""
    gone = F.lit(False)
    for d in dropped:
        gone = gone | (F.col("path") == f".{d}") | F.col("path").startswith(f".{d}.") | F.col("path").startswith(f".{d}[")
    line = F.concat("path", F.lit("="), "value", F.lit("\n"))
    kept = F.array_sort(F.collect_list(F.when(~gone, F.struct("path", line.alias("line")))))
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "")
    return leaves(configs, key, config).groupBy("key").agg(F.sha1(text.cast("binary")).alias("digest"))


def item_seed(seed: Column, content: Column) -> Column:
    """The seed of an item: SHA-1 over the run's seed as text and the hexadecimal SHA-1 of the item's file."""
    return derive_seed(seed.cast("string"), F.sha1(content.cast("binary")))
