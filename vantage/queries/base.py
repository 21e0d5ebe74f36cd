"""Registration, tables and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double


def registrar() -> tuple[dict, Callable]:
    every: dict = {}

    def query(sql: str | None = None, name: str | None = None):
        def put(f):
            every[name or f.__name__] = (f, sql)
            return f

        return put

    return every, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, category, vector): embeddings as items of a category."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("uid"), F.col("label").alias("category"), as_double("embedding").alias("vector"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, view, category, vector): five embeddings make the views of an item, in the category of its first."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.floor(F.col("vec_id") / 5).cast("long").alias("uid"), (F.col("vec_id") % 5).cast("int").alias("view"), "label", as_double("embedding").alias("vector"))
    first = v.where("view = 0").select("uid", F.col("label").alias("category"))
    return v.drop("label").join(first, "uid")


#: (uid, category, v), and (category, c): the normalised mean of each category.
ITEMS = "e AS (SELECT vec_id AS uid, label AS category, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
CENTROIDS = """
comp AS (SELECT category, pos, avg(x) AS x FROM (SELECT category, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM e) GROUP BY ALL),
mean AS (SELECT category, list(x ORDER BY pos) AS m FROM comp GROUP BY category),
cat AS (SELECT category, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM mean)"""
VIEWS = """
v0 AS (SELECT (vec_id // 5)::BIGINT AS uid, (vec_id % 5)::INTEGER AS view, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
w AS (SELECT v0.uid, v0.view, f.label AS category, v0.v FROM v0 JOIN v0 f ON f.uid = v0.uid AND f.view = 0)"""
