"""The evaluation as a whole: views of items, methods that turn them into vectors, ranked curves, areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import mean_vectors
from ..operators import evaluation as ev

#: A method gives (uid, vector) rows of views (uid, view, category, vector); an item may have several rows.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "avg_selected": lambda v: mean_vectors(v, ["uid"], "vector", "vector"),
    "best_selected": lambda v: v.select("uid", "vector"),
}


def evaluate(views: DataFrame, categories: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(method, category, auc).

    Category sizes count the items of all methods together, rankings those of one: a method that lost items cannot
    reach recall 1.  Nulls take no part; an item is in the category of its views."""
    vectors = None
    for name, method in (methods or METHODS).items():
        v = method(views).select(F.lit(name).alias("method"), "uid", "vector")
        vectors = v if vectors is None else vectors.unionByName(v)
    own = cut(views.select("uid", F.col("category").alias("own")).distinct())
    scores = ev.similarity_to_all(vectors.join(own, "uid"), categories, ("method", "uid", "own"))
    scores = scores.withColumn("relevant", F.col("own") == F.col("category"))
    sizes = own.groupBy(F.col("own").alias("category")).agg(F.count(F.lit(1)).alias("size"))
    keys = ("method", "category")
    return ev.area_under_curve(ev.precision_recall(scores, keys, sizes), keys)
