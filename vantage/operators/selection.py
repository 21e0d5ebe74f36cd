"""Choosing representative views: nearest to a centroid, or in front of a cluster's position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add, dot, euclidean, l2_normalize, mean_vectors, norm, scale, subtract
from .joins import checked


def views_nearest_to_centroids(views: DataFrame, centroids: DataFrame, similarity: str = "dot", largest_distance: bool = False) -> DataFrame:
    """(uid, cluster, view, score): for each centroid of an item the most similar of its views, the lowest on ties.

    similarity: dot (largest) or euclidean (smallest; largest_distance takes the largest, as an earlier
    implementation did).  Clusters of items without views give no row.  Pairs are those of one item only."""
    if similarity not in ("dot", "euclidean"):
        raise ValueError("similarity must be dot or euclidean")
    pairs = centroids.select("uid", "cluster", F.col("vector").alias("__c")).join(views.select("uid", "view", "vector"), "uid")
    score = F.round(dot("vector", "__c") if similarity == "dot" else euclidean("vector", "__c"), 9)
    sign = -1 if similarity == "dot" or largest_distance else 1
    best = pairs.groupBy("uid", "cluster").agg(F.min(F.struct((score * sign).alias("s"), "view")).alias("b"))
    return best.select("uid", "cluster", F.col("b.view").alias("view"), F.round(F.col("b.s") * sign, 6).alias("score"))


def split_means(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """(uid, cluster, own, other): mean position of a cluster's chosen samples and of all the item's other samples.

    points: (uid, cluster, sample, position); chosen: (uid, cluster, sample).  Without others `other` is the origin.
    Others are the item's sum less the chosen sum, so a point is read once, not once for every cluster."""
    parts = points.join(chosen.select("uid", "cluster", "sample", F.lit(1).alias("__in")), ["uid", "cluster", "sample"], "left")
    xyz = [F.col("position")[i] for i in range(3)]
    mine = F.col("__in").isNotNull()
    own = parts.where(mine).groupBy("uid", "cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(xyz)))
    whole = points.groupBy("uid").agg(F.count(F.lit(1)).alias("m"), *(F.sum(x).alias(f"t{i}") for i, x in enumerate(xyz)))
    j = own.join(whole, "uid")
    rest = F.col("m") - F.col("n")
    other = [F.when(rest > 0, (F.col(f"t{i}") - F.col(f"s{i}")) / rest).otherwise(0.0) for i in range(3)]
    return j.select("uid", "cluster", F.array(*(F.col(f"s{i}") / F.col("n") for i in range(3))).alias("own"), F.array(*other).alias("other"))


def views_in_front(views: DataFrame, means: DataFrame) -> DataFrame:
    """(uid, cluster, view, distance): of the views (uid, view, position) on the cluster's side the one with the least
    distance, the lowest on ties.

    The direction is own - other, normalised.  As the original defines it, the projected point is absolute while the
    view is taken relative to the cluster; that formula is kept because it decides the result."""
    m = means.withColumn("__d", l2_normalize(subtract("own", "other")))
    j = m.join(views.select("uid", "view", F.col("position").alias("__p")), "uid")
    j = j.withColumn("__rel", subtract("__p", "own")).withColumn("__t", dot("__rel", "__d")).where("__t >= 0")
    away = subtract("__rel", add("own", scale("__d", F.col("__t"))))
    j = j.withColumn("__dist", F.round(norm(away), 9))
    best = j.groupBy("uid", "cluster").agg(F.min(F.struct("__dist", "view")).alias("b"))
    return best.select("uid", "cluster", F.col("b.view").alias("view"), F.round(F.col("b.__dist"), 6).alias("distance"))


def lookup_views(selection: DataFrame, views: DataFrame) -> DataFrame:
    """selection (uid, cluster, view) with the view's other columns; found tells whether it exists."""
    return selection.join(views.withColumn("found", F.lit(True)), ["uid", "view"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def mean_direction(points: DataFrame) -> DataFrame:
    return mean_vectors(points, ["uid"], "position", "mean")


def selected_view_shades(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """(uid, cluster, view, sample, own, similarity, shade): every sample of an item against every selected view.

    samples: (uid, sample, cluster, vector); selected: (uid, cluster, view, vector), few an item.  own: the sample is of
    the view's cluster.  shade: the similarity on the scale of all of the item's selected views, 0 where all are equal."""
    views = selected.groupBy("uid").agg(F.collect_list(F.struct("cluster", "view", F.col("vector").alias("w"))).alias("__views"))
    j = samples.select("uid", "sample", F.col("cluster").alias("__own"), "vector").join(checked(views), "uid")
    j = j.select("uid", "sample", "__own", "vector", F.inline("__views"))
    j = j.select("uid", "cluster", "view", "sample", (F.col("__own") == F.col("cluster")).alias("own"), F.round(dot("vector", "w"), 9).alias("similarity"))
    ends = j.groupBy("uid").agg(F.min("similarity").alias("__lo"), F.max("similarity").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    shade = F.when(span > 0, (F.col("similarity") - F.col("__lo")) / span).otherwise(F.when(F.col("similarity").isNotNull(), 0.0))
    return j.join(checked(ends), "uid").withColumn("shade", shade).drop("__lo", "__hi")
