"""X-means of all items in lockstep: every round is a few Spark jobs over the samples of all active items.

samples: (uid, sample, vector).  Centers are the only state between rounds (at most k_max rows an item); scores come
from sufficient statistics of the clusters (rows, sum of distances, sum of their squares), so an item of any size is
spread over many tasks.  `clustering.x_means` does the same within one task, from seeded centers.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import component_stats, l2_normalize
from .clustering import first_centroids, lloyd, nearest, packed, whiten, whitening
from .joins import checked


class XMeans(NamedTuple):
    centers: DataFrame  #: (uid, cluster, vector)
    labels: DataFrame  #: (uid, sample, cluster, distance), before whitening is undone
    trace: DataFrame  #: (uid, iteration, k, score)


def cluster_statistics(labels: DataFrame) -> DataFrame:
    """(uid, cluster, n, d1, d2) of assignments: rows, sum of distances, sum of squared distances."""
    d = F.col("distance")
    return labels.groupBy("uid", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("d1"), F.sum(d * d).alias("d2"))


def scores(statistics: DataFrame, dim: int, criterion: str = "bic") -> DataFrame:
    """(uid, k, score): the criterion of each item's clusters; null where there are no more rows than clusters."""
    n, k, d1, d2 = (F.col(c) for c in ("__n", "k", "__d1", "__d2"))
    totals = statistics.groupBy("uid").agg(
        F.sum("n").cast("double").alias("__n"), F.count(F.lit(1)).cast("int").alias("k"),
        F.sum("d1").alias("__d1"), F.sum("d2").alias("__d2"), F.sum(F.col("n") * F.log("n")).alias("__nlogn"),
    )
    rule = _bic(n, k, d2, F.col("__nlogn"), dim) if criterion == "bic" else _mndl(n, k, d1, d2)
    return totals.select("uid", "k", F.when(n > k, rule).alias("score"))


def _bic(n: Column, k: Column, d2: Column, nlogn: Column, dim: int) -> Column:
    var = F.greatest(d2 / (n - k) / dim, F.lit(1e-300))
    likelihood = nlogn - n * F.log(n) - n * (0.5 * math.log(2 * math.pi)) - n * (0.5 * dim) * F.log(var) - (n - k) * (0.5 * dim)
    return likelihood - k * (0.5 * (dim + 1)) * F.log(n)


def _mndl(n: Column, k: Column, d1: Column, d2: Column, alpha: float = 0.9, beta: float = 0.9) -> Column:
    var = F.greatest(d2 / (n - k), F.lit(1e-300))
    sigma, kappa = F.sqrt(var), F.sqrt(1 + n / F.greatest(n - k, F.lit(1.0)))
    return d1 / n + sigma * (2 * alpha) / F.sqrt(n) * kappa + sigma * F.sqrt(2 * k) / n + var * (2 * beta) * F.sqrt(k.cast("double")) / n


def split_starts(members: DataFrame) -> DataFrame:
    """(uid, cluster 0 or 1, vector) of members (uid, sample, vector): the mean, one deviation down and up the component
    that varies most (the first on ties).  Groups without variance have none."""
    stats = component_stats(members, "vector", ("uid",))
    parts = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    rows = stats.groupBy("uid").agg(parts.alias("__p"))
    widest = F.array_max(F.transform("__p", lambda p: F.struct(F.round(p["std"], 9).alias("std"), (-p["pos"]).alias("pos"))))
    rows = rows.withColumn("__w", widest).where("__w.std > 0")
    side = lambda s: F.transform("__p", lambda p: p["mean"] + F.when(p["pos"] == -F.col("__w.pos"), p["std"] * s).otherwise(0.0))
    both = F.array(*(F.struct(F.lit(c).alias("cluster"), side(s).alias("vector")) for c, s in ((0, -1.0), (1, 1.0))))
    return rows.select("uid", F.inline(both))


def _splits(samples: DataFrame, centers: DataFrame, statistics: DataFrame, dim: int, rounds: int, criterion: str, k_max: int) -> DataFrame:
    """(uid, cluster, child, vector): children of the clusters that gain by a split, largest gain first, while the item
    has room for them."""
    parent = F.struct("uid", "cluster")
    members = nearest(samples, centers, keep=("vector",)).select(parent.alias("uid"), "sample", "vector")
    children = lloyd(members, split_starts(members), rounds)
    after = scores(cluster_statistics(nearest(members, children)), dim, criterion).where("k = 2")
    before = scores(statistics.select(parent.alias("uid"), "cluster", "n", "d1", "d2"), dim, criterion)
    gain = (F.col("after") - F.col("before")) * (1 if criterion == "bic" else -1)
    gains = after.select("uid", F.col("score").alias("after")).join(before.select("uid", F.col("score").alias("before")), "uid")
    gains = gains.select("uid", F.round(gain, 9).alias("gain")).where("gain > 0").select("uid.uid", "uid.cluster", "gain")
    room = statistics.groupBy("uid").agg((F.lit(k_max) - F.count(F.lit(1))).alias("__room"))
    order = Window.partitionBy("uid").orderBy(F.desc("gain"), "cluster")  # at most k_max rows an item
    taken = gains.withColumn("__r", F.row_number().over(order)).join(room, "uid").where("__r <= __room").select("uid", "cluster")
    parts = children.select("uid.uid", "uid.cluster", F.col("cluster").alias("child"), "vector")
    return parts.join(taken, ["uid", "cluster"])


def x_means_lockstep(samples: DataFrame, k_min: int, k_max: int, iterations: int = 10, rounds: int = 10, criterion: str = "bic", best: bool = False, whitened: bool = True, normalize: bool = True) -> XMeans:
    """Clusters of every item, split in two where the criterion (bic or mndl) gains, largest gain first, up to k_max.

    Starts are the k_min first samples of an item, and one deviation to both sides of a cluster's mean.  After each
    iteration only items that had a split go on.  best: the iteration of the best score in place of the last one (the
    earliest on ties).  Items without samples have no rows."""
    if criterion not in ("bic", "mndl"):
        raise ValueError(f"unknown criterion: {criterion}")
    if not 1 <= k_min <= k_max:
        raise ValueError("1 <= k_min <= k_max is needed")
    work = samples.select("uid", "sample", "vector").where("vector IS NOT NULL")
    scales = cut(whitening(work)) if whitened else None
    work = whiten(work, scales) if whitened else work
    size = work.select(F.size("vector").alias("n")).limit(1).collect()
    dim = size[0]["n"] if size else 0

    centers, active, history, trace = first_centroids(work, k_min), work, [], []
    for iteration in range(iterations + 1):
        centers = lloyd(active, centers, rounds)
        near = packed(centers)
        statistics = cut(cluster_statistics(nearest(active, near)))
        history.append(centers.withColumn("iteration", F.lit(iteration)))
        trace.append(scores(statistics, dim, criterion).withColumn("iteration", F.lit(iteration)))
        if iteration == iterations:
            break
        open_items = statistics.groupBy("uid").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") < k_max)
        going = cut(_splits(active.join(checked(open_items.select("uid")), "uid", "left_semi"), near, statistics, dim, rounds, criterion, k_max))
        if going.isEmpty():
            break
        items = checked(going.select("uid").distinct())
        active = work.join(items, "uid", "left_semi")
        kept = centers.join(items, "uid", "left_semi").join(going.select("uid", "cluster").distinct(), ["uid", "cluster"], "left_anti")
        every = kept.select("uid", "cluster", F.lit(0).alias("child"), "vector").unionByName(going)
        number = F.row_number().over(Window.partitionBy("uid").orderBy("cluster", "child")) - 1
        centers = every.select("uid", number.alias("cluster"), "vector")

    union = lambda tables: reduce(DataFrame.unionByName, tables)
    trace = union(trace).select("uid", "iteration", "k", "score")
    sign = 1 if criterion == "bic" else -1
    rank = F.struct(F.round(F.col("score") * sign, 9).alias("s"), (-F.col("iteration")).alias("i")) if best else F.col("iteration")
    chosen = trace.groupBy("uid").agg(F.max_by("iteration", rank).alias("iteration"))
    centers = cut(union(history).join(chosen, ["uid", "iteration"]).select("uid", "cluster", "vector"))
    labels = nearest(work, centers)
    if whitened:
        centers = whiten(centers, scales, back=True)
    if normalize:
        centers = centers.withColumn("vector", l2_normalize("vector"))
    return XMeans(centers, labels, trace)
