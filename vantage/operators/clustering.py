"""Clustering of embedded samples: whitening, Lloyd rounds, elbows, x-means, largest clusters.

samples: (uid, sample, vector).  `uid` groups the samples of one item; every operator works on all items at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import as_double, component_stats, euclidean, l2_normalize, mean_vectors
from .joins import checked


def whitening(samples: DataFrame) -> DataFrame:
    """(uid, scale): 1 / population deviation of each component, 1 where it is 0; non-finite values are an error."""
    stats = component_stats(samples, "vector", ("uid",))
    bad = F.isnan("std") | (F.abs("std") == F.lit(float("inf")))
    s = F.when(bad, F.raise_error(F.lit("non-finite deviation")).cast("double")).when(F.col("std") == 0, 1.0).otherwise(1.0 / F.col("std"))
    return stats.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", s.alias("s")))), lambda x: x["s"]).alias("scale"))


def whiten(vectors: DataFrame, scales: DataFrame, back: bool = False) -> DataFrame:
    """vectors times the scales of their uid (or divided by them)."""
    op = (lambda x, s: x / s) if back else (lambda x, s: x * s)
    return vectors.join(checked(scales), "uid").withColumn("vector", F.zip_with(as_double("vector"), "scale", op)).drop("scale")


def packed(centroids: DataFrame) -> DataFrame:
    """(uid, __c): the centroids (uid, cluster, vector) of each item as one array, so that a join keeps one row a sample."""
    rows = F.array_sort(F.collect_list(F.struct("cluster", "vector")))
    return checked(centroids.groupBy("uid").agg(rows.alias("__c")))


def nearest_of(vector: str, digits: int = 9) -> Column:
    """Struct (d, cluster) of the packed centroid that is nearest to the vector, the lowest cluster on ties."""
    d = F.transform("__c", lambda x: F.struct(F.round(euclidean(vector, x["vector"]), digits).alias("d"), x["cluster"].alias("cluster")))
    return F.array_min(F.filter(d, lambda x: x["d"].isNotNull()))


def nearest(samples: DataFrame, centroids: DataFrame, digits: int = 9, keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, sample, cluster, distance, keep...): the nearest of the item's centroids (uid, cluster, vector), the lowest on ties.

    Centroids may be given as `packed` ones."""
    j = samples.join(centroids if "__c" in centroids.columns else packed(centroids), "uid")
    best = nearest_of("vector", digits)
    return j.select("uid", "sample", best["cluster"].alias("cluster"), best["d"].alias("distance"), *keep)


def soft_assignment(samples: DataFrame, centroids: DataFrame) -> DataFrame:
    """(uid, sample, cluster, weight): distance over the sum of distances, as the original defines it: farther weighs more."""
    j = samples.join(packed(centroids), "uid")
    d = F.transform("__c", lambda x: F.struct(x["cluster"].alias("cluster"), euclidean("vector", x["vector"]).alias("d")))
    total = F.aggregate("__d", F.lit(0.0), lambda a, x: a + x["d"])
    j = j.withColumn("__d", d).withColumn("__t", total)
    return j.select("uid", "sample", "__t", F.explode("__d").alias("x")).select("uid", "sample", "x.cluster", (F.col("x.d") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(1.0)).alias("weight"))


def first_centroids(samples: DataFrame, k: int) -> DataFrame:
    """(uid, cluster, vector): the k first samples of each item."""
    w = Window.partitionBy("uid").orderBy("sample")
    return samples.withColumn("cluster", F.row_number().over(w) - 1).where(F.col("cluster") < k).select("uid", "cluster", as_double("vector").alias("vector"))


def lloyd(samples: DataFrame, centroids: DataFrame, rounds: int) -> DataFrame:
    """Centroids after a fixed number of rounds; a cluster without samples disappears.

    Means are partial sums a component before the shuffle.  Every round the small packed centroids are written out once,
    so that the plan does not grow."""
    c = packed(centroids)
    for _ in range(rounds):
        c = packed(mean_vectors(nearest(samples, c, keep=("vector",)), ["uid", "cluster"], "vector", "vector"))
    return c.select("uid", F.inline("__c"))


def k_means(samples: DataFrame, k: int, rounds: int = 10, whitened: bool = True, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(centroids, assignments): labels come from the whitened centroids before they are brought back and normalised."""
    scales = cut(whitening(samples)) if whitened else None
    work = whiten(samples.select("uid", "sample", "vector"), scales) if whitened else samples.select("uid", "sample", "vector")
    centers = lloyd(work, first_centroids(work, k), rounds)
    labels = nearest(work, centers)
    if whitened:
        centers = whiten(centers, scales, back=True)
    if normalize:
        centers = centers.withColumn("vector", l2_normalize("vector"))
    return centers, labels


def distortion(labels: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """(keys, distortion): mean Euclidean, not squared, distance to the centroid."""
    return labels.groupBy(*keys).agg(F.avg("distance").alias("distortion"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("uid", "cluster").agg(F.count(F.lit(1)).alias("n"))


def largest_clusters(labels: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """Centroids of the n largest clusters of each item, renumbered by size; ties by index."""
    w = Window.partitionBy("uid").orderBy(F.desc("n"), "cluster")
    top = cluster_sizes(labels).withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < n)
    return centroids.join(top, ["uid", "cluster"]).select("uid", F.col("r").alias("cluster"), "vector")


# --- elbows -------------------------------------------------------------------------------------------------------


def fractional_target(curve: DataFrame, fraction: float) -> DataFrame:
    """(uid, target) of curve (uid, k, d): last + (first - last) * fraction."""
    g = curve.groupBy("uid").agg(F.min_by("d", "k").alias("first"), F.max_by("d", "k").alias("last"))
    return g.select("uid", (F.col("last") + (F.col("first") - F.col("last")) * F.lit(fraction)).alias("target"))


def closest_target(curve: DataFrame, x_scale: float = 1.0, y_scale: float = 1.0, normalize: bool = True) -> DataFrame:
    """(uid, target): the distortion of the point nearest to the lower left corner, axes scaled to 0..1."""
    w = Window.partitionBy("uid")
    axis = lambda c: (F.col(c) - F.min(c).over(w)) / (F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-300)) if normalize else F.lit(1.0))
    p = curve.withColumn("dist", F.sqrt(F.pow(axis("k") * x_scale, 2) + F.pow(axis("d") * y_scale, 2)))
    return p.groupBy("uid").agg(F.min_by("d", F.struct(F.round("dist", 9), "k")).alias("target"))


def predict_k(curve: DataFrame, targets: DataFrame) -> DataFrame:
    """(uid, target, frac_k, k): where the curve first crosses the target, by linear interpolation; else the nearest k."""
    w = Window.partitionBy("uid").orderBy("k")
    seg = curve.withColumns({"k1": F.lead("k").over(w), "d1": F.lead("d").over(w)}).join(targets, "uid")
    crossing = (F.col("target") >= F.col("d1")) & (F.col("target") <= F.col("d"))
    t = F.when(F.col("d") > F.col("d1"), (F.col("target") - F.col("d1")) / (F.col("d") - F.col("d1"))).otherwise(1.0)
    frac = F.when(crossing, F.col("k1") + (F.col("k") - F.col("k1")) * t)
    near = F.min_by("k", F.struct(F.abs(F.col("d") - F.col("target")), "k"))
    out = seg.groupBy("uid").agg(F.max("target").alias("target"), F.min_by(frac, F.when(crossing, F.col("k"))).alias("f"), near.cast("double").alias("near"))
    out = out.select("uid", "target", F.coalesce("f", "near").alias("frac_k"))
    return out.withColumn("k", F.bround("frac_k").cast("int"))


def fill_scores(scores: DataFrame) -> DataFrame:
    """(uid, k, score) for every k between the item's least and largest, gaps filled linearly."""
    ends = scores.groupBy("uid").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    grid = ends.select("uid", F.explode(F.sequence("lo", "hi")).alias("k")).join(scores, ["uid", "k"], "left")
    w = Window.partitionBy("uid").orderBy("k")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("score").isNotNull(), F.struct("k", "score"))
    a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
    lerp = a["score"] + (b["score"] - a["score"]) * (F.col("k") - a["k"]) / F.greatest(b["k"] - a["k"], F.lit(1))
    return grid.select("uid", "k", lerp.alias("score"))


# --- x-means: per item, numpy ------------------------------------------------------------------


def _lloyd(x: np.ndarray, centers: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        d = ((x[:, None] - centers[None]) ** 2).sum(2)
        new = d.argmin(1)
        used = np.unique(new)
        moved = np.stack([x[new == c].mean(0) for c in used])
        done = len(moved) == len(centers) and np.allclose(moved, centers, atol=1e-9)
        centers, labels = moved, np.searchsorted(used, new)
        if done:
            break
    return centers, labels


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Start centers: each next one is a sample drawn with probability by squared distance to those chosen."""
    centers = [x[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        d = np.min([((x - c) ** 2).sum(1) for c in centers], 0)
        if d.sum() <= 0:
            break
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
    return np.array(centers)


def bic(x: np.ndarray, labels: np.ndarray, centers: np.ndarray) -> float:
    """Bayesian information criterion of a spherical mixture; larger is better."""
    n, dim, k = len(x), x.shape[1], len(centers)
    if n <= k:
        return -np.inf
    var = max(((x - centers[labels]) ** 2).sum() / (n - k) / dim, 1e-300)
    free = k * (dim + 1)
    sizes = np.bincount(labels, minlength=k)
    sizes = sizes[sizes > 0]
    like = (sizes * np.log(sizes) - sizes * np.log(n) - sizes * 0.5 * np.log(2 * np.pi) - sizes * dim * 0.5 * np.log(var) - (sizes - 1) * 0.5 * dim).sum()
    return float(like - 0.5 * free * np.log(n))


def mndl(x: np.ndarray, labels: np.ndarray, centers: np.ndarray, alpha: float = 0.9, beta: float = 0.9) -> float:
    """Minimum noiseless description length; smaller is better."""
    n, k = len(x), len(centers)
    if n <= k:
        return np.inf
    distance = np.sqrt(((x - centers[labels]) ** 2).sum(1))
    w = distance.sum() / n
    sigma = np.sqrt(max((distance**2).sum() / (n - k), 1e-300))
    kappa = np.sqrt(1 + n / max(n - k, 1))
    return float(w + 2 * alpha * sigma / np.sqrt(n) * kappa + sigma * np.sqrt(2 * k) / n + 2 * beta * sigma**2 * np.sqrt(k) / n)


def x_means(x: np.ndarray, k_min: int, k_max: int, seed: int = 0, criterion: str = "bic", rounds: int = 10, every_split: bool = False):
    """(centers, labels, trace): clusters are split in two where the criterion gains, largest gain first, up to k_max.

    trace: (iteration, number of clusters, score, centers, labels) of the whole after each round; with every_split
    after each split of a round too, the others left as they were."""
    rng = np.random.default_rng(seed)
    score, sign = (bic, 1) if criterion == "bic" else (mndl, -1)

    def whole(start: list[np.ndarray], iteration: int):
        c, own = _lloyd(x, np.concatenate(start), rounds)
        return iteration, len(c), score(x, own, c), c, own

    trace = [whole([_spread(x, k_min, rng)], 0)]
    now, iteration = trace[0], 0
    while now[1] < k_max:
        iteration += 1
        centers, labels = now[3:]
        splits = []
        for c in range(len(centers)):
            own = x[labels == c]
            if len(own) < 2:
                continue
            children, child_labels = _lloyd(own, _spread(own, 2, rng), rounds)
            if len(children) < 2:
                continue
            gain = sign * (score(own, child_labels, children) - score(own, np.zeros(len(own), int), centers[c : c + 1]))
            if gain > 0:
                splits.append((-gain, c, children))
        splits = sorted(splits, key=lambda s: s[:2])[: k_max - len(centers)]
        if not splits:
            break
        parts = [c[None] for c in centers]
        for n, (_, c, children) in enumerate(splits):
            parts[c] = children
            if every_split or n == len(splits) - 1:
                now = whole(parts, iteration)
                trace.append(now)
        if now[1] <= len(centers):  # the split ones lost their samples again: no round can gain more
            break
    return *now[3:], trace


def _x_means_of(pdf: pd.DataFrame, k_min: int, k_max: int, seed: int, criterion: str, best: bool, rerun: bool, whitened: bool):
    """(centers in the samples' own space, labels, score) of one item's sorted samples, and the trace."""
    x = np.array(pdf["vector"].tolist(), float)
    deviation = x.std(axis=0)
    if not np.isfinite(deviation).all():
        raise ValueError("non-finite deviation")
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 1.0) if whitened else np.ones(x.shape[1])
    x = x * scale
    centers, labels, trace = x_means(x, k_min, k_max, seed, criterion, every_split=best)
    score = trace[-1][2]
    if best:
        top = max(trace, key=lambda t: t[2] if criterion == "bic" else -t[2])
        score, centers, labels = top[2:]
        if rerun:
            centers, labels, again = x_means(x, k_min, top[1], seed, criterion)
            score = again[-1][2]
    return centers / scale, labels, score, trace


def cluster_items(samples: DataFrame, k_min: int, k_max: int, seed: int = 0, criterion: str = "bic", best: bool = False, rerun: bool = False, whitened: bool = True) -> DataFrame:
    """(uid, sample, cluster, k, score) by x-means per item, on whitened samples.

    best: the clusters of the best score in the trace of every split, in place of the last ones; rerun: found again with
    that number as the most.  An item's samples are one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        centers, labels, score, _ = _x_means_of(pdf, k_min, k_max, seed, criterion, best, rerun, whitened)
        return pdf[["uid", "sample"]].assign(cluster=labels.astype("int32"), k=np.int32(len(centers)), score=score)

    return _vectors(samples).groupBy("uid").applyInPandas(run, "uid long, sample long, cluster int, k int, score double")


def x_means_centroids(samples: DataFrame, k_min: int, k_max: int, seed: int = 0, criterion: str = "bic", best: bool = False, rerun: bool = False, whitened: bool = True, normalize: bool = True) -> DataFrame:
    """(uid, cluster, vector): the centroids of cluster_items, whitening undone, of length 1 if normalize (0 stays 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        centers = _x_means_of(pdf, k_min, k_max, seed, criterion, best, rerun, whitened)[0]
        if normalize:
            length = np.linalg.norm(centers, axis=1, keepdims=True)
            centers = centers / np.where(length > 0, length, 1)
        return pd.DataFrame({"uid": pdf["uid"].iloc[0], "cluster": np.arange(len(centers), dtype="int32"), "vector": list(centers)})

    return _vectors(samples).groupBy("uid").applyInPandas(run, "uid long, cluster int, vector array<double>")


def x_means_trace(samples: DataFrame, k_min: int, k_max: int, seed: int = 0, criterion: str = "bic", every_split: bool = True, whitened: bool = True) -> DataFrame:
    """(uid, step, iteration, k, score): the start, then every split (or every round), in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        trace = _x_means_of(pdf, k_min, k_max, seed, criterion, every_split, False, whitened)[3]
        return pd.DataFrame([(pdf["uid"].iloc[0], i, *t[:3]) for i, t in enumerate(trace)], columns=["uid", "step", "iteration", "k", "score"])

    return _vectors(samples).groupBy("uid").applyInPandas(run, "uid long, step int, iteration int, k int, score double")


def _vectors(samples: DataFrame) -> DataFrame:
    return samples.select("uid", "sample", as_double("vector").alias("vector"))


def label_mode(labels: DataFrame, keys: tuple[str, ...] = ("uid", "cluster")) -> DataFrame:
    """(keys, label, n): the most frequent label from 0 up; of equal counts the one that reaches it first by sample."""
    w = Window.partitionBy(*keys, "label").orderBy("sample")
    counted = labels.where("label >= 0").withColumn("c", F.row_number().over(w))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "sample", "label")).alias("b"))
    return best.select(*keys, F.col("b.label").alias("label"), (-F.col("b.c")).cast("long").alias("n"))
