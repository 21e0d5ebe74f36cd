"""Points near each other, at any group size: joins over grid cells, thinning, and density clusters.

A point is matched by equi-join with the points of its own cell and the 26 around it, cells being as wide as the
distance asked for; no task gathers a group, but where small groups are thinned.  Points are (keys..., sample,
position), three coordinates each (further ones count in the distance only).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from .joins import checked

#: A group of at most so many points is thinned from the matrix of its distances, without a row a pair; a larger one by
#: joins over grid cells.
SMALL_GROUP = 256

_AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def near_pairs(points: DataFrame, radius: Column | float, keys: tuple[str, ...], point: str = "point") -> DataFrame:
    """(keys..., a, b, squared) of points (keys..., point, position): ordered pairs a < b of a group no farther apart than
    radius, which may be a column of the points that is one for each group.  A radius of 0 pairs equal places."""
    r = (radius if isinstance(radius, Column) else F.lit(float(radius))).cast("double")
    p = points.select(*keys, F.col(point).alias("__id"), "position", r.alias("__r"))
    width = F.when(F.col("__r") > 0, F.col("__r") * F.lit(1 + 1e-9)).otherwise(1.0)
    p = p.withColumns({f"__c{i}": F.floor(F.col("position")[i] / width) for i in range(3)})
    right = p.select(*keys, F.col("__id").alias("b"), F.col("position").alias("__q"), *(f"__c{i}" for i in range(3)))
    left = p.select(*keys, F.col("__id").alias("a"), "position", "__r", *(f"__c{i}" for i in range(3)), F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate(o))) for o in _AROUND))).alias("__o"))
    left = left.select(*keys, "a", "position", "__r", *((F.col(f"__c{i}") + F.col(f"__o.d{i}")).alias(f"__c{i}") for i in range(3)))
    j = left.join(right, [*keys, "__c0", "__c1", "__c2"]).where("a < b").withColumn("squared", _squared("position", "__q"))
    return j.where(F.col("squared") <= F.col("__r") * F.col("__r")).select(*keys, "a", "b", "squared")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of nodes (node) and edges (a, b): the smallest node that links reach.

    Rounds of two joins: each node takes the smallest label around it, then its label's label, so the number of rounds
    grows with the logarithm of the longest chain, about; a node with many links is one row of a partial aggregate."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        around = both.join(labels.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        nearer = labels.join(around, "node", "left").select("node", "label", F.least("label", F.coalesce("seen", "label")).alias("next"))
        # the label is a node too: take over what it has found, and let it know of the smallest that points at it
        told = nearer.groupBy(F.col("label").alias("node")).agg(F.min("next").alias("told"))
        nearer = nearer.join(told, "node", "left").select("node", "label", F.least("next", F.coalesce("told", "next")).alias("next"))
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        new = cut(nearer.join(jump, "next").select("node", "label", F.least("next", "jump").alias("next")))
        if new.where("next < label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", F.col("next").alias("label"))


def density_clusters(points: DataFrame, eps: float = 0.05, min_samples: int = 5, keys: tuple[str, ...] = ("uid", "cluster")) -> DataFrame:
    """(keys..., sample, label): density clusters of each group.

    A point with at least min_samples points within eps, itself included, is a core; cores within eps of each other are
    one cluster, numbered from 0 by their first core's sample; other points join the cluster of smallest number with a
    core within eps, or are -1.  Equal places are one weighted point, so copies make no pairs."""
    coordinates = points.select(*keys, "sample", F.transform("position", lambda x: x.cast("double")).alias("position"))
    places = coordinates.groupBy(*keys, "position").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("first"))
    places = cut(places.withColumn("point", F.monotonically_increasing_id()))
    pairs = cut(near_pairs(places, eps, keys).select("a", "b"))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = places.select(F.col("point").alias("b"), "n")
    around = ways.join(weight, "b").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("around"))
    core = cut(places.join(around, "point", "left").where(F.col("n") + F.coalesce("around", F.lit(0)) >= min_samples).select("point"))
    of = lambda c: core.withColumnRenamed("point", c)
    parts = connected(of("node"), pairs.join(of("a"), "a", "left_semi").join(of("b"), "b", "left_semi"))
    parts = cut(places.join(parts.withColumnRenamed("node", "point"), "point").select(*keys, "point", "first", "component"))
    starts = parts.groupBy(*keys, "component").agg(F.min("first").alias("start"))
    numbered = _numbered(starts, keys)
    cores = cut(parts.join(numbered, [*keys, "component"]).select("point", "label"))
    edge = ways.join(cores.withColumnRenamed("point", "b"), "b").groupBy(F.col("a").alias("point")).agg(F.min("label").alias("reached"))
    labelled = places.join(cores, "point", "left").join(edge, "point", "left").select(*keys, "position", F.coalesce("label", "reached", F.lit(-1)).cast("int").alias("label"))
    return coordinates.join(labelled, [*keys, "position"]).select(*keys, "sample", "label")


def _numbered(starts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys..., component, label): clusters numbered from 0 within their group by their start."""
    from .dataset import ranked

    return ranked(starts, list(keys), [F.col("start")]).select(*keys, "component", (F.col("rank") - 1).alias("label"))


def without_close(points: DataFrame, radius: Column | float, keys: tuple[str, ...] = ("uid",), rule: str = "degree") -> DataFrame:
    """The points (keys..., sample, position, ...) that stay when no two of a group may be within radius of each other.

    rule `degree`: of each pair the point goes that is in more pairs, the earlier one if they are in equally many; one
    pass, but a point may go though its rival goes as well.  rule `first`: points are taken in order of sample, and one
    goes if one that stays is nearer; found in rounds, all points at once: a point stays when none before it near it is
    undecided or stays.  A radius of 0 or less lets all stay.  Samples of a group differ.

    Groups of up to SMALL_GROUP points are a row each and write no pairs; both ways give the same points."""
    if rule not in ("degree", "first"):
        raise ValueError(f"unknown rule {rule!r}")
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    small, large = by_size(points.withColumn("__r", r.cast("double")), keys)
    kept = staying_rows(small.withColumn("__r", F.col("__rows")[0]["__r"]), rule).select(*(f"`{c}`" for c in points.columns))
    return kept if large is None else kept.unionByName(_without_close_by_joins(large, keys, rule))


def staying_rows(small: DataFrame, rule: str) -> DataFrame:
    """The points that stay of groups that are a row each (by_size), with the group's radius as __r."""

    @F.pandas_udf("array<int>")
    def stays(samples: pd.Series, flat: pd.Series, radii: pd.Series) -> pd.Series:
        return pd.Series([staying(squares(s, x), r, rule) for s, x, r in zip(samples, flat, radii, strict=True)])

    # explode would add a filter on empty arrays in front of the Python functions, which then run twice
    kept = small.withColumn("__i", stays("__samples", "__flat", "__r")).select("__rows", F.explode_outer("__i").alias("__i"))
    return kept.where("__i IS NOT NULL").select(F.col("__rows")[F.col("__i")].alias("__row")).select("__row.*")


def by_size(points: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """The groups of up to SMALL_GROUP points, a row each, and the points of the others (None if there are none).

    A small group is __rows, its points by sample; __samples, their numbers; __flat, all their coordinates.  Groups with
    a null key or coordinate, or with positions of several lengths, count among the others."""
    points = stored(points)
    size = F.when(F.exists("position", lambda x: x.isNull()), 0).otherwise(F.size("position"))
    size = F.coalesce(F.when(F.col("position").isNull(), 0).otherwise(size), F.lit(0))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    odd = sizes.where((F.col("n") > SMALL_GROUP) | (F.col("least") < 3) | (F.col("least") != F.col("most")) | null)
    small, large = apart(points, odd, keys)
    small = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", *(c for c in points.columns if c != "sample")))).alias("__rows"))
    flat = F.flatten(F.transform("__rows", lambda r: r["position"].cast("array<double>")))
    return small.withColumns({"__samples": F.transform("__rows", lambda r: r["sample"]), "__flat": flat}), large


def apart(rows: DataFrame, odd: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that are not in odd, and those of groups that are (None if odd is empty)."""
    odd = checked(odd.select(*(F.col(k).alias(f"__{k}") for k in keys)))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (rows, None) if odd.isEmpty() else (rows.join(odd, same, "left_anti"), rows.join(odd, same, "left_semi"))


def squares(samples: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Squared distances of a small group's points, added in order of the coordinates."""
    x = np.asarray(flat, float).reshape(len(samples), len(flat) // max(1, len(samples)))
    out = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        d = x[:, None, k] - x[None, :, k]
        out += d * d
    return out


def staying(squared: np.ndarray, radius: float | None, rule: str) -> np.ndarray:
    """Places of the points, in order of sample, that stay by the rule (without_close)."""
    n = len(squared)
    gone = np.zeros(n, bool)
    if radius is not None and radius > 0:
        if rule == "degree":
            near = squared <= radius * radius
            np.fill_diagonal(near, False)
            degree = near.sum(1)
            near = np.triu(near)  # pairs of an earlier and a later point
            later = degree[None, :] > degree[:, None]
            gone = (near & ~later).any(1) | (near & later).any(0)
        else:
            near = squared < radius * radius
            for i in range(n):
                if not gone[i]:
                    gone[i + 1 :] |= near[i, i + 1 :]
    return np.flatnonzero(~gone).astype(np.int32)


def _without_close_by_joins(points: DataFrame, keys: tuple[str, ...], rule: str) -> DataFrame:
    """without_close for groups of any size; points have their radius as __r."""
    every = cut(points)
    pairs = cut(near_pairs(every.where("__r > 0"), F.col("__r"), keys, "sample"))
    if rule == "degree":
        ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("sample")).groupBy(*keys, "sample").agg(F.count(F.lit(1)).alias("n"))
        count = lambda c: ends.withColumnsRenamed({"sample": c, "n": f"n{c}"})
        gone = pairs.join(count("a"), [*keys, "a"]).join(count("b"), [*keys, "b"])
        gone = gone.select(*keys, F.when(F.col("nb") > F.col("na"), F.col("b")).otherwise(F.col("a")).alias("sample")).distinct()
    else:
        strict = pairs.join(every.select(*keys, F.col("sample").alias("a"), "__r"), [*keys, "a"]).where("squared < __r * __r").select(*keys, "a", "b")
        left, gone = cut(strict), None
        while not left.isEmpty():
            waiting = left.select(*keys, F.col("b").alias("a")).distinct()
            stays = left.select(*keys, "a").distinct().join(waiting, [*keys, "a"], "left_anti")
            out = cut(left.join(stays, [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("sample")).distinct())
            gone = out if gone is None else cut(gone.unionByName(out))
            left = left.join(stays, [*keys, "a"], "left_anti")
            for end in ("a", "b"):
                left = left.join(out.withColumnRenamed("sample", end), [*keys, end], "left_anti")
            left = cut(left)
        gone = strict.select(*keys, F.col("a").alias("sample")).limit(0) if gone is None else gone
    return every.drop("__r").join(gone, [*keys, "sample"], "left_anti")
