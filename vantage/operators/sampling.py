"""Samplers: inverse distributions as range lookups, points on surfaces, greedy thinning, ladders of scaled points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import triangle_area
from ..functions.lineage import cut, stored
from ..functions.scalars import uniform, uniforms
from ..functions.vectors import subtract
from .dataset import ranked
from .joins import checked
from .neighbours import SMALL_GROUP, apart, by_size, squares, staying, staying_rows, without_close

#: An item of at most so many faces is a row, with all its points; one of more goes by joins on intervals.
SMALL_FACES = 64


def cumulative(df: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """df with lo and hi: the row's interval of the running weight, and total, the group's weight.

    Sums run over ranges of keys and order, so no task holds a group."""
    r = ranked(df, keys, [F.col(order)], weight)
    return r.select(*df.columns, (F.col("running") - F.coalesce(weight, F.lit(0))).alias("lo"), F.col("running").alias("hi"), F.col("whole").alias("total"))


def interval_lookup(draws: DataFrame, intervals: DataFrame, key: str, u: str = "u") -> DataFrame:
    """draws (key, u in [0, 1), ...) with the row of the interval that u * total falls in: lo <= x < hi.

    The range of u is cut in as many buckets as the key has intervals; an interval has a row in each bucket that it
    meets (two a key's interval on average) and a draw meets those of its bucket by an equi-join.  So neither side of a
    key is ever gathered, whatever their number.  A draw beyond the last interval by rounding takes the last one."""
    names = [c for c in intervals.columns if c not in (key, "lo", "hi", "total")]
    iv = intervals.where("hi > lo")
    sizes = checked(iv.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.max("hi").alias("__top"), F.max("total").alias("__total")))
    same = F.col(key).eqNullSafe(F.col("__key"))
    last = F.col("hi") == F.col("__top")
    at = lambda x, slack: F.floor(x / F.col("__total") * F.col("__n") * F.lit(1 + slack))
    buckets = F.sequence(F.least(at(F.col("lo"), -1e-12), F.col("__n") - 1), F.when(last, F.col("__n") - 1).otherwise(F.least(at(F.col("hi"), 1e-12), F.col("__n") - 1)))
    iv = iv.join(sizes, same).select("__key", F.explode(buckets).alias("__bucket"), "lo", "hi", last.alias("__last"), F.struct(*names).alias("__hit"))
    d = draws.join(sizes, same).withColumns({"__x": F.col(u) * F.col("__total"), "__bucket": F.least(F.floor(F.col(u) * F.col("__n")), F.col("__n") - 1)}).drop("__n", "__top", "__total")
    j = d.join(iv, ["__key", "__bucket"]).where((F.col("__x") >= F.col("lo")) & ((F.col("__x") < F.col("hi")) | F.col("__last")))
    return j.select(*draws.columns, *(F.col(f"__hit.{n}").alias(n) for n in names))


def discrete_draws(keys: DataFrame, histogram: DataFrame, seed: str, key: str = "uid") -> DataFrame:
    """(key, x): for each key a value x of histogram (x, y) with probability y, by inversion at a seeded uniform."""
    h = cumulative(histogram.withColumn("__g", F.lit(1)), ["__g"], "x", "y")
    d = keys.select(key, F.lit(1).alias("__g"), uniform(F.lit(seed), F.col(key)).alias("u"))
    return interval_lookup(d, h.select("__g", "lo", "hi", "total", "x"), "__g").select(key, "x")


def surface_points(triangles: DataFrame, count: int, seed: str) -> DataFrame:
    """(uid, sample, face, position): points on the triangles (uid, face, v0, v1, v2), area-weighted and uniform inside."""
    small, large = surface_groups(triangles, count, seed)
    points = small.select(F.explode_outer("__rows").alias("__row")).where("__row IS NOT NULL").select("__row.*")  # see staying_rows
    return points if large is None else points.unionByName(large)


def _surface_points_by_joins(triangles: DataFrame, count: int, seed: str) -> DataFrame:
    """surface_points for items of any number of faces."""
    areas = triangles.withColumn("area", triangle_area("v0", "v1", "v2"))
    faces = cumulative(areas, ["uid"], "face", "area").select("uid", "lo", "hi", "total", "face", "v0", "v1", "v2")
    uids = triangles.select("uid").distinct()
    draws = uids.select("uid", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample"))
    u = lambda name: uniform(F.lit(f"{seed}/{name}"), F.concat_ws("/", F.col("uid").cast("string"), F.col("sample").cast("string")))
    # the place in the face is made after the lookup, so that it is not shuffled
    p = interval_lookup(draws.withColumn("u", u("face")), faces, "uid").withColumns({"__a": u("a"), "__b": u("b")})
    fold = F.col("__a") + F.col("__b") > 1
    a, b = (F.when(fold, 1 - F.col(c)).otherwise(F.col(c)) for c in ("__a", "__b"))
    e1, e2 = subtract("v1", "v0"), subtract("v2", "v0")
    return p.select("uid", "sample", "face", F.array(*(F.col("v0")[i] + a * e1[i] + b * e2[i] for i in range(3))).alias("position"))


def surface_groups(triangles: DataFrame, count: int, seed: str, place: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The points of surface_points, (uid, sample, face, position), in the form of `by_size`: a row an item for items of up
    to SMALL_FACES faces, and the points of the others (None if there are none).  place is applied to each coordinate.

    Only the faces are shuffled: an item's points are drawn, looked up and placed within its row, and what follows in the
    row (staying_rows) needs no shuffle either.  An item whose faces are all empty has no points; a filter on that would be
    pushed in front and draw them a second time.  triangles are read twice.  Items with null ids, or with coordinates that
    are null, not finite or above 1e100, count among the others."""
    corners = ("v0", "v1", "v2")
    flat = F.concat(*(F.col(c).cast("array<double>") for c in corners))
    plain = ~F.exists(flat, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100)) & F.col("uid").isNotNull()
    for c in corners:
        plain &= F.size(c) == 3
    most = SMALL_FACES if count <= SMALL_GROUP else 0
    sizes = triangles.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(plain, F.lit(False))).alias("plain"))
    small, large = apart(triangles, sizes.where((F.col("n") > most) | ~F.col("plain")), ("uid",))

    @F.pandas_udf("struct<at: array<int>, flat: array<double>>")
    def placed(uids: pd.Series, faces: pd.Series) -> pd.DataFrame:
        at, flat = _placed(uids, faces, count, seed)
        return pd.DataFrame({"at": at, "flat": flat})

    # faces are few bytes and their points much work: as many tasks as the session asks for, not as many as the bytes do
    small = small.select("uid", F.struct("face", flat.alias("flat")).alias("__f")).repartition(int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid")
    items = small.groupBy("uid").agg(F.array_sort(F.collect_list("__f")).alias("__faces"))
    items = items.withColumn("__p", placed(F.col("uid").cast("string"), F.flatten(F.transform("__faces", lambda f: f["flat"]))))
    place = place or (lambda x: x)
    # each coordinate is placed where it is used: a column of all of them would be made again for every point
    position = lambda k: F.array(*(place(F.col("__p.flat")[3 * k + i]) for i in range(3)))
    row = lambda i, k: F.struct(F.col("uid"), k.alias("sample"), F.col("__faces")[i]["face"].alias("face"), position(k).alias("position"))
    small = items.select("uid", F.transform("__p.at", row).alias("__rows"), F.transform("__p.at", lambda i, k: k).alias("__samples"), F.transform("__p.flat", place).alias("__flat"))
    if large is not None:
        large = _surface_points_by_joins(large, count, seed).withColumn("position", F.transform("position", place))
    return small, large


def _placed(uids: pd.Series, faces: pd.Series, count: int, seed: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By item the place of each draw's face and its coordinates, of flat faces (9 numbers each); both empty where all
    faces are.  Items of equally many faces are taken together."""
    at, flat = [np.zeros(0, np.int32)] * len(faces), [np.zeros(0)] * len(faces)
    lengths = faces.map(len).to_numpy()
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        step = max(1, (1 << 18) // (n // 9 * count))
        for rows in np.split(same, range(step, len(same), step)):
            v = np.stack(faces.iloc[rows].to_list()).reshape(len(rows), -1, 3, 3)
            u, a, b = uniforms(f"{seed}/{c}|{i}/{k}" for c in ("face", "a", "b") for i in uids.iloc[rows] for k in range(count)).reshape(3, len(rows), count)
            v0, e1, e2 = v[:, :, 0], v[:, :, 1] - v[:, :, 0], v[:, :, 2] - v[:, :, 0]
            x, y, z = (e1[..., i] * e2[..., j] - e1[..., j] * e2[..., i] for i, j in ((1, 2), (2, 0), (0, 1)))
            hi = np.cumsum(np.sqrt(x * x + y * y + z * z) * 0.5, 1)
            total = hi[:, -1:]
            i = (hi[:, None, :] <= (u * total)[:, :, None]).sum(2)
            i = np.minimum(i, (hi < total).sum(1)[:, None])  # beyond the last interval by rounding: the last one
            fold = a + b > 1
            a, b = (np.where(fold, 1 - w, w)[..., None] for w in (a, b))
            v0, e1, e2 = (np.take_along_axis(w, i[..., None], 1) for w in (v0, e1, e2))
            p = (v0 + a * e1 + b * e2).reshape(len(rows), -1)
            for k, r in enumerate(rows):
                if total[k, 0] > 0:
                    at[r], flat[r] = i[k].astype(np.int32), p[k]
    return at, flat


def target_count(area, per_unit_area: float, least: int, most: int):
    """Number of points wanted on a surface: ceil(density * area) within limits."""
    return F.greatest(F.least(F.ceil(F.lit(float(per_unit_area)) * area).cast("int"), F.lit(most)), F.lit(least))


def farthest_points(points: np.ndarray, count: int, start: int) -> list[int]:
    """Indices chosen so that each next point is the farthest from those chosen; the first on ties."""
    chosen, nearest = [start], np.linalg.norm(points - points[start], axis=1)
    for _ in range(min(count, len(points)) - 1):
        i = int(np.argmax(nearest))
        chosen.append(i)
        nearest = np.minimum(nearest, np.linalg.norm(points - points[i], axis=1))
        nearest[i] = -1
    return chosen


_SCHEMA = "uid long, sample int, position array<double>"


def _thin(pick):
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        at = pick(np.array(pdf["position"].tolist(), float).reshape(len(pdf), -1), pdf)
        return pdf.iloc[at][["uid", "sample", "position"]]

    return apply


def first_samples(points: DataFrame, count: int) -> DataFrame:
    """Of each uid the first `count` points by sample."""
    return ranked(points, ["uid"], [F.col("sample")]).where(F.col("rank") <= count).drop("rank")


def thin_min_distance(points: DataFrame, count: int, radius: float | None, rule: str = "degree") -> DataFrame:
    """Per uid the first `count` points no nearer to each other than radius (`without_close` tells which go); all
    candidates, which are more than count, if radius is None."""
    points = points.select("uid", "sample", "position")
    return points if radius is None else first_samples(without_close(points, radius, rule=rule), count)


def thin_surface(triangles: DataFrame, count: int, seed: str, radius: float, rule: str = "degree", place: Callable[[Column], Column] | None = None) -> DataFrame:
    """The points (uid, sample, face, position) of surface_points that without_close leaves; small items are drawn and
    thinned within a row (surface_groups)."""
    small, large = surface_groups(triangles, count, seed, place)
    kept = staying_rows(small.withColumn("__r", F.lit(float(radius))), rule)
    return kept if large is None else kept.unionByName(without_close(large, radius, rule=rule))


def thin_to_target(points: DataFrame, lowest: float, highest: float, iterations: int, count: int | None = None, rule: str = "degree") -> tuple[DataFrame, DataFrame]:
    """(points that stay, trace): per uid (points have a column target) the radius is halved in on until so many are left.

    All items go through one loop in lockstep: a row an item holds its bracket, and each round thins the candidates of
    those that are not done, at their own radius, in one join.  trace: (uid, iteration, lo, mid, hi, samples).  At most
    `count` points of an item stay; what stays is what its last round left.  Small items (by_size) go through their
    rounds in one pass, from the matrix of their distances."""
    small, large = by_size(points.select("uid", "sample", "position", "target"), ("uid",))

    @F.pandas_udf("struct<trace: array<struct<iteration: int, lo: double, mid: double, hi: double, samples: long>>, kept: array<int>>")
    def rounds(samples: pd.Series, flat: pd.Series, targets: pd.Series) -> pd.DataFrame:
        found = [_halved(squares(s, x), t, float(lowest), float(highest), iterations, count, rule) for s, x, t in zip(samples, flat, targets, strict=True)]
        return pd.DataFrame({"trace": [f[0] for f in found], "kept": [f[1] for f in found]})

    done = small.withColumn("__d", rounds("__samples", "__flat", F.array_max(F.transform("__rows", lambda r: r["target"])).cast("double")))
    done = stored(done.select("uid", F.col("__d.trace").alias("trace"), F.transform("__d.kept", lambda i: F.col("__rows")[i]).alias("kept")))
    kept = done.select("uid", F.explode("kept").alias("k")).select("uid", *(F.col(f"k.{c}").alias(c) for c in ("sample", "position")))
    trace = done.select("uid", F.explode("trace").alias("t")).select("uid", "t.*")
    if large is None:
        return kept, trace
    more = _thin_by_joins(large, lowest, highest, iterations, count, rule)
    return kept.unionByName(more[0]), trace.unionByName(more[1])


def _halved(squared: np.ndarray, target: float, lo: float, hi: float, iterations: int, count: int | None, rule: str) -> tuple[list[dict], np.ndarray]:
    """The rounds of one small item, and the places of the points that its last round left."""
    trace, kept = [], np.zeros(0, np.int32)
    for i in range(iterations):
        mid = (lo + hi) * 0.5
        left = staying(squared, mid, rule)[:count]
        trace.append({"iteration": i, "lo": lo, "mid": mid, "hi": hi, "samples": len(left)})
        if len(left) == target or i == iterations - 1:
            return trace, left
        if np.isnan(target):  # no target: one round, and nothing is kept
            break
        lo, hi = (mid, hi) if len(left) > target else (lo, mid)
    return trace, kept


def _thin_by_joins(points: DataFrame, lowest: float, highest: float, iterations: int, count: int | None, rule: str) -> tuple[DataFrame, DataFrame]:
    items = cut(points.groupBy("uid").agg(F.max("target").alias("target")).withColumns({"lo": F.lit(float(lowest)), "hi": F.lit(float(highest))}))
    points, kept, trace = cut(points.select("uid", "sample", "position")), None, None
    for i in range(iterations):
        mid = (F.col("lo") + F.col("hi")) * 0.5
        now = points.join(items.select("uid", mid.alias("__mid")), "uid")
        left = without_close(now, F.col("__mid"), rule=rule).drop("__mid")
        left = cut(left if count is None else first_samples(left, count))
        sizes = left.groupBy("uid").agg(F.count(F.lit(1)).alias("samples"))
        step = cut(items.join(sizes, "uid", "left").select("uid", "target", F.lit(i).alias("iteration"), "lo", mid.alias("mid"), "hi", F.coalesce("samples", F.lit(0)).alias("samples")))
        trace = step.drop("target") if trace is None else trace.unionByName(step.drop("target"))
        open_ = step.where("samples <> target")
        done = left if i == iterations - 1 else left.join(step.where("samples = target").select("uid"), "uid", "left_semi")
        kept = done if kept is None else kept.unionByName(done)
        above = F.col("samples") > F.col("target")
        items = cut(open_.select("uid", "target", F.when(above, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(above, F.col("hi")).otherwise(F.col("mid")).alias("hi")))
        if items.isEmpty():
            break
    return kept, trace


def thin_farthest(points: DataFrame, seed: str) -> DataFrame:
    """Per uid (points have a column target) so many points by farthest-point sampling from a seeded start.

    Each choice depends on the one before it, thousands in a row for one item, so an item's candidates (as many as the
    sampler makes, a bounded number) are one task's work, and items run side by side."""

    def pick(p: np.ndarray, pdf: pd.DataFrame):
        import hashlib

        target = int(pdf["target"].iloc[0])
        if target >= len(p):
            return np.arange(len(p))
        start = int(hashlib.md5(f"{seed}|{pdf['uid'].iloc[0]}".encode()).hexdigest()[:13], 16) % len(p)  # noqa: S324
        return farthest_points(p, target, start)

    return points.groupBy("uid").applyInPandas(_thin(pick), _SCHEMA)


def jitter(points: DataFrame, n: int, radius: float, seed: str) -> DataFrame:
    """n seeded offsets in a cube around each point (uid, sample, position): (uid, sample, j, position)."""
    p = points.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in ("uid", "sample", "j")))
    shift = [(2 * uniform(F.lit(f"{seed}/{i}"), key) - 1) * radius for i in range(3)]
    return p.select("uid", "sample", "j", F.array(*(F.col("position")[i] + shift[i] for i in range(3))).alias("position"))


def ladder(points: DataFrame, factor: float, steps: int) -> DataFrame:
    """Points scaled by factor to the powers -steps to steps: (uid, sample, step, position)."""
    p = points.withColumn("step", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    return p.select("uid", "sample", "step", F.transform("position", lambda x: x * F.pow(F.lit(factor), F.col("step"))).alias("position"))


def random_scale(points: DataFrame, lo: float, hi: float, seed: str, key: str = "uid") -> DataFrame:
    return points.withColumn("scale", F.lit(lo) + F.lit(hi - lo) * uniform(F.lit(seed), F.col(key)))


