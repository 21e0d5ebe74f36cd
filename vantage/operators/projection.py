"""Cameras onto pixels: projection of points, a depth buffer, what is visible, and the picks of 2-D maps.

Points are (uid, sample, position), cameras (uid, view, transform) with camera-to-world matrices that look along their
negative z axis, y up.  Results have a row a point and view, but for counts by view; the depth buffer is an aggregate by
(uid, view, pixel), so no task holds an image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from ..functions.scalars import rounded, uniform
from .joins import BROADCAST_BYTES, checked, weight

#: Pairs of a point and a view that one numpy step takes, and those that a task holds before it thins them out.
STEP_PAIRS, HELD_PAIRS = 1 << 15, 1 << 20
#: Pixels of all pictures up to which a task keeps the nearest depth of each in one array, 8 bytes a pixel.
DENSE_CELLS = 1 << 20


def project(points: DataFrame, cameras: DataFrame, fov_y: float, width: int, height: int, near: float = 0.05, far: float = 100.0) -> DataFrame:
    """(uid, sample, view, x, y, z, u, v): pixel coordinates from the lower left, depth along the view axis, and the
    picture coordinates in 0..1 from the upper left.

    Points nearer than `near` or farther than `far` are clipped; points beside the picture have pixels outside it.
    Pixels are rounded to six places, so that they do not depend on the order of additions."""
    m, p = [[F.col(f"m{i}{k}") for k in range(4)] for i in range(3)], [F.col(f"p{i}") for i in range(3)]
    cameras = checked(_flat(cameras))
    j = points.select("uid", "sample", *(F.col("position")[i].alias(f"p{i}") for i in range(3))).join(cameras, "uid")
    # the inverse of a rigid transform: its transposed rotation, applied to the point less the camera's place
    own = [sum((m[i][k] * (p[i] - m[i][3]) for i in range(1, 3)), m[0][k] * (p[0] - m[0][3])) for k in range(3)]
    j = j.select("uid", "sample", "view", *(c.alias(f"c{k}") for k, c in enumerate(own)))
    focal = 1 / math.tan(fov_y / 2)
    z = -F.col("c2")
    seen = j.where((z >= F.lit(near)) & (z <= F.lit(far)))
    x = (F.lit(focal * height / width) * F.col("c0") / z + 1) * F.lit(width / 2)
    y = (F.lit(focal) * F.col("c1") / z + 1) * F.lit(height / 2)
    # through a generator of one row: filters on pixels are then not rewritten into the whole arithmetic, many times over,
    # which makes generated methods too large to be compiled
    raw = F.array(F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    seen = seen.select("uid", "sample", "view", F.inline(raw)).withColumns({"x": rounded("x"), "y": rounded("y")})
    return seen.withColumns({"u": F.col("x") / width, "v": 1 - F.col("y") / height})


def _flat(cameras: DataFrame) -> DataFrame:
    return cameras.select("uid", "view", *(F.col("transform")[i][k].alias(f"m{i}{k}") for i in range(3) for k in range(4)))


def _pixels(projected: DataFrame) -> DataFrame:
    return projected.withColumns({"px": F.floor("x").cast("int"), "py": F.floor("y").cast("int")})


def depth_buffer(projected: DataFrame, width: int, height: int) -> DataFrame:
    """(uid, view, px, py, depth): the nearest point of each pixel of the picture."""
    inside = (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    return _pixels(projected).where(inside).groupBy("uid", "view", "px", "py").agg(F.min("z").alias("depth"))


def with_visibility(projected: DataFrame, depth: DataFrame, eps: float = 1e-3) -> DataFrame:
    """projected with visible: 1 where the point is no farther than the buffer at its pixel by more than eps; 0 behind
    it, and beside the picture.  A pixel that the buffer lacks hides nothing, but is outside the picture.

    The buffer has a row a pixel and is sent whole while it is small (checked), so that the samples are not shuffled."""
    out = _pixels(projected).join(checked(depth), ["uid", "view", "px", "py"], "left")
    seen = F.coalesce(F.col("z") <= F.col("depth") + F.lit(eps), F.lit(False))
    return out.withColumn("visible", seen.cast("int")).drop("depth", "px", "py")


def view_counts(points: DataFrame, cameras: DataFrame, fov_y: float, width: int, height: int, near: float = 0.05, far: float = 100.0, eps: float = 1e-3) -> DataFrame:
    """(uid, view, visible, obstructed): how many points with_visibility finds in sight, and how many not, of those that
    project leaves; views without any are absent.

    Points are projected once, in Arrow batches, and no row a point and view is written: of each pixel a task passes on
    only the points that its own nearest one does not hide (_unhidden); the others are counted.  The depth buffer is an
    aggregate of what is passed on, which holds each pixel's nearest point.  Cameras too many to be sent (checked) go the
    way of joins, with the same counts."""
    cameras = cut(_flat(cameras.where("uid IS NOT NULL")))
    if not 0 < weight(cameras) <= BROADCAST_BYTES:
        transform = F.array(*(F.array(*(F.col(f"m{i}{k}") for k in range(4))) for i in range(3)))
        p = project(stored(points), cameras.select("uid", "view", transform.alias("transform")), fov_y, width, height, near, far)
        tested = with_visibility(p, depth_buffer(p, width, height), eps)
        return tested.groupBy("uid", "view").agg(F.sum("visible").alias("visible"), F.sum(1 - F.col("visible")).alias("obstructed"))
    spark, kinds = points.sparkSession, {f.name: f.dataType.simpleString() for f in cameras.schema.fields}
    rows = cameras.collect()  # at most BROADCAST_BYTES
    uids = {u: i for i, u in enumerate(dict.fromkeys(r["uid"] for r in rows))}
    pictures = {k: i for i, k in enumerate(dict.fromkeys((r["uid"], r["view"]) for r in rows))}
    rows.sort(key=lambda r: uids[r["uid"]])
    matrices = np.array([[np.nan if x is None else x for x in r[2:]] for r in rows], float).reshape(len(rows), 12)
    picture_of = np.array([pictures[r["uid"], r["view"]] for r in rows], np.int64)
    own = np.bincount([uids[r["uid"]] for r in rows], minlength=len(uids)).astype(np.int64)
    of_uid, of_picture = zip(*uids.items(), strict=True), zip(*pictures, strict=True)
    codes = spark.createDataFrame(pa.table(dict(zip(("uid", "code"), map(list, of_uid), strict=True))))
    names = spark.createDataFrame(pa.table({"picture": list(range(len(pictures)))} | dict(zip(("uid", "view"), map(list, of_picture), strict=True))))
    codes, names = (t.withColumns({c: F.col(c).cast(kinds[c]) for c in kinds if c in t.columns}) for t in (codes, names))
    p = points.select("uid", *(F.col("position")[i].cast("double").alias(f"p{i}") for i in range(3)))
    p = p.dropna().join(F.broadcast(codes), "uid").select("code", "p0", "p1", "p2")
    left = stored(p.mapInArrow(_unhidden(matrices, picture_of, own, fov_y, width, height, near, far, eps), "picture long, cell long, z double, n long"))
    depth = left.where("cell IS NOT NULL").groupBy("picture", "cell").agg(F.min("z").alias("depth"))
    # a row without a cell counts points that are not in sight; so does a picture without a view
    seen = F.when(F.col("z") <= F.col("depth") + F.lit(eps), F.col("n")).otherwise(0)
    tested = left.join(checked(depth), ["picture", "cell"], "left").groupBy("picture").agg(F.sum(seen).alias("seen"), F.sum("n").alias("n"))
    tested = tested.join(F.broadcast(names), "picture")
    visible = F.when(F.col("view").isNull(), 0).otherwise(F.col("seen"))
    return tested.select("uid", "view", visible.alias("visible"), (F.col("n") - visible).alias("obstructed"))


def _unhidden(matrices: np.ndarray, picture_of: np.ndarray, own: np.ndarray, fov_y: float, width: int, height: int, near: float, far: float, eps: float):
    """Points (code, p0, p1, p2) to (picture, cell, z, n): at each cell (pixel) of a picture n points of depth z that no
    other point of the same stretch hides, and with a null cell how many others are between near and far.

    matrices: a row a camera, those of code 0 first; picture_of: their pictures; own: how many cameras each code has."""
    first, focal, area, pictures = np.cumsum(own) - own, 1 / math.tan(fov_y / 2), width * height, int(picture_of.max(initial=-1)) + 1
    matrices = np.ascontiguousarray(matrices.T)

    def pairs(code: np.ndarray, p: np.ndarray):
        """Pictures of all pairs of a point and a view between near and far; cell and depth of those inside the picture."""
        n = own[code]
        camera = np.repeat(first[code] - np.cumsum(n) + n, n)
        camera += np.arange(len(camera))
        m = lambda i, k: matrices[4 * i + k].take(camera)
        d = [np.repeat(p[i], n) - m(i, 3) for i in range(3)]  # the same operations, in the same order, as project has
        turned = lambda k: (m(0, k) * d[0] + m(1, k) * d[1]) + m(2, k) * d[2]
        z = -turned(2)
        seen = np.flatnonzero((z >= near) & (z <= far))
        z, camera, *d = (a.take(seen) for a in (z, camera, *d))
        x = _floors((focal * height / width * turned(0) / z + 1) * (width / 2))
        y = _floors((focal * turned(1) / z + 1) * (height / 2))
        picture = picture_of.take(camera)
        inside = np.flatnonzero((x >= 0) & (x < width) & (y >= 0) & (y < height))
        cell = picture.take(inside) * area + (y.take(inside) * width + x.take(inside)).astype(np.int64)
        return picture, cell, z.take(inside)

    def batch(held, totals: np.ndarray) -> pa.RecordBatch:
        cell, z, n = held
        rest = totals - np.bincount(cell // area, n, pictures).astype(np.int64)
        more = np.flatnonzero(rest)
        cells = pa.array(np.concatenate([cell, np.zeros(len(more), np.int64)]), mask=np.arange(len(cell) + len(more)) >= len(cell))
        columns = [np.concatenate([cell // area, more]), cells, np.concatenate([z, np.zeros(len(more))]), np.concatenate([n, rest[more]])]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["picture", "cell", "z", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        held, size, totals = [nothing], 0, np.zeros(pictures, np.int64)
        least = np.full(pictures * area, np.inf) if pictures * area <= DENSE_CELLS else None
        for b in batches:
            code, *p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ends = np.cumsum(own[code])
            lo = 0
            while lo < len(code):  # at least a point, else as many as make a step
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_PAIRS, "right")))
                with np.errstate(all="ignore"):
                    picture, cell, z = pairs(code[lo:hi], [x[lo:hi] for x in p])
                totals += np.bincount(picture, minlength=pictures)
                if least is not None:  # what is behind a point that was met before is not held at all
                    np.minimum.at(least, cell, z)
                    stay = np.flatnonzero(z <= least.take(cell) + eps)
                    cell, z = cell.take(stay), z.take(stay)
                held.append((cell, z, np.ones(len(cell), np.int64)))
                size, lo = size + len(cell), hi
                if size >= HELD_PAIRS:
                    held = [_nearest(*map(np.concatenate, zip(*held, strict=True)), eps)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield batch(held[0], totals)
                        held, size, totals = [nothing], 0, np.zeros(pictures, np.int64)
        if totals.any():
            yield batch(_nearest(*map(np.concatenate, zip(*held, strict=True)), eps), totals)

    return run


def _floors(x: np.ndarray) -> np.ndarray:
    """Floors of rounded(x): up by half a millionth; what is near a tie by its decimal digits, as rounded has it."""
    up = x + 5e-7
    out = np.floor(up)
    for i in np.flatnonzero((np.abs(up - np.rint(up)) < 1e-9) & (np.abs(x) < 1e6)):
        out[i] = np.floor(float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)))
    return out


def _nearest(cell: np.ndarray, z: np.ndarray, n: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell the points no farther than its nearest by more than eps; equal ones as one row of n."""
    codes, cells = pd.factorize(cell)
    least = np.full(len(cells), np.inf)
    np.minimum.at(least, codes, z)
    stay = z <= (least + eps)[codes]
    cell, z, n = cell[stay], z[stay], n[stay]
    order = np.lexsort((z, cell))
    cell, z, n = cell[order], z[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (z[1:] != z[:-1])])) if len(cell) else np.zeros(0, np.int64)
    return cell[new], z[new], np.add.reduceat(n, new) if len(new) else n


def correspondences(tested: DataFrame, datapoints: DataFrame, lines: int, seed: str, circle: tuple[float, float, float] | None = None) -> DataFrame:
    """(uid, view, sample, u, v, mx, my): of each picture up to `lines` visible points, drawn by a seeded hash, with their
    place in a 2-D map of the samples, datapoints (uid, sample, mx, my).  circle (x, y, radius) keeps those within it."""
    j = tested.where("visible = 1").join(datapoints, ["uid", "sample"])
    if circle:
        x, y, radius = circle
        j = j.where(F.pow(F.col("mx") - x, 2) + F.pow(F.col("my") - y, 2) <= radius * radius)
    tag = F.concat_ws("/", F.lit(seed), F.col("uid").cast("string"), F.col("view").cast("string"))
    order = Window.partitionBy("uid", "view").orderBy(uniform(tag, F.col("sample")), "sample")
    return j.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= lines).select("uid", "view", "sample", "u", "v", "mx", "my")
