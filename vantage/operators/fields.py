"""Feature grids and rays: visible samples, cell lookups, interpolation, weighted rendering, saliency, log-bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, l2_normalize
from .dataset import ranked


def visible_samples(samples: DataFrame, depth: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Samples (uid, view, sample, x, y, z in pixels and depth) that are no farther than the depth map (uid, view, px, py, depth)."""
    s = samples.withColumns({"px": F.floor("x").cast("int"), "py": F.floor("y").cast("int")})
    return s.join(depth, ["uid", "view", "px", "py"]).where(F.col("z") <= F.col("depth") + F.lit(eps)).drop("depth")


def nearest_cell(points: DataFrame, grid: DataFrame, scale: float) -> DataFrame:
    """points (image, x, y) with the vector of the cell floor(x * scale), floor(y * scale) of grid (image, cx, cy, vector)."""
    p = points.withColumns({"cx": F.floor(F.col("x") * scale).cast("int"), "cy": F.floor(F.col("y") * scale).cast("int")})
    return p.join(grid, ["image", "cx", "cy"])


def bilinear(points: DataFrame, grid: DataFrame, key: str = "point") -> DataFrame:
    """(key, vector): bilinear interpolation at (image, x, y) in cell units; one equi-join on the four corners."""
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corners = F.array(*(F.struct((F.floor("x") + a).cast("int").alias("cx"), (F.floor("y") + b).cast("int").alias("cy"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for a in (0, 1) for b in (0, 1)))
    c = points.select(key, "image", F.explode(corners).alias("c")).select(key, "image", "c.cx", "c.cy", "c.w")
    j = c.join(grid, ["image", "cx", "cy"]).select(key, F.posexplode(F.transform(as_double("vector"), lambda v: v * F.col("w"))).alias("pos", "v"))
    sums = j.groupBy(key, "pos").agg(F.sum("v").alias("v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vector"))


def pyramid(points: DataFrame, levels: DataFrame, lo: float, hi: float, bins: int, normalize: bool = True) -> DataFrame:
    """(point, scale, vector): linear between the two levels around each point's scale. levels: (point, level, vector)."""
    step = (hi - lo) / (bins - 1)
    at = F.least(F.greatest(F.floor((F.col("scale") - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(0)), F.lit(bins - 2))
    t = (F.col("scale") - F.lit(lo) - at * F.lit(step)) / F.lit(step)
    p = points.select("point", "scale", at.alias("level"), t.alias("t"))
    a = levels.select("point", "level", as_double("vector").alias("va"))
    b = levels.select("point", (F.col("level") - 1).alias("level"), as_double("vector").alias("vb"))
    j = p.join(a, ["point", "level"]).join(b, ["point", "level"])
    v = F.zip_with("va", "vb", lambda x, y: x + (y - x) * F.col("t"))
    return j.select("point", "scale", (l2_normalize(v) if normalize else v).alias("vector"))


def top_weights(samples: DataFrame, k: int) -> DataFrame:
    """The k largest weights of each ray (ray, sample, weight, ...)."""
    w = Window.partitionBy("ray").orderBy(F.desc("weight"), "sample")
    return samples.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def render(samples: DataFrame, normalize: bool = False) -> DataFrame:
    """(ray, vector): sum of weight times vector, optionally normalised."""
    parts = samples.select("ray", F.posexplode(F.transform(as_double("vector"), lambda v: v * F.col("weight"))).alias("pos", "v"))
    sums = parts.groupBy("ray", "pos").agg(F.sum("v").alias("v"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    out = sums.groupBy("ray").agg(v.alias("vector"))
    return out.withColumn("vector", l2_normalize("vector")) if normalize else out


def saliency(df: DataFrame, key: str, value: str) -> DataFrame:
    """value scaled to 0..1 within the group; 0 where all are equal."""
    g = df.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(g, key).withColumn("saliency", F.when(span > 0, (F.col(value) - F.col("__lo")) / span).otherwise(0.0)).drop("__lo", "__hi")


def percentile_bounds(df: DataFrame, value: str, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """(lo, hi): exact percentiles, linear between ranks, NaN and null ignored; null if nothing is left.

    Equal values are counted first, then the counts are summed over ranges: no task holds all values."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    counts = ranked(v.groupBy("v").agg(F.count(F.lit(1)).alias("n")), [], [F.col("v")], "n")
    places = {"lo": F.lit(lo) * (F.col("whole") - 1), "hi": F.lit(hi) * (F.col("whole") - 1)}
    first = F.col("running") - F.col("n")
    at = lambda i: F.max(F.when((first <= i) & (i < F.col("running")), F.col("v")))
    found = [x for k, p in places.items() for x in (at(F.floor(p)).alias(f"{k}0"), at(F.ceil(p)).alias(f"{k}1"), F.max(p - F.floor(p)).alias(f"{k}t"))]
    between = lambda k: F.when(F.col(f"{k}0") == F.col(f"{k}1"), F.col(f"{k}0")).otherwise(F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * F.col(f"{k}t"))
    return counts.agg(*found).select(*(between(k).alias(k) for k in places))


def within_circle(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    return points.where(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) <= radius * radius)


def _added(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, n): sums of the rows' vectors s and counts n; a group has no more rows than the stencil has places."""
    rows = F.array_sort(F.collect_list(F.struct("from", "s", "n")))
    g = df.groupBy(*keys).agg(rows.alias("r"))
    rest = F.slice("r", 2, F.size("r"))
    total = F.aggregate(rest, F.col("r")[0]["s"], lambda a, x: F.zip_with(a, x["s"], lambda p, q: p + q))
    return g.select(*keys, total.alias("s"), F.aggregate("r", F.lit(0), lambda a, x: a + x["n"]).alias("n"))


def box_means(grid: DataFrame, size: int) -> DataFrame:
    """(image, cx, cy, vector) of the grid's cells: the mean over the size x size box around each, of the cells that are
    there.  Cells lend their sums first along x, then along y, so each is copied 2 * size times and not size * size."""
    half = size // 2
    cells = grid.select("image", "cx", "cy", as_double("vector").alias("s"), F.lit(1).alias("n"))
    if half:
        for axis in ("cx", "cy"):
            lent = cells.withColumn("from", F.col(axis)).withColumn(axis, F.explode(F.sequence(F.col(axis) - half, F.col(axis) + half)))
            cells = _added(lent, ["image", "cx", "cy"])
        cells = cells.join(grid.select("image", "cx", "cy"), ["image", "cx", "cy"], "left_semi")
    return cells.select("image", "cx", "cy", F.transform("s", lambda x: x / F.col("n")).alias("vector"))


def log_bins(grid: DataFrame, hierarchy: int = 2) -> DataFrame:
    """(image, cx, cy, bin, vector): the log-binned neighbourhood of each cell of grid (image, cx, cy, vector).

    Level k has box means of 3^k cells at spacing 3^k: the first one all 3 x 3 places, each next one the 8 outer ones, so
    17 bins for two levels, numbered by level, then row, then column.  Places beside the image are moved onto its border.
    A place whose cell is missing gives no row."""
    size = grid.groupBy("image").agg(F.max("cx").alias("right"), F.max("cy").alias("bottom"))
    wanted, pooled, first = [], None, 0
    for level in range(hierarchy):
        d = 3**level
        means = box_means(grid, d).withColumn("level", F.lit(level))
        pooled = means if pooled is None else pooled.unionByName(means)
        places = [(x, y) for y in (-d, 0, d) for x in (-d, 0, d) if not level or x or y]
        wanted += [F.struct(F.lit(first + i).alias("bin"), F.lit(level).alias("level"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(places)]
        first += len(places)
    c = grid.select("image", "cx", "cy").join(size, "image").withColumn("w", F.explode(F.array(*wanted)))
    onto = lambda at, d, most: F.least(F.greatest(F.col(at) + F.col(d), F.lit(0)), F.col(most))
    c = c.select("image", "cx", "cy", "w.bin", "w.level", onto("cx", "w.dx", "right").alias("nx"), onto("cy", "w.dy", "bottom").alias("ny"))
    pooled = pooled.withColumnsRenamed({"cx": "nx", "cy": "ny"})
    return c.join(pooled, ["image", "level", "nx", "ny"]).select("image", "cx", "cy", "bin", "vector")


def log_binned(grid: DataFrame, hierarchy: int = 2) -> DataFrame:
    """(image, cx, cy, vector): the bins of log_bins one after another; a missing one counts as zeros."""
    bins = 1 + 8 * hierarchy
    found = log_bins(grid, hierarchy).groupBy("image", "cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("bin", "vector"))).alias("m"))
    zeros = F.transform(F.col("m")[4], lambda x: F.lit(0.0))  # bin 4 is the cell itself
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), zeros))
    return found.select("image", "cx", "cy", F.flatten(every).alias("vector"))
