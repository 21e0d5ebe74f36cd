"""Camera and mesh geometry in closed form: rotations, look-at matrices, areas, axis changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import cross, norm, subtract


def triangle_area(v0: str, v1: str, v2: str) -> Column:
    return norm(cross(subtract(v1, v0), subtract(v2, v0))) * 0.5


def matmul4(a: str | Column, b: str | Column) -> Column:
    """Product of 4x4 matrices given as arrays of rows."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.array(*(F.array(*(sum((a[i][k] * b[k][j] for k in range(1, 4)), a[i][0] * b[0][j]) for j in range(4))) for i in range(4)))


def transform_point(matrix: str | Column, p: str | Column, factor: float = 1.0) -> Column:
    """Homogeneous product with a point, then a scale."""
    m, p = (F.col(x) if isinstance(x, str) else x for x in (matrix, p))
    return F.array(*((m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3]) * F.lit(factor) for i in range(3)))


def sphere_views(spark: SparkSession, azimuths: int, elevations: int, offsets: int = 1, near: float = 2.0, far: float = 2.0, exclude_poles: bool = True) -> DataFrame:
    """(index, azimuth, elevation, distance, transform): cameras on a grid around the origin."""
    a = spark.range(azimuths).select(F.col("id").alias("i"))
    e = spark.range(elevations).select(F.col("id").alias("j"))
    o = spark.range(offsets).select(F.col("id").alias("k"))
    grid = a.crossJoin(e).crossJoin(o)  # a generator: the product is the output
    az = F.lit(2 * math.pi / azimuths) * F.col("i")
    el = (F.lit(-math.pi / 2) + F.lit(math.pi / (elevations + 1)) * (F.col("j") + 1)) if exclude_poles else (F.lit(-math.pi / 2) + F.lit(math.pi / elevations) * F.col("j"))
    d = F.lit(near) + F.lit((far - near) / offsets) * F.col("k")
    grid = grid.select(((F.col("i") * elevations + F.col("j")) * offsets + F.col("k")).alias("index"), az.alias("azimuth"), el.alias("elevation"), d.alias("distance"))
    sa, ca, se, ce = F.sin("azimuth"), F.cos("azimuth"), F.sin("elevation"), F.cos("elevation")
    zero, one, d = F.lit(0.0), F.lit(1.0), F.col("distance")
    rows = [(ca, sa * se, sa * ce), (zero, ce, -se), (-sa, ca * se, ca * ce)]
    matrix = F.array(*(F.array(x, y, z, z * d) for x, y, z in rows), F.array(zero, zero, zero, one))
    return grid.withColumn("transform", matrix)


def fermat_views(spark: SparkSession, n: int, offsets: int = 1, near: float = 2.0, far: float = 2.0) -> DataFrame:
    """(index, i, distance, transform): 2n + 1 cameras a golden angle apart on the sphere, looking at the origin."""
    golden = (1 + math.sqrt(5)) / 2 - 1
    base = spark.range(offsets).select(F.col("id").alias("k")).crossJoin(spark.range(-n, n + 1).select(F.col("id").alias("i")))
    lat = F.asin(2.0 * F.col("i") / F.lit(2.0 * n + 1.0))
    lon = F.lit(2 * math.pi) * F.col("i") * F.lit(golden)
    base = base.select((F.col("k") * (2 * n + 1) + F.col("i") + n).alias("index"), "i", (F.lit(near) + F.lit((far - near) / offsets) * F.col("k")).alias("distance"), lat.alias("lat"), lon.alias("lon"))
    base = base.withColumn("toward", F.array(F.cos("lat") * F.cos("lon"), F.sin("lat"), F.cos("lat") * F.sin("lon")))
    return base.withColumn("transform", look_at("toward", "distance")).select("index", "i", "distance", "transform")


def look_at(toward: str, distance: str) -> Column:
    """Camera at distance along the unit vector t = toward, looking back at the origin, y up.

    With r = |(t0, t2)| the axes are right = (t2, 0, -t0) / r, up = (-t0 t1 / r, r, -t1 t2 / r) and back = t."""
    t, d = F.col(toward), F.col(distance)
    r = F.sqrt(t[0] * t[0] + t[2] * t[2])
    zero = F.lit(0.0)
    rows = [(t[2] / r, -t[0] * t[1] / r, t[0]), (zero, r, t[1]), (-t[0] / r, -t[1] * t[2] / r, t[2])]
    return F.array(*(F.array(a, b, c, c * d) for a, b, c in rows), F.array(zero, zero, zero, F.lit(1.0)))


def quarter_turn_x(matrix: str) -> Column:
    """Rotation by 90 degrees about x before the transform: y-up to z-up."""
    m = F.col(matrix)
    return F.array(m[0], F.transform(m[2], lambda x: -x), m[1], m[3])


def euler_xyz(matrix: str) -> Column:
    """Extrinsic x, y, z angles of the rotation."""
    m = F.col(matrix)
    return F.array(F.atan2(m[2][1], m[2][2]), F.asin(F.least(F.greatest(-m[2][0], F.lit(-1.0)), F.lit(1.0))), F.atan2(m[1][0], m[0][0]))


def is_rigid(matrix: str, tolerance: float = 1e-6) -> Column:
    """Last row 0 0 0 1, determinant 1, orthogonal columns."""
    m = F.col(matrix)
    det = sum(s * m[0][a] * m[1][b] * m[2][c] for s, a, b, c in ((1, 0, 1, 2), (1, 1, 2, 0), (1, 2, 0, 1), (-1, 0, 2, 1), (-1, 1, 0, 2), (-1, 2, 1, 0)))
    off = sum((m[0][i] * m[0][j] + m[1][i] * m[1][j] + m[2][i] * m[2][j] - (1.0 if i == j else 0.0) for i in range(3) for j in range(3)), F.lit(0.0))
    last = F.abs(m[3][0]) + F.abs(m[3][1]) + F.abs(m[3][2]) + F.abs(m[3][3] - 1.0)
    return (last <= tolerance) & (F.abs(det - 1.0) <= tolerance) & (off <= tolerance)


def swap_axes(scale_column: str, offset_column: str, back: bool = False) -> Column:
    """Normalization between y-up and z-up axes."""
    s, o = F.col(scale_column), F.col(offset_column)
    offset = F.array(o[0], o[2], -o[1]) if back else F.array(o[0], -o[2], o[1])
    return F.struct(F.array(s[0], s[2], s[1]).alias("scale"), offset.alias("offset"))


def scene_normalization(points: DataFrame, key: str = "uid", point: str = "position") -> DataFrame:
    """(key, scale, offset): 1 / largest extent, and the shift that centres the scaled scene."""
    p = F.col(point)
    box = points.groupBy(key).agg(*(f(p[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))))
    extent = F.greatest(*(F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(3)))
    s = F.when(extent > 0, 1.0 / extent).otherwise(F.lit(1.0))
    return box.select(key, s.alias("scale"), F.array(*(-(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 * s for i in range(3))).alias("offset"))
