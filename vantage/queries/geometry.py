"""Cameras, meshes, grids and rays, over generated or derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as ge
from ..functions.lineage import stored
from ..operators import fields as fi
from ..operators import neighbours as ne
from ..operators import projection as pr
from ..operators import sampling as sa
from .base import registrar, table

ALL, query = registrar()


def _flat(m: str):
    return [(F.round(F.col(m)[i][j], 6) + 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(4)]


@query("""WITH g AS (SELECT (i * 5 + j)::BIGINT AS index, 2 * pi() / 8 * i AS a, -pi() / 2 + pi() / 6 * (j + 1) AS e FROM (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 5)) AS j))
SELECT index, round(cos(a), 6) + 0 AS m00, round(sin(a) * sin(e), 6) + 0 AS m01, round(sin(a) * cos(e), 6) + 0 AS m02, round(sin(a) * cos(e) * 2, 6) + 0 AS m03,
 0.0 AS m10, round(cos(e), 6) + 0 AS m11, round(-sin(e), 6) + 0 AS m12, round(-sin(e) * 2, 6) + 0 AS m13,
 round(-sin(a), 6) + 0 AS m20, round(cos(a) * sin(e), 6) + 0 AS m21, round(cos(a) * cos(e), 6) + 0 AS m22, round(cos(a) * cos(e) * 2, 6) + 0 AS m23 FROM g""")
def sphere_views(spark, sf_dir):
    """G1, V8, G16."""
    v = ge.sphere_views(spark, 8, 5)
    return v.select("index", *_flat("transform"))


@query("""WITH g AS (SELECT i, asin(2.0 * i / 63) AS lat, 2 * pi() * i * ((1 + sqrt(5)) / 2 - 1) AS lon FROM (SELECT unnest(range(-31, 32)) AS i))
SELECT i + 31 AS index, round(2 * cos(lat) * cos(lon), 6) + 0 AS x, round(2 * sin(lat), 6) + 0 AS y, round(2 * cos(lat) * sin(lon), 6) + 0 AS z, 1.0 AS det FROM g""")
def fermat_views(spark, sf_dir):
    """Positions, and that the matrices are rotations."""
    v = ge.fermat_views(spark, 31)
    m = F.col("transform")
    ok = F.when(ge.is_rigid("transform"), 1.0).otherwise(0.0)
    return v.select("index", (F.round(m[0][3], 6) + 0.0).alias("x"), (F.round(m[1][3], 6) + 0.0).alias("y"), (F.round(m[2][3], 6) + 0.0).alias("z"), ok.alias("det"))


@query("""WITH g AS (SELECT (i * 3 + j)::BIGINT AS index, 2 * pi() / 6 * i AS a, -pi() / 2 + pi() / 4 * (j + 1) AS e FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 3)) AS j))
SELECT index, round(sin(a) * cos(e) * 2, 6) + 0 AS x, round(-(cos(a) * cos(e) * 2), 6) + 0 AS y, round(-sin(e) * 2, 6) + 0 AS z, round(asin(least(greatest(-cos(e), -1), 1)) * 0 + 1, 6) AS rigid FROM g""")
def blender_transforms(spark, sf_dir):
    """Z-up transforms, checked to be rigid."""
    v = ge.sphere_views(spark, 6, 3).withColumn("m", ge.quarter_turn_x("transform"))
    m = F.col("m")
    return v.select("index", *((F.round(m[i][3], 6) + 0.0).alias(c) for i, c in enumerate("xyz")), F.when(ge.is_rigid("m"), 1.0).otherwise(0.0).alias("rigid"))


@query("SELECT n_nationkey, n_nationkey * 1.0 AS s0, 3.0 AS s1, 2.0 AS s2, 1.0 AS o0, -n_nationkey * 1.0 + 0 AS o1, 5.0 AS o2, true AS back FROM nation")
def swapped_axes(spark, sf_dir):
    """There and back again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.col("n_nationkey") * 1.0, F.lit(2.0), F.lit(3.0)).alias("s"), F.array(F.lit(1.0), F.lit(5.0), F.col("n_nationkey") * 1.0).alias("o"))
    n = n.withColumn("b", ge.swap_axes("s", "o")).withColumns({"bs": F.col("b.scale"), "bo": F.col("b.offset")}).withColumn("r", ge.swap_axes("bs", "bo", back=True))
    same = (F.col("r.scale") == F.col("s")) & (F.col("r.offset") == F.col("o"))
    return n.select("n_nationkey", *(F.col("bs")[i].alias(f"s{i}") for i in range(3)), *((F.col("bo")[i] + 0.0).alias(f"o{i}") for i in range(3)), same.alias("back"))


POINTS = "p AS (SELECT l_orderkey AS uid, l_linenumber AS sample, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, 0 AS r FROM lineitem)"


def _points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("sample"), F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100).alias("position"))


@query(f"WITH {POINTS}, b AS (SELECT uid, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p GROUP BY 1), s AS (SELECT *, CASE WHEN greatest(x1 - x0, y1 - y0, z1 - z0) > 0 THEN 1 / greatest(x1 - x0, y1 - y0, z1 - z0) ELSE 1 END AS s FROM b) SELECT uid, round(s, 12) AS scale, round(-(x0 + x1) / 2 * s, 12) + 0 AS ox, round(-(y0 + y1) / 2 * s, 12) + 0 AS oy, round(-(z0 + z1) / 2 * s, 12) + 0 AS oz FROM s")
def scene_normalization(spark, sf_dir):
    """V13."""
    n = ge.scene_normalization(_points(spark, sf_dir))
    return n.select("uid", F.round("scale", 12).alias("scale"), *((F.round(F.col("offset")[i], 12) + 0.0).alias(c) for i, c in enumerate(("ox", "oy", "oz"))))


@query(f"WITH {POINTS} SELECT uid, sample, round((2 * x + y + 1) * 0.5, 6) AS a, round((3 * y - 1) * 0.5, 6) AS b, round((x - z) * 0.5, 6) + 0 AS c FROM p")
def field_space(spark, sf_dir):
    """V14."""
    m = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in ((2, 1, 0, 1), (0, 3, 0, -1), (1, 0, -1, 0), (0, 0, 0, 1))))
    q = _points(spark, sf_dir).withColumn("q", ge.transform_point(m, "position", 0.5))
    return q.select("uid", "sample", *((F.round(F.col("q")[i], 6) + 0.0).alias(c) for i, c in enumerate("abc")))


@query(f"WITH {POINTS}, t AS (SELECT uid, sample, step, pow(1.1, step) AS f, x FROM p, (SELECT unnest(range(-2, 3)) AS step)) SELECT uid, sample, step::INTEGER AS step, round(x * f, 6) AS x FROM t")
def scale_ladder(spark, sf_dir):
    """G15."""
    return sa.ladder(_points(spark, sf_dir), 1.1, 2).select("uid", "sample", "step", F.round(F.col("position")[0], 6).alias("x"))


@query(f"WITH {POINTS} SELECT uid, sample, j::INTEGER AS j, round(x + (2 * (('0x' || substr(md5('j/0|' || uid || '/' || sample || '/' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) - 1) * 0.25, 6) AS x FROM p, (SELECT unnest(range(0, 4)) AS j)")
def jittered_points(spark, sf_dir):
    """G14."""
    return sa.jitter(_points(spark, sf_dir), 4, 0.25, "j").select("uid", "sample", "j", F.round(F.col("position")[0], 6).alias("x"))


MESH = "m AS (SELECT p_partkey // 4 AS uid, p_partkey % 4 AS face, p_size * 1.0 AS s FROM part)"


def _mesh(spark, sf_dir):
    s, zero = F.col("p_size") * 1.0, F.lit(0.0)
    p = table(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 4).alias("uid"), (F.col("p_partkey") % 4).alias("face"), F.array(zero, zero, zero).alias("v0"), F.array(s, zero, zero).alias("v1"), F.array(zero, s, s).alias("v2"))


@query(f"WITH {MESH} SELECT uid, round(sum(s * s * sqrt(2) / 2), 6) AS area, least(greatest(ceil(0.05 * sum(s * s * sqrt(2) / 2))::INTEGER, 25), 100) AS target FROM m GROUP BY uid")
def surface_targets(spark, sf_dir):
    """Areas and how many samples they get."""
    a = _mesh(spark, sf_dir).groupBy("uid").agg(F.sum(ge.triangle_area("v0", "v1", "v2")).alias("area"))
    return a.select("uid", F.round("area", 6).alias("area"), sa.target_count(F.col("area"), 0.05, 25, 100).alias("target"))


@query(f"""WITH {MESH}, c AS (SELECT uid, face, sum(s * s) OVER (PARTITION BY uid ORDER BY face) AS hi, sum(s * s) OVER (PARTITION BY uid) AS total FROM m),
d AS (SELECT DISTINCT uid, k AS sample, ('0x' || substr(md5('s/face|' || uid || '/' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM m, (SELECT unnest(range(0, 8)) AS k))
SELECT d.uid, d.sample::INTEGER AS sample, min(face) AS face, true AS inside FROM d JOIN c ON c.uid = d.uid AND c.hi > d.u * total GROUP BY ALL""")
def surface_samples(spark, sf_dir):
    """Area-weighted faces, points inside their triangle."""
    p = sa.surface_points(_mesh(spark, sf_dir), 8, "s").join(_mesh(spark, sf_dir), ["uid", "face"])
    x, y, z = (F.col("position")[i] for i in range(3))
    s = F.col("v1")[0]
    ok = (x >= -1e-9) & (y >= -1e-9) & (x + y <= s * (1 + 1e-9)) & (F.abs(y - z) < 1e-9)
    return p.select("uid", "sample", "face", ok.alias("inside"))


def _six_digits(x):
    return F.floor(x * 1_000_000 + 0.5) / 1_000_000


def _candidates(spark, sf_dir, count, seed):
    """Three times as many candidates as samples, placed to six digits."""
    p = sa.surface_points(_mesh(spark, sf_dir), 3 * count, seed)
    return p.select("uid", "sample", F.transform("position", _six_digits).alias("position"))


def _candidates_sql(count: int, seed: str) -> str:
    """The same points: a face by inverse area, a place in it by two folded uniforms."""
    u = lambda c: f"('0x' || substr(md5('{seed}/{c}|' || uid || '/' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    return f"""{MESH}, cu AS (SELECT uid, face, s, sum(s * s) OVER (PARTITION BY uid ORDER BY face) AS hi, sum(s * s) OVER (PARTITION BY uid) AS total FROM m),
dr AS (SELECT uid, k, {u("face")} AS u, {u("a")} AS a0, {u("b")} AS b0 FROM (SELECT DISTINCT uid FROM m), (SELECT unnest(range(0, {3 * count})) AS k)),
fa AS (SELECT dr.uid, k, a0, b0, min((face, s)) AS f FROM dr JOIN cu ON cu.uid = dr.uid AND cu.hi > dr.u * cu.total GROUP BY ALL),
ab AS (SELECT uid, k, f[2] AS s, CASE WHEN a0 + b0 > 1 THEN 1 - a0 ELSE a0 END AS a, CASE WHEN a0 + b0 > 1 THEN 1 - b0 ELSE b0 END AS b FROM fa),
p AS (SELECT uid, k AS sample, floor((0.0 + a * s + b * 0.0) * 1000000 + 0.5) / 1000000 AS x, floor((0.0 + a * 0.0 + b * s) * 1000000 + 0.5) / 1000000 AS y, floor((0.0 + a * 0.0 + b * s) * 1000000 + 0.5) / 1000000 AS z FROM ab)"""


_NEAR = "sqrt(0) + (0.0 + (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"


@query(f"""WITH RECURSIVE {_candidates_sql(30, "f")}, w AS (SELECT uid, least(greatest(ceil(0.05 * sum(s * s * sqrt(2) / 2))::INTEGER, 25), 60) AS target FROM m GROUP BY uid),
st AS (SELECT uid, target, (('0x' || substr(md5('f|' || uid), 1, 13))::BIGINT % 90) AS start FROM w),
r AS (SELECT st.uid, target, 1 AS i, start AS pick, list(sqrt({_NEAR}) ORDER BY p.sample) AS near FROM st JOIN p ON p.uid = st.uid JOIN p q ON q.uid = st.uid AND q.sample = st.start GROUP BY ALL
  UNION ALL SELECT r.uid, r.target, i + 1, list_position(r.near, list_max(r.near)) - 1,
    (SELECT list(CASE WHEN p.sample = list_position(r.near, list_max(r.near)) - 1 THEN -1 ELSE least(r.near[p.sample + 1], sqrt({_NEAR})) END ORDER BY p.sample) FROM p JOIN p q ON q.uid = p.uid AND q.sample = list_position(r.near, list_max(r.near)) - 1 WHERE p.uid = r.uid) FROM r WHERE i < target)
SELECT uid, pick::INTEGER AS sample FROM r""")
def farthest_samples(spark, sf_dir):
    """Farthest points from a seeded start, as many as the surface asks for, of three times the samples."""
    a = _mesh(spark, sf_dir).groupBy("uid").agg(F.sum(ge.triangle_area("v0", "v1", "v2")).alias("area"))
    t = a.select("uid", sa.target_count(F.col("area"), 0.05, 25, 60).alias("target"))
    return sa.thin_farthest(_candidates(spark, sf_dir, 30, "f").join(t, "uid"), "f").select("uid", "sample")


@query(f"""WITH {_candidates_sql(12, "d")}, e AS (SELECT p.uid, p.sample AS a, q.sample AS b FROM p JOIN p q ON q.uid = p.uid AND p.sample < q.sample WHERE {_NEAR} <= 4),
n AS (SELECT uid, k, count(*) AS n FROM (SELECT uid, a AS k FROM e UNION ALL SELECT uid, b FROM e) GROUP BY ALL),
g AS (SELECT DISTINCT e.uid, CASE WHEN nb.n > na.n THEN e.b ELSE e.a END AS sample FROM e JOIN n na ON na.uid = e.uid AND na.k = e.a JOIN n nb ON nb.uid = e.uid AND nb.k = e.b),
t AS (SELECT uid, sample, row_number() OVER (PARTITION BY uid ORDER BY sample) AS r FROM p ANTI JOIN g USING (uid, sample))
SELECT uid, sample::INTEGER AS sample FROM t WHERE r <= 12""")
def min_distance_samples(spark, sf_dir):
    """Three times the samples, thinned by the degree of each point in pairs that are too near, then cut."""
    return sa.thin_min_distance(_candidates(spark, sf_dir, 12, "d"), 12, 2.0).select("uid", "sample")


@query(f"""WITH RECURSIVE {_candidates_sql(12, "d")}, e AS (SELECT p.uid, p.sample AS a, list(q.sample) AS later FROM p JOIN p q ON q.uid = p.uid AND p.sample < q.sample WHERE {_NEAR} < 4 GROUP BY ALL),
r AS (SELECT uid, -1 AS i, []::BIGINT[] AS gone FROM (SELECT DISTINCT uid FROM p)
  UNION ALL SELECT r.uid, i + 1, CASE WHEN list_contains(gone, i + 1) OR e.later IS NULL THEN gone ELSE list_concat(gone, e.later) END FROM r LEFT JOIN e ON e.uid = r.uid AND e.a = i + 1 WHERE i < 35)
SELECT p.uid, p.sample::INTEGER AS sample FROM p JOIN r ON r.uid = p.uid AND r.i = 35 WHERE NOT list_contains(gone, p.sample)""")
def first_far_samples(spark, sf_dir):
    """The same candidates taken in order, each dropped if one that stays is nearer."""
    return sa.thin_surface(_mesh(spark, sf_dir), 3 * 12, "d", 2.0, "first", _six_digits).select("uid", "sample")


DENSITY_ROUNDS = 6


def _density_round(i: int) -> str:
    """Candidates thinned at each item's radius, counted, and the bracket halved."""
    return f"""e{i} AS (SELECT p.uid, p.sample AS a, q.sample AS b FROM p JOIN t{i} t ON t.uid = p.uid JOIN p q ON q.uid = p.uid AND p.sample < q.sample WHERE {_NEAR} <= (lo + hi) * 0.5 * ((lo + hi) * 0.5)),
n{i} AS (SELECT uid, k, count(*) AS n FROM (SELECT uid, a AS k FROM e{i} UNION ALL SELECT uid, b FROM e{i}) GROUP BY ALL),
g{i} AS (SELECT DISTINCT e.uid, CASE WHEN nb.n > na.n THEN e.b ELSE e.a END AS sample FROM e{i} e JOIN n{i} na ON na.uid = e.uid AND na.k = e.a JOIN n{i} nb ON nb.uid = e.uid AND nb.k = e.b),
k{i} AS (SELECT uid, sample FROM (SELECT p.uid, p.sample, row_number() OVER (PARTITION BY p.uid ORDER BY p.sample) AS r FROM p JOIN t{i} USING (uid) ANTI JOIN g{i} g ON g.uid = p.uid AND g.sample = p.sample) WHERE r <= 30),
s{i} AS (SELECT t.*, (SELECT count(*) FROM k{i} k WHERE k.uid = t.uid) AS samples FROM t{i} t),
t{i + 1} AS (SELECT uid, target, CASE WHEN samples > target THEN (lo + hi) * 0.5 ELSE lo END AS lo, CASE WHEN samples > target THEN hi ELSE (lo + hi) * 0.5 END AS hi FROM s{i} WHERE samples <> target)"""


@query(f"""WITH {_candidates_sql(30, "b")}, t0 AS (SELECT uid, least(greatest(ceil(0.02 * sum(s * s * sqrt(2) / 2))::INTEGER, 8), 30) AS target, 0.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM m GROUP BY uid),
{", ".join(_density_round(i) for i in range(DENSITY_ROUNDS))}
{" UNION ALL ".join(f"SELECT k.uid, k.sample::INTEGER AS sample, {i} AS iteration FROM k{i} k JOIN s{i} s USING (uid)" + (" WHERE samples = target" if i < DENSITY_ROUNDS - 1 else "") for i in range(DENSITY_ROUNDS))}""")
def density_samples(spark, sf_dir):
    """The radius halved in on for all items in lockstep, until each has as many samples as its surface asks for."""
    a = _mesh(spark, sf_dir).groupBy("uid").agg(F.sum(ge.triangle_area("v0", "v1", "v2")).alias("area"))
    t = a.select("uid", sa.target_count(F.col("area"), 0.02, 8, 30).alias("target"))
    kept, trace = sa.thin_to_target(_candidates(spark, sf_dir, 30, "b").join(t, "uid"), 0.0, 20.0, DENSITY_ROUNDS, 30)
    last = trace.groupBy("uid").agg(F.max("iteration").alias("iteration"))
    return kept.join(last, "uid").select("uid", "sample", "iteration")


@query("""WITH s AS (SELECT l_orderkey AS uid, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k, l_quantity * 0.37 AS x, l_discount * 100 + 0.5 AS y, l_tax * 10 AS z FROM lineitem),
d AS (SELECT uid, v, floor(x)::INTEGER AS px, floor(y)::INTEGER AS py, min(z) AS depth FROM s GROUP BY ALL)
SELECT s.uid, s.v, s.k::INTEGER AS k FROM s JOIN d ON d.uid = s.uid AND d.v = s.v AND d.px = floor(x) AND d.py = floor(y) WHERE z <= depth + 0.001""")
def visible_samples(spark, sf_dir):
    """Samples no farther than the depth map."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    s = li.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("view"), k.alias("sample"), (F.col("l_quantity") * 0.37).alias("x"), (F.col("l_discount") * 100 + 0.5).alias("y"), (F.col("l_tax") * 10).alias("z"))
    d = s.groupBy("uid", "view", F.floor("x").cast("int").alias("px"), F.floor("y").cast("int").alias("py")).agg(F.min("z").alias("depth"))
    return fi.visible_samples(s, d).select("uid", F.col("view").alias("v"), F.col("sample").alias("k"))


@query("""WITH w AS (SELECT l_orderkey AS ray, l_partkey AS p, l_discount AS w, l_quantity AS a, l_tax AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_quantity, l_tax) AS r FROM lineitem),
s AS (SELECT ray, sum(w * a) AS x, sum(w * b) AS y FROM w WHERE r <= 3 GROUP BY ray)
SELECT ray, round(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE x / sqrt(x * x + y * y) END, 6) AS x FROM s""")
def rendered_rays(spark, sf_dir):
    """The largest weights of a ray, their weighted sum, normalised."""
    li = table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("ray"), F.struct("l_partkey", "l_quantity", "l_tax").alias("sample"), F.col("l_discount").alias("weight"), F.array("l_quantity", "l_tax").alias("vector"))
    return fi.render(fi.top_weights(s, 3), normalize=True).select("ray", F.round(F.col("vector")[0], 6).alias("x"))


@query("SELECT p_partkey, round(CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) ELSE 0 END, 6) AS saliency FROM part JOIN (SELECT p_brand AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1) ON b = p_brand")
def saliency_of_items(spark, sf_dir):
    """V20."""
    return fi.saliency(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice").select("p_partkey", F.round("saliency", 6).alias("saliency"))


@query("""WITH p AS (SELECT s_suppkey AS point, (s_suppkey * 37 % 70) / 10.0 AS x, (s_suppkey * 53 % 70) / 10.0 AS y FROM supplier)
SELECT point, round(x + 10 * y, 6) AS a, round(floor(x) + 10 * floor(y), 6) AS near FROM p""")
def grid_lookups(spark, sf_dir):
    """Bilinear and nearest cell on a grid that is linear, so both have closed forms."""
    cells = spark.range(81).select(F.lit(0).alias("image"), (F.col("id") % 9).cast("int").alias("cx"), F.floor(F.col("id") / 9).cast("int").alias("cy"))
    cells = cells.withColumn("vector", F.array(F.col("cx") + 10.0 * F.col("cy")))
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("point"), F.lit(0).alias("image"), (k * 37 % 70 / 10.0).alias("x"), (k * 53 % 70 / 10.0).alias("y"))
    a = fi.bilinear(p, cells).select("point", F.round(F.col("vector")[0], 6).alias("a"))
    b = fi.nearest_cell(p, cells, 1.0).select("point", F.round(F.col("vector")[0], 6).alias("near"))
    return a.join(b, "point")


@query("WITH p AS (SELECT s_suppkey AS point, (s_suppkey * 17 % 100) / 100.0 AS scale FROM supplier) SELECT point, round(scale * 4 + point, 6) AS a FROM p")
def pyramid_levels(spark, sf_dir):
    """Linear between levels, on levels that are linear in the scale."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("point"), (k * 17 % 100 / 100.0).alias("scale"))
    levels = p.select("point", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level")).withColumn("vector", F.array(F.col("level") * 1.0 + F.col("point")))
    return fi.pyramid(p, levels, 0.0, 1.0, 5, normalize=False).select("point", F.round(F.col("vector")[0], 6).alias("a"))


@query("""WITH p AS (SELECT vec_id AS point, (vec_id * 17 % 101) / 100.0 AS scale, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
a AS (SELECT *, least(floor(scale * 4), 3)::INTEGER AS lv FROM p),
m AS (SELECT point, list_transform(range(1, 9), lambda i: v[lv * 8 + i] + (v[lv * 8 + 8 + i] - v[lv * 8 + i]) * (scale * 4 - lv)) AS m FROM a)
SELECT point, round(m[1] / sqrt(list_dot_product(m, m)), 6) + 0 AS x, round(m[8] / sqrt(list_dot_product(m, m)), 6) + 0 AS y FROM m""")
def pyramid_directions(spark, sf_dir):
    """Levels that bend, brought back to length 1 between them; both ends of the scale are met."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), "embedding")
    levels = e.select("point", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"), "embedding")
    levels = levels.select("point", "level", F.slice("embedding", F.col("level") * 8 + 1, F.lit(8)).alias("vector"))
    p = e.select("point", (F.col("point") * 17 % 101 / 100.0).alias("scale"))
    out = fi.pyramid(p, levels, 0.0, 1.0, 5)
    return out.select("point", *((F.round(F.col("vector")[i], 6) + 0.0).alias(name) for i, name in ((0, "x"), (7, "y"))))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE pow(embedding[1]::DOUBLE - 0.05, 2) + pow(embedding[2]::DOUBLE, 2) <= 0.01")
def points_in_circle(spark, sf_dir):
    """M16."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return fi.within_circle(e, 0.05, 0.0, 0.1).select("vec_id", F.round("x", 6).alias("x"))


@query("""WITH g AS (SELECT vec_id // 20 AS image, vec_id % 5 AS cx, vec_id % 20 // 5 AS cy, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT image, max(cx) AS r, max(cy) AS b FROM g GROUP BY image),
m AS (SELECT g.image, g.cx, g.cy, 0 AS level, g.v[1] AS a, g.v[64] AS z FROM g UNION ALL
  SELECT g.image, g.cx, g.cy, 1, avg(o.v[1]), avg(o.v[64]) FROM g JOIN g o ON o.image = g.image AND abs(o.cx - g.cx) <= 1 AND abs(o.cy - g.cy) <= 1 GROUP BY ALL),
p AS (SELECT level, dx, dy, row_number() OVER (ORDER BY level, dy, dx) - 1 AS bin FROM (
  SELECT l AS level, pow(3, l)::INT * i AS dx, pow(3, l)::INT * j AS dy FROM (SELECT unnest([0, 1]) AS l), (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) WHERE level = 0 OR dx <> 0 OR dy <> 0)
SELECT g.image, g.cx::INTEGER AS cx, g.cy::INTEGER AS cy, bin::INTEGER AS bin, round(m.a, 6) + 0 AS a, round(m.z, 6) + 0 AS z
FROM g JOIN d ON d.image = g.image, p JOIN m ON m.image = g.image AND m.level = p.level AND m.cx = least(greatest(g.cx + dx, 0), r) AND m.cy = least(greatest(g.cy + dy, 0), b)""")
def log_binned_grid(spark, sf_dir):
    """The bins of every cell, by place."""
    e = table(spark, sf_dir, "embeddings")
    g = e.select(F.floor(F.col("vec_id") / 20).alias("image"), (F.col("vec_id") % 5).cast("int").alias("cx"), F.floor(F.col("vec_id") % 20 / 5).cast("int").alias("cy"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return fi.log_bins(g).select("image", "cx", "cy", "bin", (F.round(F.col("vector")[0], 6) + 0.0).alias("a"), (F.round(F.col("vector")[63], 6) + 0.0).alias("z"))


#: Cameras around each item (4 azimuths, 3 elevations, distance 2), fields of 60 degrees, pictures of 24 x 16 pixels.
FOV, WIDTH, HEIGHT = 1.0471975511965976, 24, 16
PROJECTED = f"""s AS (SELECT l_orderkey % 40 AS uid, l_orderkey // 40 * 10 + l_linenumber AS sample, min(l_quantity) / 50 - 0.5 AS x, min(l_extendedprice) / 100000 - 0.5 AS y, min(l_discount) * 10 - 0.5 AS z FROM lineitem GROUP BY ALL),
g AS (SELECT (i * 3 + j)::BIGINT AS view, 2 * pi() / 4 * i AS a, -pi() / 2 + pi() / 4 * (j + 1) AS e FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 3)) AS j)),
c AS (SELECT uid, sample, view, cos(a) AS r00, sin(a) * sin(e) AS r01, sin(a) * cos(e) AS r02, cos(e) AS r11, -sin(e) AS r12, -sin(a) AS r20, cos(a) * sin(e) AS r21, cos(a) * cos(e) AS r22,
  x - 2 * sin(a) * cos(e) AS p, y + 2 * sin(e) AS q, z - 2 * cos(a) * cos(e) AS r FROM s, g),
o AS (SELECT uid, sample, view, r00 * p + r20 * r AS cx, r01 * p + r11 * q + r21 * r AS cy, -(r02 * p + r12 * q + r22 * r) AS z FROM c),
t AS (SELECT uid, sample, view, z, round(({1.7320508075688774 * HEIGHT / WIDTH} * cx / z + 1) * {WIDTH / 2}, 6) AS x, round(({1.7320508075688774} * cy / z + 1) * {HEIGHT / 2}, 6) AS y FROM o WHERE z >= 1.6 AND z <= 100),
d AS (SELECT uid, view, floor(x) AS px, floor(y) AS py, min(z) AS depth FROM t WHERE floor(x) >= 0 AND floor(x) < {WIDTH} AND floor(y) >= 0 AND floor(y) < {HEIGHT} GROUP BY ALL),
v AS (SELECT t.*, coalesce(t.z <= depth + 0.001, false)::INTEGER AS visible FROM t LEFT JOIN d ON d.uid = t.uid AND d.view = t.view AND d.px = floor(t.x) AND d.py = floor(t.y))"""


def _scene(spark, sf_dir):
    """(uid, sample, position): the lines of orders as points."""
    sample = F.floor(F.col("l_orderkey") / 40) * 10 + F.col("l_linenumber")
    at = (F.min("l_quantity") / 50 - 0.5, F.min("l_extendedprice") / 100000 - 0.5, F.min("l_discount") * 10 - 0.5)
    position = F.array(*(c.cast("double") for c in at)).alias("position")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("uid"), sample.alias("sample")).agg(position)


def _cameras(spark, sf_dir):
    views = ge.sphere_views(spark, 4, 3).select(F.col("index").alias("view"), "transform")
    uids = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("uid")).distinct()
    return uids.crossJoin(F.broadcast(views))  # a generator: 12 cameras an item


def _projected(spark, sf_dir, points=None):
    return pr.project(_scene(spark, sf_dir) if points is None else points, _cameras(spark, sf_dir), FOV, WIDTH, HEIGHT, near=1.6)


@query(f"WITH {PROJECTED} SELECT uid, sample, view, floor(x * 1000)::BIGINT AS x, floor(y * 1000)::BIGINT AS y, round(z, 6) AS z FROM t")
def projected_points(spark, sf_dir):
    """Pixels and depth of every sample in every view, what is nearer than the near plane clipped."""
    p = _projected(spark, sf_dir)
    return p.select("uid", "sample", "view", F.floor(F.col("x") * 1000).alias("x"), F.floor(F.col("y") * 1000).alias("y"), F.round("z", 6).alias("z"))


@query(f"WITH {PROJECTED} SELECT uid, view, px::INTEGER AS px, py::INTEGER AS py, round(depth, 6) AS depth FROM d")
def depth_buffers(spark, sf_dir):
    """The nearest sample of each pixel."""
    d = pr.depth_buffer(_projected(spark, sf_dir), WIDTH, HEIGHT)
    return d.select("uid", "view", "px", "py", F.round("depth", 6).alias("depth"))


@query(f"WITH {PROJECTED} SELECT uid, view, sum(visible)::BIGINT AS visible, (count(*) - sum(visible))::BIGINT AS obstructed FROM v GROUP BY uid, view")
def visible_and_obstructed(spark, sf_dir):
    """Samples in sight and behind others, by view."""
    return pr.view_counts(_scene(spark, sf_dir), _cameras(spark, sf_dir), FOV, WIDTH, HEIGHT, near=1.6)


@query(f"""WITH {PROJECTED}, m AS (SELECT v.*, (sample * 37 % 101) / 101.0 AS mx, (sample * 53 % 103) / 103.0 AS my FROM v WHERE visible = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY uid, view ORDER BY ('0x' || substr(md5('lines/' || uid || '/' || view || '|' || sample), 1, 13))::BIGINT, sample) AS n FROM m WHERE pow(mx - 0.5, 2) + pow(my - 0.5, 2) <= 0.16)
SELECT uid, view, sample, floor(x / {WIDTH} * 10000)::BIGINT AS u, floor((1 - y / {HEIGHT}) * 10000)::BIGINT AS v, floor(mx * 10000)::BIGINT AS mx, floor(my * 10000)::BIGINT AS my FROM k WHERE n <= 5""")
def picked_correspondences(spark, sf_dir):
    """The chain whole: cameras, projection, depth test, the visible samples within a circle of their 2-D map,
    and some of each picture drawn for its lines."""
    scene = stored(_scene(spark, sf_dir))
    p = _projected(spark, sf_dir, scene)
    tested = pr.with_visibility(p, pr.depth_buffer(p, WIDTH, HEIGHT))
    k = F.col("sample")
    points = scene.select("uid", "sample", (k * 37 % 101 / 101.0).alias("mx"), (k * 53 % 103 / 103.0).alias("my"))
    found = pr.correspondences(tested, points, 5, "lines", (0.5, 0.5, 0.4))
    return found.select("uid", "view", "sample", *(F.floor(F.col(c) * 10000).alias(c) for c in ("u", "v", "mx", "my")))
