"""Clustering, transforms and view selection over embeddings as samples of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators import clustering as cl
from ..operators import neighbours as ne
from ..operators import selection as se
from ..operators import transform as tr
from ..operators import xmeans as xm
from .base import registrar, table

ALL, query = registrar()


def _samples(spark, sf_dir):
    """(uid, sample, vector): an item a label, its embeddings as samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("uid"), F.col("vec_id").alias("sample"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


SAMPLES = "s AS (SELECT label::BIGINT AS uid, vec_id AS sample, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
WHITE = f"""{SAMPLES},
dv AS (SELECT uid, pos, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE 1 / stddev_pop(x) END AS f FROM (SELECT uid, unnest(v) AS x, unnest(range(0, 64)) AS pos FROM s) GROUP BY ALL),
sc AS (SELECT uid, list(f ORDER BY pos) AS f FROM dv GROUP BY uid),
x0 AS (SELECT uid, sample, list_transform(range(1, 65), lambda i: v[i] * f[i]) AS v FROM s JOIN sc USING (uid))"""
CENTERS0 = "c0 AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY sample) - 1 AS cluster, v FROM x0 QUALIFY cluster < 3)"


def _assign(i: int) -> str:
    return f"""a{i} AS (SELECT uid, sample, cluster, d FROM (SELECT x.uid, x.sample, c.cluster, round(list_distance(x.v, c.v), 9) AS d,
  row_number() OVER (PARTITION BY x.uid, x.sample ORDER BY round(list_distance(x.v, c.v), 9), c.cluster) AS n FROM x0 x JOIN c{i} c ON c.uid = x.uid) WHERE n = 1)"""


def _round(i: int) -> str:
    return f"""{_assign(i)},
m{i} AS (SELECT uid, cluster, pos, avg(z) AS z FROM (SELECT uid, cluster, unnest(v) AS z, unnest(range(0, 64)) AS pos FROM x0 JOIN a{i} USING (uid, sample)) GROUP BY ALL),
c{i + 1} AS (SELECT uid, cluster, list(z ORDER BY pos) AS v FROM m{i} GROUP BY ALL)"""


ROUNDS = 4
LLOYD = f"WITH {WHITE}, {CENTERS0}, " + ", ".join(_round(i) for i in range(ROUNDS)) + f", {_assign(ROUNDS)}"
LABELS = f"a{ROUNDS}"


def _k_means(spark, sf_dir):
    return cl.k_means(_samples(spark, sf_dir), 3, ROUNDS)


@query(f"WITH {WHITE} SELECT uid, sample, round(list_sum(v), 6) AS total FROM x0")
def whitened_samples(spark, sf_dir):
    """V5, V6."""
    s = _samples(spark, sf_dir)
    w = cl.whiten(s, cl.whitening(s))
    return w.select("uid", "sample", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(LLOYD + f" SELECT uid, sample, cluster::INTEGER AS cluster, round(d, 6) AS distance FROM {LABELS}")
def k_means_labels(spark, sf_dir):
    """Fixed start and rounds; labels from the whitened centroids."""
    return _k_means(spark, sf_dir)[1].select("uid", "sample", F.col("cluster").cast("int").alias("cluster"), F.round("distance", 6).alias("distance"))


@query(LLOYD + f", u AS (SELECT uid, cluster, list_transform(range(1, 65), lambda i: c.v[i] / f[i]) AS v FROM c{ROUNDS} c JOIN sc USING (uid)) SELECT uid, cluster::INTEGER AS cluster, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x FROM u")
def k_means_centroids(spark, sf_dir):
    """M1, V6, V2, Q8: centroids brought back and normalised."""
    return _k_means(spark, sf_dir)[0].select("uid", F.col("cluster").cast("int").alias("cluster"), F.round(F.col("vector")[0], 6).alias("x"))


@query(LLOYD + f" SELECT uid, round(avg(d), 6) AS distortion FROM {LABELS} GROUP BY uid")
def k_means_distortion(spark, sf_dir):
    """M2: mean distance, not squared."""
    return cl.distortion(_k_means(spark, sf_dir)[1]).select("uid", F.round("distortion", 6).alias("distortion"))


@query(LLOYD + f", n AS (SELECT uid, cluster, count(*) AS n FROM {LABELS} GROUP BY ALL), t AS (SELECT uid, cluster, row_number() OVER (PARTITION BY uid ORDER BY n DESC, cluster) - 1 AS r FROM n QUALIFY r < 2), c AS (SELECT c.uid, t.r AS cluster, c.v FROM c{ROUNDS} c JOIN t ON t.uid = c.uid AND t.cluster = c.cluster), z AS (SELECT x.uid, x.sample, c.cluster, row_number() OVER (PARTITION BY x.uid, x.sample ORDER BY round(list_distance(x.v, c.v), 9), c.cluster) AS n FROM x0 x JOIN c ON c.uid = x.uid) SELECT uid, sample, cluster::INTEGER AS cluster FROM z WHERE n = 1")
def largest_clusters(spark, sf_dir):
    """The two largest clusters, then all samples assigned again."""
    s = _samples(spark, sf_dir)
    w = cl.whiten(s, cl.whitening(s))
    centers = cl.lloyd(w, cl.first_centroids(w, 3), ROUNDS)
    top = cl.largest_clusters(cl.nearest(w, centers), centers, 2)
    return cl.nearest(w, top).select("uid", "sample", F.col("cluster").cast("int").alias("cluster"))


@query(LLOYD + f", d AS (SELECT x.uid, x.sample, c.cluster, list_distance(x.v, c.v) AS d FROM x0 x JOIN c{ROUNDS} c ON c.uid = x.uid) SELECT uid, sample, cluster::INTEGER AS cluster, round(d / sum(d) OVER (PARTITION BY uid, sample), 6) AS weight FROM d")
def soft_assignment(spark, sf_dir):
    """Distance over the sum of distances."""
    s = _samples(spark, sf_dir)
    w = cl.whiten(s, cl.whitening(s))
    a = cl.soft_assignment(w, cl.lloyd(w, cl.first_centroids(w, 3), ROUNDS))
    return a.select("uid", "sample", F.col("cluster").cast("int").alias("cluster"), F.round("weight", 6).alias("weight"))


CURVE = "WITH pm AS (SELECT p_brand AS uid, p_size AS k, min(p_partkey) AS m FROM part GROUP BY ALL), cv AS (SELECT uid, k, 100.0 / (k + m / 1e6) AS d FROM pm)"


def _curve(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("uid"), F.col("p_size").alias("k")).agg(F.min("p_partkey").alias("m"))
    return p.select("uid", "k", (F.lit(100.0) / (F.col("k") + F.col("m") / 1e6)).alias("d"))


@query(CURVE + """, g AS (SELECT uid, max_by(d, k) + (min_by(d, k) - max_by(d, k)) * 0.3 AS target FROM cv GROUP BY uid),
s AS (SELECT cv.uid, k, d, lead(k) OVER w AS k1, lead(d) OVER w AS d1, target FROM cv JOIN g USING (uid) WINDOW w AS (PARTITION BY cv.uid ORDER BY k)),
x AS (SELECT uid, min(k) AS k0 FROM s WHERE target >= d1 AND target <= d GROUP BY uid)
SELECT s.uid, round(target, 6) AS target, round(k1 + (k - k1) * (target - d1) / (d - d1), 6) AS frac_k FROM s JOIN x ON x.uid = s.uid AND x.k0 = s.k""")
def fractional_elbow(spark, sf_dir):
    """M3, M4, Q5: first crossing of the target by linear interpolation."""
    c = _curve(spark, sf_dir)
    return cl.predict_k(c, cl.fractional_target(c, 0.3)).select("uid", F.round("target", 6).alias("target"), F.round("frac_k", 6).alias("frac_k"))


@query(CURVE + """, n AS (SELECT uid, k, d, (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w)::DOUBLE AS x, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS y FROM cv WINDOW w AS (PARTITION BY uid)),
r AS (SELECT uid, d, row_number() OVER (PARTITION BY uid ORDER BY round(sqrt(x * x + y * y), 9), k) AS n FROM n)
SELECT uid, round(d, 6) AS target FROM r WHERE n = 1""")
def closest_elbow(spark, sf_dir):
    """M5."""
    return cl.closest_target(_curve(spark, sf_dir)).select("uid", F.round("target", 6).alias("target"))


@query(CURVE + """, e AS (SELECT uid, min(k) AS lo, max(k) AS hi FROM cv GROUP BY uid), g AS (SELECT uid, unnest(range(lo, hi + 1)) AS k FROM e),
f AS (SELECT g.uid, g.k, max(a.k) AS ka, min(b.k) AS kb FROM g LEFT JOIN cv a ON a.uid = g.uid AND a.k <= g.k LEFT JOIN cv b ON b.uid = g.uid AND b.k >= g.k GROUP BY ALL)
SELECT f.uid, f.k::INTEGER AS k, round(a.d + (b.d - a.d) * (f.k - ka) / greatest(kb - ka, 1), 6) AS score FROM f JOIN cv a ON a.uid = f.uid AND a.k = ka JOIN cv b ON b.uid = f.uid AND b.k = kb""")
def filled_scores(spark, sf_dir):
    """Gaps of k filled linearly."""
    c = _curve(spark, sf_dir).withColumnRenamed("d", "score")
    return cl.fill_scores(c).select("uid", "k", F.round("score", 6).alias("score"))


@query()
def x_means_clusters(spark, sf_dir):
    """M6, M7: rows only."""
    return cl.cluster_items(_samples(spark, sf_dir), 2, 6).select("uid", "sample", "cluster", "k")


@query()
def x_means_trace(spark, sf_dir):
    """M8: rows only."""
    return cl.x_means_trace(_samples(spark, sf_dir), 2, 6, criterion="mndl").select("uid", "step", "iteration", "k")


@query()
def x_means_centroids(spark, sf_dir):
    """M6, V6: of the best score, found again; rows only."""
    return cl.x_means_centroids(_samples(spark, sf_dir), 2, 6, best=True, rerun=True)


# --- x-means in lockstep: the twin spells two rounds of splits out, for samples of three components ---------------

SPLIT_ROUNDS, SPLIT_LLOYD, SPLIT_MOST = 2, 2, 5


def _near_sql(out: str, members: str, centers: str, keys: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT {keys}, sample, v, cluster, d FROM (SELECT {keys}, sample, m.v, cluster, round(list_distance(m.v, c.v), 9) AS d,
  row_number() OVER (PARTITION BY {keys}, sample ORDER BY round(list_distance(m.v, c.v), 9), cluster) AS n FROM {members} m JOIN {centers} c USING ({keys})) WHERE n = 1)"""


def _lloyd_sql(out: str, members: str, start: str, keys: str) -> str:
    parts, at = [], start
    for i in range(SPLIT_LLOYD):
        to = out if i == SPLIT_LLOYD - 1 else f"{out}_{i}"
        parts.append(_near_sql(f"{out}_n{i}", members, at, keys))
        parts.append(f"{to} AS MATERIALIZED (SELECT {keys}, cluster, [avg(v[1]), avg(v[2]), avg(v[3])] AS v FROM {out}_n{i} GROUP BY ALL)")
        at = to
    return ", ".join(parts)


def _score_sql(out: str, assigned: str, keys: str, criterion: str) -> str:
    var = "greatest(d2 / (n - k)" + (" / 3, 1e-300)" if criterion == "bic" else ", 1e-300)")
    rule = {
        "bic": f"l - n * ln(n) - n * 0.5 * ln(2 * pi()) - n * 1.5 * ln({var}) - (n - k) * 1.5 - k * 2 * ln(n)",
        "mndl": f"d1 / n + 1.8 * sqrt({var}) / sqrt(n) * sqrt(1 + n / greatest(n - k, 1)) + sqrt({var}) * sqrt(2 * k) / n + 1.8 * {var} * sqrt(k) / n",
    }[criterion]
    return f"""{out} AS MATERIALIZED (SELECT {keys}, k, CASE WHEN n > k THEN {rule} END AS score FROM (SELECT {keys}, count(*) AS k, sum(n)::DOUBLE AS n, sum(d1) AS d1, sum(d2) AS d2, sum(n * ln(n)) AS l
  FROM (SELECT {keys}, cluster, count(*) AS n, sum(d) AS d1, sum(d * d) AS d2 FROM {assigned} GROUP BY ALL) GROUP BY {keys}))"""


def _split_sql(i: int, criterion: str) -> str:
    sign = "" if criterion == "bic" else "-"
    pair = "uid, parent"
    both = lambda sgn: ", ".join(f"m[{p}] {sgn} CASE WHEN wide = {p} THEN s[{p}] ELSE 0 END" for p in (1, 2, 3))
    return ", ".join([
        f"mem{i} AS MATERIALIZED (SELECT uid, cluster AS parent, sample, v FROM n{i})",
        f"""st{i} AS (SELECT *, list_position(w, list_max(w)) AS wide FROM (SELECT *, list_transform(s, lambda x: round(x, 9)) AS w FROM (SELECT uid, parent, [avg(v[1]), avg(v[2]), avg(v[3])] AS m,
  [stddev_pop(v[1]), stddev_pop(v[2]), stddev_pop(v[3])] AS s FROM mem{i} GROUP BY ALL)) WHERE list_max(w) > 0)""",
        f"ch{i} AS MATERIALIZED (SELECT uid, parent, 0 AS cluster, [{both('-')}] AS v FROM st{i} UNION ALL SELECT uid, parent, 1, [{both('+')}] FROM st{i})",
        _lloyd_sql(f"kid{i}", f"mem{i}", f"ch{i}", pair),
        _near_sql(f"kn{i}", f"mem{i}", f"kid{i}", pair),
        _score_sql(f"after{i}", f"kn{i}", pair, criterion),
        _score_sql(f"before{i}", f"(SELECT uid, cluster AS parent, cluster, d FROM n{i})", pair, criterion),
        f"""gain{i} AS (SELECT uid, parent, gain FROM (SELECT uid, parent, round({sign}(a.score - b.score), 9) AS gain FROM after{i} a JOIN before{i} b USING (uid, parent) WHERE a.k = 2) WHERE gain > 0),
take{i} AS MATERIALIZED (SELECT uid, parent FROM (SELECT g.*, row_number() OVER (PARTITION BY uid ORDER BY gain DESC, parent) AS r FROM gain{i} g) JOIN t{i} USING (uid) WHERE r <= {SPLIT_MOST} - k)""",
        f"""s{i + 1} AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY p, child) - 1 AS cluster, v FROM (SELECT uid, parent AS p, cluster AS child, v FROM kid{i} SEMI JOIN take{i} USING (uid, parent)
  UNION ALL SELECT uid, c.cluster, 0, v FROM c{i} c WHERE uid IN (SELECT uid FROM take{i}) AND NOT EXISTS (SELECT 1 FROM take{i} t WHERE t.uid = c.uid AND t.parent = c.cluster)))""",
    ])


def _x_means_sql(criterion: str) -> str:
    head = """WITH e3 AS (SELECT label::BIGINT AS uid, vec_id AS sample, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS v FROM embeddings),
f3 AS (SELECT uid, list_transform([stddev_pop(v[1]), stddev_pop(v[2]), stddev_pop(v[3])], lambda x: CASE WHEN x = 0 THEN 1 ELSE 1 / x END) AS f FROM e3 GROUP BY uid),
x3 AS MATERIALIZED (SELECT uid, sample, [v[1] * f[1], v[2] * f[2], v[3] * f[3]] AS v FROM e3 JOIN f3 USING (uid)),
s0 AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY sample) - 1 AS cluster, v FROM x3 QUALIFY cluster < 2)"""
    parts = [head]
    for i in range(SPLIT_ROUNDS + 1):
        parts += [_lloyd_sql(f"c{i}", "x3", f"s{i}", "uid"), _near_sql(f"n{i}", "x3", f"c{i}", "uid"), _score_sql(f"t{i}", f"n{i}", "uid", criterion)]
        if i < SPLIT_ROUNDS:
            parts.append(_split_sql(i, criterion))
    every = " UNION ALL ".join(f"SELECT uid, {i} AS iteration, k, score FROM t{i}" for i in range(SPLIT_ROUNDS + 1))
    return ", ".join(parts) + f", trace AS MATERIALIZED ({every})"


def _lockstep(spark, sf_dir, criterion: str, best: bool = False):
    s = _samples(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 3))
    return xm.x_means_lockstep(s, 2, SPLIT_MOST, SPLIT_ROUNDS, SPLIT_LLOYD, criterion, best)


@query(_x_means_sql("bic") + " SELECT uid, iteration::INTEGER AS iteration, k::INTEGER AS k, round(score, 6) AS score FROM trace")
def x_means_rounds(spark, sf_dir):
    """M6, M7, M8: the criterion (BIC) of every item after each round of splits."""
    t = _lockstep(spark, sf_dir, "bic").trace
    return t.select("uid", "iteration", "k", F.round("score", 6).alias("score"))


@query(_x_means_sql("mndl") + f""", top AS (SELECT uid, iteration FROM trace QUALIFY row_number() OVER (PARTITION BY uid ORDER BY round(-score, 9) DESC, iteration) = 1),
labels AS ({' UNION ALL '.join(f'SELECT {i} AS iteration, uid, sample, cluster, d FROM n{i}' for i in range(SPLIT_ROUNDS + 1))})
SELECT uid, sample, cluster::INTEGER AS cluster, round(d, 6) AS distance FROM labels JOIN top USING (uid, iteration)""")
def x_means_best_round(spark, sf_dir):
    """M6, M7, M8: the clusters of the round of the best score (MNDL)."""
    labels = _lockstep(spark, sf_dir, "mndl", best=True).labels
    return labels.select("uid", "sample", F.col("cluster").cast("int").alias("cluster"), F.round("distance", 6).alias("distance"))


@query("WITH s AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT unnest(v) AS x, unnest(range(0, 64)) AS pos FROM s) SELECT round(sum(var), 6) AS total, 64 AS components, true AS sorted FROM (SELECT var_pop(x) AS var FROM p GROUP BY pos)")
def principal_components(spark, sf_dir):
    """The variances of all projections add up to that of the data, in descending order."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    m = tr.pca(s)
    p = tr.apply_pca(s, m).select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("v"))
    ok = F.array_sort(F.collect_list("d"))[0] >= -1e-9
    from pyspark.sql import Window

    d = p.withColumn("d", F.lag("v", 1).over(Window.orderBy("pos")) - F.col("v"))  # one row a component
    return d.agg(F.round(F.sum("v"), 6).alias("total"), F.count(F.lit(1)).cast("int").alias("components"), ok.alias("sorted"))


@query("SELECT true AS enough, true AS fewest")
def variance_components(spark, sf_dir):
    """The fewest components that explain the share."""
    m = tr.pca(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector")), variance=0.8)
    r = m["explained"]
    return spark.createDataFrame([(sum(r) >= 0.8 - 1e-12, sum(r[:-1]) < 0.8)], "enough boolean, fewest boolean")


@query("SELECT vec_id, 64 AS dim FROM embeddings")
def identity_transform(spark, sf_dir):
    """M10."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return tr.identity(e, 64).select("vec_id", F.size("vector").alias("dim"))


VIEWS = LLOYD + f""", c AS (SELECT uid, cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c{ROUNDS}),
w AS (SELECT label::BIGINT AS uid, vec_id AS view, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""


def _views(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("uid"), F.col("vec_id").alias("view"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _unit_centers(spark, sf_dir):
    s = _samples(spark, sf_dir)
    w = cl.whiten(s, cl.whitening(s))
    return cl.lloyd(w, cl.first_centroids(w, 3), ROUNDS).withColumn("vector", l2_normalize("vector"))


@query(VIEWS + ", p AS (SELECT c.uid, c.cluster, w.view, round(list_dot_product(w.v, c.v), 9) AS s FROM c JOIN w ON w.uid = c.uid) SELECT uid, cluster::INTEGER AS cluster, view, round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY uid, cluster ORDER BY s DESC, view) = 1")
def most_similar_views(spark, sf_dir):
    """J6, J8, J16."""
    v = se.views_nearest_to_centroids(_views(spark, sf_dir), _unit_centers(spark, sf_dir))
    return v.withColumn("cluster", F.col("cluster").cast("int"))


@query(VIEWS + ", p AS (SELECT c.uid, c.cluster, w.view, round(list_distance(w.v, c.v), 9) AS s FROM c JOIN w ON w.uid = c.uid) SELECT uid, cluster::INTEGER AS cluster, view, round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY uid, cluster ORDER BY s, view) = 1")
def nearest_views(spark, sf_dir):
    """By distance, nearest."""
    v = se.views_nearest_to_centroids(_views(spark, sf_dir), _unit_centers(spark, sf_dir), "euclidean")
    return v.withColumn("cluster", F.col("cluster").cast("int"))


@query(VIEWS + f""", p AS (SELECT c.uid, c.cluster, w.view, round(list_dot_product(w.v, c.v), 9) AS s, w.v FROM c JOIN w ON w.uid = c.uid),
top AS (SELECT uid, cluster, view, v FROM p QUALIFY row_number() OVER (PARTITION BY uid, cluster ORDER BY s DESC, view) = 1),
r AS (SELECT t.uid, t.cluster, t.view, x.view AS sample, a.cluster = t.cluster AS own, round(list_dot_product(x.v, t.v), 9) AS s FROM top t JOIN w x ON x.uid = t.uid JOIN {LABELS} a ON a.uid = x.uid AND a.sample = x.view)
SELECT uid, cluster::INTEGER AS cluster, view, sample, own, round(s, 6) AS similarity, round((s - min(s) OVER i) / (max(s) OVER i - min(s) OVER i), 6) AS shade FROM r WINDOW i AS (PARTITION BY uid)""")
def selected_view_shades(spark, sf_dir):
    """Clusters, the view nearest to each, all samples against these on one scale, and which are of the cluster."""
    s = _samples(spark, sf_dir)
    work = cl.whiten(s, cl.whitening(s))
    centers = cl.packed(cl.lloyd(work, cl.first_centroids(work, 3), ROUNDS))
    views = _views(spark, sf_dir)
    unit = centers.select("uid", F.inline("__c")).withColumn("vector", l2_normalize("vector"))
    chosen = se.views_nearest_to_centroids(views, unit).select("uid", "cluster", "view").join(views, ["uid", "view"])
    labels = cl.nearest(work, centers).select("uid", "sample", "cluster").join(s, ["uid", "sample"])
    out = se.selected_view_shades(labels, chosen)
    return out.select("uid", F.col("cluster").cast("int").alias("cluster"), "view", "sample", "own", F.round("similarity", 6).alias("similarity"), F.round("shade", 6).alias("shade"))


POSITIONS = "q AS (SELECT label::BIGINT AS uid, (vec_id % 2)::INTEGER AS cluster, vec_id AS sample, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4] > 0 AS chosen FROM embeddings)"


def _positions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("uid"), (F.col("vec_id") % 2).cast("int").alias("cluster"), F.col("vec_id").alias("sample"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("position"), (F.col("embedding")[3] > 0).alias("chosen"))


@query(f"""WITH {POSITIONS}, o AS (SELECT uid, cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM q WHERE chosen GROUP BY ALL),
r AS (SELECT o.uid, o.cluster, avg(q.x) AS rx, avg(q.y) AS ry, avg(q.z) AS rz FROM o JOIN q ON q.uid = o.uid AND NOT (q.cluster = o.cluster AND q.chosen) GROUP BY ALL)
SELECT o.uid, o.cluster, round(x, 6) AS ox, round(rx, 6) AS rx, round(z - rz, 6) AS dz FROM o JOIN r USING (uid, cluster)""")
def split_means(spark, sf_dir):
    """A19."""
    p = _positions(spark, sf_dir)
    m = se.split_means(p, p.where("chosen"))
    return m.select("uid", "cluster", F.round(F.col("own")[0], 6).alias("ox"), F.round(F.col("other")[0], 6).alias("rx"), F.round(F.col("own")[2] - F.col("other")[2], 6).alias("dz"))


@query(f"""WITH {POSITIONS}, o AS (SELECT uid, cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM q GROUP BY ALL), r AS (SELECT o.uid, o.cluster, avg(q.x) AS rx, avg(q.y) AS ry, avg(q.z) AS rz FROM o JOIN q ON q.uid = o.uid AND q.cluster <> o.cluster GROUP BY ALL),
d AS (SELECT *, (x - rx) / n AS dx, (y - ry) / n AS dy, (z - rz) / n AS dz FROM (SELECT *, sqrt(pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2)) AS n FROM o JOIN r USING (uid, cluster))),
v AS (SELECT d.*, sample AS view, q.x * 10 - d.x AS ax, q.y * 10 - d.y AS ay, q.z * 10 - d.z AS az FROM d JOIN q ON q.uid = d.uid),
t AS (SELECT *, ax * dx + ay * dy + az * dz AS t FROM v),
f AS (SELECT uid, cluster, view, round(sqrt(pow(ax - (x + dx * t), 2) + pow(ay - (y + dy * t), 2) + pow(az - (z + dz * t), 2)), 9) AS dist FROM t WHERE t >= 0)
SELECT uid, cluster, view, round(dist, 6) AS distance FROM f QUALIFY row_number() OVER (PARTITION BY uid, cluster ORDER BY dist, view) = 1""")
def spatial_views(spark, sf_dir):
    """The view on the cluster's side with the least distance, by the original's formula."""
    p = _positions(spark, sf_dir)
    views = p.select("uid", F.col("sample").alias("view"), F.transform("position", lambda x: x * 10).alias("position"))
    return se.views_in_front(views, se.split_means(p, p))


@query(f"""WITH RECURSIVE {POSITIONS}, e AS (SELECT a.uid, a.cluster, a.sample AS a, b.sample AS b FROM q a JOIN q b ON b.uid = a.uid AND b.cluster = a.cluster
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.12 * 0.12),
k AS (SELECT uid, cluster, a AS sample FROM e GROUP BY ALL HAVING count(*) >= 5),
ke AS (SELECT e.* FROM e JOIN k ka ON ka.uid = e.uid AND ka.cluster = e.cluster AND ka.sample = e.a JOIN k kb ON kb.uid = e.uid AND kb.cluster = e.cluster AND kb.sample = e.b),
r AS (SELECT a, b FROM ke UNION SELECT r.a, ke.b FROM r JOIN ke ON ke.a = r.b),
c AS (SELECT k.uid, k.cluster, k.sample, min(r.b) AS start FROM k JOIN r ON r.a = k.sample GROUP BY ALL),
l AS (SELECT uid, cluster, sample, dense_rank() OVER (PARTITION BY uid, cluster ORDER BY start) - 1 AS label FROM c)
SELECT q.uid, q.cluster, q.sample, coalesce(own.label, min(near.label), -1)::INTEGER AS label
FROM q LEFT JOIN l own ON own.sample = q.sample LEFT JOIN e ON e.a = q.sample LEFT JOIN l near ON near.sample = e.b GROUP BY q.uid, q.cluster, q.sample, own.label""")
def density_labels(spark, sf_dir):
    """Cores, clusters and borders by a join over grid cells."""
    return ne.density_clusters(_positions(spark, sf_dir), 0.12, 5)


@query("WITH l AS (SELECT l_orderkey AS uid, l_linenumber AS cluster, l_partkey AS sample, l_suppkey % 3 AS label, l_quantity FROM lineitem), r AS (SELECT uid, sample, label, row_number() OVER (PARTITION BY uid, label ORDER BY sample) AS c FROM (SELECT DISTINCT uid, sample, label FROM l)) SELECT uid, label::INTEGER AS label, c AS n FROM r QUALIFY row_number() OVER (PARTITION BY uid ORDER BY c DESC, sample, label) = 1")
def label_modes(spark, sf_dir):
    """The most frequent label, the first to reach the count on ties."""
    li = table(spark, sf_dir, "lineitem")
    x = li.select(F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("sample"), (F.col("l_suppkey") % 3).cast("int").alias("label")).distinct()
    return cl.label_mode(x, ("uid",))
