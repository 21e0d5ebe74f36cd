"""Operators on hand-made fixtures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.functions import geometry as ge
from vantage.functions.scalars import rounded, uniform, uniforms
from vantage.operators import clustering as cl
from vantage.operators import dataset as ds
from vantage.operators import evaluation as ev
from vantage.operators import fields as fi
from vantage.operators import neighbours as ne
from vantage.operators import projection as pr
from vantage.operators import joins as jo
from vantage.operators import sampling as sa
from vantage.operators import selection as se
from vantage.operators import transform as tr


def test_precision_recall_with_ties(spark):
    rows = [("c", 3, 0.9, True), ("c", 1, 0.5, False), ("c", 2, 0.5, True), ("c", 4, 0.1, False), ("one", 1, 0.5, True), ("none", 1, 0.5, False)]
    s = spark.createDataFrame(rows, "category string, uid int, similarity double, relevant boolean")
    curve = ev.precision_recall(s)
    got = [(r["uid"], r["rank"], r["precision"], r["recall"]) for r in curve.where("category = 'c'").orderBy("rank").collect()]
    assert got == [(3, 1, 1.0, 0.5), (1, 2, 0.5, 0.5), (2, 3, pytest.approx(2 / 3), 1.0), (4, 4, 0.5, 1.0)]
    auc = {r["category"]: r["auc"] for r in ev.area_under_curve(curve).collect()}
    assert auc == {"c": pytest.approx(0.5 * (0.5 + 2 / 3) / 2, abs=1e-6), "one": 0.0}
    sizes = spark.createDataFrame([("c", 4)], "category string, size int")
    assert ev.precision_recall(s, sizes=sizes).agg(F.max("recall")).first()[0] == 0.5


def test_mean_and_list_compat(spark):
    v = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(3)] + [(2, 0, [5.0, 5.0])], "uid int, view int, vector array<double>")
    plain = {r["uid"]: r for r in ev.mean_and_list(v).collect()}
    assert plain[1]["mean"] == [1.0, 1.0] and plain[1]["vectors"][0] == [0.0, 1.0]
    compat = {r["uid"]: r for r in ev.mean_and_list(v, first_is_mean=True).collect()}
    assert compat[1]["vectors"] == [[1.0, 1.0], [1.0, 1.0], [2.0, 1.0]] and compat[2]["vectors"] == [[5.0, 5.0]]


def test_histograms_are_dense(spark):
    c = spark.createDataFrame([("a", 0), ("a", 3), ("b", 1)], "category string, value int")
    h = ev.discrete_histogram(c)
    assert sorted(map(tuple, h.collect())) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 0, 0), ("b", 1, 1)]
    assert {r["bucket"]: r["avg"] for r in ev.average_histogram(h).collect()} == {0: 0.5, 1: 0.5, 2: 0.0, 3: 0.5}


def test_losses_drop_non_finite(spark):
    x = spark.createDataFrame([(0, 1.0), (0, float("nan")), (0, float("inf")), (0, 3.0), (1, float("-inf")), (2, None)], "step int, value double")
    assert [tuple(r) for r in ev.loss_statistics(x).collect()] == [(0, 2.0, 1.0)]


def test_reconcile(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, h string")
    a = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "id int, h string")
    assert {r["id"]: r["status"] for r in jo.reconcile(e, a, "id", "h").collect()} == {1: "found", 2: "modified", 3: "missing", 4: "new"}


def test_priorities(spark):
    t = [spark.createDataFrame([(k, v)], "k int, v string") for k, v in ((1, "a"), (1, "b"), (2, "c"))]
    assert dict(map(tuple, jo.first_wins(t, "k").collect())) == {1: "a", 2: "c"}
    assert dict(map(tuple, jo.last_wins(t, "k").collect())) == {1: "b", 2: "c"}


def test_errors_are_raised(spark):
    x = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="several values"):
        ds.require_one(x, "k", "v").collect()
    with pytest.raises(Exception, match="unknown key"):
        jo.require_subset(x, spark.createDataFrame([(2,)], "k int"), "k").collect()
    with pytest.raises(Exception, match="too few"):
        ds.seeded_sample(x, ["k"], "v", 3, "s", exact=True).collect()
    with pytest.raises(Exception, match="not cached"):
        jo.cached_values(x.select(F.col("v").alias("key")), spark.createDataFrame([], "key string, value int"), checks=(), required=True).collect()


def test_batches_cover_all(spark):
    got = ds.batches(spark.range(2500), "id", 1000).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [1000, 1000, 500]


def test_ranks_over_ranges(spark):
    rows = [(k, v, w) for k, n in (("a", 40), (None, 25), ("b", 1)) for v, w in ((i % 7, None if i % 5 == 0 else i) for i in range(n))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k string, v int, w int")
    got = {r["id"]: (r["rank"], r["running"], r["whole"]) for r in ds.ranked(df, ["k"], [F.desc("v"), F.col("id")], "w").collect()}
    for key in ("a", None, "b"):
        own = sorted(((-v, i, w or 0) for i, (k, v, w) in enumerate(rows) if k == key))
        for n, (_, i, _) in enumerate(own):
            assert got[i] == (n + 1, sum(w for *_, w in own[: n + 1]), sum(w for *_, w in own))
    assert ds.ranked(df.limit(0), ["k"], [F.col("v")]).columns == ["id", "k", "v", "w", "rank"]


def test_percentiles(spark):
    x = [5.0, 1.0, 1.0, 1.0, 9.0, float("nan"), None, 2.5]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    known = [v for v in x if v is not None and v == v]
    assert fi.percentile_bounds(df, "v", 0.3, 0.9).first() == pytest.approx(tuple(np.percentile(known, [30, 90])))
    assert tuple(fi.percentile_bounds(df.where("v IS NULL"), "v").first()) == (None, None)


def test_interval_lookup_finds_every_place(spark):
    bounds = [(1, i, float(i), float(i + 1), 5.0, i) for i in range(5)] + [(1, 9, 2.0, 2.0, 5.0, 99)]  # an empty interval is never met
    iv = spark.createDataFrame(bounds, "k int, i int, lo double, hi double, total double, x int").drop("i")
    draws = spark.createDataFrame([(1, u) for u in (0.0, 0.19, 0.2, 0.5, 0.99, 1.0)], "k int, u double")
    got = {r["u"]: r["x"] for r in sa.interval_lookup(draws, iv, "k").collect()}
    assert got == {0.0: 0, 0.19: 0, 0.2: 1, 0.5: 2, 0.99: 4, 1.0: 4}


def test_k_means_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, [*(np.array([[0, 0], [9, 0], [0, 9]][i % 3]) + rng.normal(0, 0.1, 2)).tolist(), 4.0]) for i in range(30)]
    s = spark.createDataFrame(rows, "uid long, sample long, vector array<double>")
    centers, labels = cl.k_means(s, 3, normalize=False)
    got = {r["sample"]: r["cluster"] for r in labels.collect()}
    assert all(got[i] == got[i % 3] for i in got) and len(set(got.values())) == 3
    assert sorted(round(c["vector"][0] + c["vector"][1]) for c in centers.collect()) == [0, 9, 9]
    assert cl.whitening(s).first()["scale"][2] == 1.0
    found = cl.cluster_items(s, 1, 3).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [10, 10, 10]
    weights = cl.soft_assignment(s, centers).groupBy("sample").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in weights)


def test_elbows(spark):
    c = spark.createDataFrame([("u", k, d) for k, d in ((2, 10.0), (3, 6.0), (4, 4.0), (10, 2.0))], "uid string, k int, d double")
    r = cl.predict_k(c, cl.fractional_target(c, 0.5)).first()
    assert (r["target"], r["frac_k"], r["k"]) == (6.0, 3.0, 3)
    odd = spark.createDataFrame([("u", 2, 1.0), ("u", 3, 5.0)], "uid string, k int, d double")
    assert cl.predict_k(odd, cl.fractional_target(odd, 0.9)).first()["k"] == 2  # no crossing: the nearest
    assert cl.fill_scores(spark.createDataFrame([("u", 2, 1.0), ("u", 4, 3.0)], "uid string, k int, score double")).collect()[1]["score"] == 2.0


def plain_density(x, eps, least):
    """Labels by visiting points in order, as density clustering is usually told."""
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps) for p in x]
    core, labels, c = [len(n) >= least for n in near], np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and labels[i] < 0:
            labels[i], todo = c, [i]
            while todo:
                p = todo.pop()
                for q in near[p] if core[p] else ():
                    if labels[q] < 0:
                        labels[q] = c
                        todo.append(q)
            c += 1
    return labels.tolist()


POINT = "uid long, sample long, position array<double>"


def test_density_clusters_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    groups = {1: np.array([[0.1 * i, 0, 0] for i in range(5)] + [[5 + 0.1 * i, 0, 0] for i in range(5)] + [[9.0, 0, 0]])}
    groups[2] = rng.random((150, 3))
    groups[2][::9] = groups[2][0]
    groups[3] = rng.random((1, 3))
    rows = [(g, i, p.tolist()) for g, x in groups.items() for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, POINT)
    for eps, least in ((0.11, 2), (0.2, 5), (0.0, 3)):
        got = ne.density_clusters(df, eps, least, ("uid",)).orderBy("uid", "sample").collect()
        assert [r["label"] for r in got] == [k for x in groups.values() for k in plain_density(x, eps, least)], eps
    assert ne.density_clusters(df.limit(0), 0.1, 2, ("uid",)).count() == 0


def test_thinning(spark):
    x = np.random.default_rng(1).random((300, 3))
    df = spark.createDataFrame([(u, i, p.tolist()) for u in (1, 2) for i, p in enumerate(x * u)], POINT)
    got = {u: sorted(r["sample"] for r in ne.without_close(df, 0.2, rule="first").where(f"uid = {u}").collect()) for u in (1, 2)}
    for u, kept in got.items():
        want = []
        for i, p in enumerate(x * u):
            if all(((x[j] * u - p) ** 2).sum() >= 0.04 for j in want):
                want.append(i)
        assert kept == want
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = [(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 0.2]
    degree = np.bincount(np.array(pairs).ravel(), minlength=300)
    gone = {j if degree[j] > degree[i] else i for i, j in pairs}
    assert sorted(r["sample"] for r in ne.without_close(df.where("uid = 1"), 0.2).collect()) == [i for i in range(300) if i not in gone]
    assert ne.without_close(df, 0.0).count() == 600
    assert sa.thin_min_distance(df, 100, None).count() == 600 and sa.thin_min_distance(df, 7, 0.01).count() == 14
    kept, trace = sa.thin_to_target(df.withColumn("target", F.lit(40)), 0.0, 2.0, 8)
    sizes = {r["uid"]: r["count"] for r in kept.groupBy("uid").count().collect()}
    last = {r["uid"]: r for r in sorted(trace.collect(), key=lambda r: r["iteration"])}
    assert all(sizes[u] == last[u]["samples"] for u in (1, 2)) and all(abs(n - 40) < 15 for n in sizes.values())


def test_thinning_of_small_groups_writes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(u, i, (np.round(rng.random(3) * 8) / 8).tolist(), f"n{i}") for u in range(6) for i in range(50 if u else 1)]
    df = spark.createDataFrame(rows, POINT + ", note string").withColumn("target", F.lit(20))
    ways = {
        "degree": lambda: ne.without_close(df, 0.25), "first": lambda: ne.without_close(df, 0.25, rule="first"),
        "own": lambda: ne.without_close(df, F.col("uid") * 0.125), "kept": lambda: sa.thin_to_target(df, 0.0, 1.0, 5, 30)[0],
        "trace": lambda: sa.thin_to_target(df, 0.0, 1.0, 5, 30)[1],
    }
    monkeypatch.setattr(ne, "SMALL_GROUP", 0)
    joined = {k: sorted(map(tuple, way().collect())) for k, way in ways.items()}
    monkeypatch.setattr(ne, "SMALL_GROUP", 50)
    monkeypatch.setattr(ne, "near_pairs", lambda *a: pytest.fail("pairs of a small group"))
    for k, way in ways.items():
        assert sorted(map(tuple, way().collect())) == joined[k] and joined[k], k


def test_points_of_small_items_are_those_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(u, f, *rng.normal(size=(3, 3)).round(3).tolist()) for u in range(9) for f in range(1 + 3 * u)]
    flat = [[1.0, 2.0, 3.0]] * 3
    rows += [(0, -1, *flat), (3, 100, *flat), (20, 0, *flat), (21, 0, None, [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]), (21, 1, [0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0])]
    rows += [(22, 0, [0.0, 0.0, None], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]), (None, 0, [0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0])]
    tri = spark.createDataFrame(rows, "uid long, face int, v0 array<double>, v1 array<double>, v2 array<double>")
    six = lambda x: F.floor(x * 1_000_000 + 0.5) / 1_000_000
    points = lambda: [(r["uid"], r["sample"], r["face"], tuple(np.round(r["position"], 9))) for r in sa.surface_points(tri, 20, "s").orderBy("uid", "sample").collect()]
    thinned = lambda: sorted(map(tuple, sa.thin_surface(tri, 20, "s", 0.5, "first", six).select("uid", "sample", "face").collect()))
    monkeypatch.setattr(sa, "SMALL_FACES", 0)
    want = points(), thinned()
    assert {r[0] for r in want[0]} == {*range(9), 21} and len(want[0]) == 200 and 10 < len(want[1]) < 200
    at = sa.surface_points(tri, 20, "s").withColumn("position", F.transform("position", six))
    assert want[1] == sorted(map(tuple, ne.without_close(at, 0.5, rule="first").select("uid", "sample", "face").collect()))
    monkeypatch.setattr(sa, "SMALL_FACES", 10)  # some items by joins
    assert points() == want[0]
    monkeypatch.setattr(sa, "SMALL_FACES", 64)  # only the odd ones
    assert (points(), thinned()) == want
    monkeypatch.setattr(sa, "SMALL_GROUP", 19)
    assert points() == want[0]
    assert sa.thin_surface(tri.limit(0), 20, "s", 0.5).count() == 0


def test_candidates_are_drawn_and_thinned_where_their_faces_are(spark, monkeypatch):
    """36 points an item are many times the bytes of its 4 faces: they are neither stored nor shuffled."""
    from vantage.queries import geometry

    for module in (ne, sa):
        monkeypatch.setattr(module, "stored", lambda *a: pytest.fail("points were stored"))
    plan = geometry.first_far_samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange [^\n]*", plan)
    assert len(exchanges) == 1 and "uid" in exchanges[0] and "SortMergeJoin" not in plan
    assert plan.count("ArrowEvalPython") == 2  # drawn once, thinned once


def test_uniforms_are_uniform(spark):
    keys = [f"{i}/ü{i * 7}" for i in range(200)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", uniform(F.lit("s/a"), F.col("k")).alias("u"))
    assert [r["u"] for r in df.orderBy("i").collect()] == uniforms(f"s/a|{k}" for k in keys).tolist()


def test_x_means_options(spark):
    rng = np.random.default_rng(7)
    spots = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    rows = [(1, i, [*(spots[i % 4] * [1, 100] + rng.normal(0, 0.1, 2) * [1, 100]).tolist(), 4.0]) for i in range(60)]
    s = spark.createDataFrame(rows, "uid long, sample long, vector array<double>")
    last = {r["sample"]: (r["cluster"], r["k"], r["score"]) for r in cl.cluster_items(s, 1, 8).collect()}
    best = {r["sample"]: (r["cluster"], r["k"], r["score"]) for r in cl.cluster_items(s, 1, 8, best=True).collect()}
    trace = sorted(cl.x_means_trace(s, 1, 8).collect())
    assert best[0][2] == max(r["score"] for r in trace) >= last[0][2]
    assert [r["step"] for r in trace] == list(range(len(trace))) and len(trace) > trace[-1]["iteration"] + 1  # some round split several
    assert len({(c, i % 4) for i, (c, _, _) in best.items()}) == best[0][1] == max(trace, key=lambda r: r["score"])["k"] >= 4  # no cluster mixes spots
    again = cl.cluster_items(s, 1, 8, best=True, rerun=True).first()
    assert again["k"] <= best[0][1]
    raw = {r["cluster"]: np.array(r["vector"]) for r in cl.x_means_centroids(s, 1, 8, best=True, normalize=False).collect()}
    for c, center in raw.items():
        assert np.allclose(center, np.mean([v for _, n, v in rows if best[n][0] == c], axis=0))
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-9 for r in cl.x_means_centroids(s, 1, 8).collect())


def test_samplers(spark):
    f = sa.farthest_points(np.array([[0.0], [1.0], [10.0], [4.0]]), 3, 0)
    assert f == [0, 2, 3]
    tri = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]), (1, 1, [5.0, 0.0, 0.0], [8.0, 0.0, 0.0], [5.0, 2.0, 0.0])], "uid long, face int, v0 array<double>, v1 array<double>, v2 array<double>")
    p = sa.surface_points(tri, 400, "s").groupBy("face").count().orderBy("face").collect()
    assert 60 < p[0]["count"] < 140 and p[0]["count"] + p[1]["count"] == 400


def test_pca_reconstructs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) * [3, 2, 1, 0.1] + 5
    s = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample long, vector array<double>")
    m = tr.pca(s, 4)
    y = np.array([r["vector"] for r in tr.apply_pca(s, m).orderBy("sample").collect()])
    assert np.allclose(y @ np.array(m["components"]) + m["mean"], x)
    assert len(tr.pca(s, variance=0.9)["components"]) < 4 and tr.covariance(s.limit(0))[2] == 0
    assert tr.explained_variance(m, spark).orderBy("component").collect()[-1]["cumulative"] == pytest.approx(1)
    with pytest.raises(Exception, match="expected 3"):
        tr.identity(s, 3).collect()


def test_spatial_selection(spark):
    pts = spark.createDataFrame([(1, 0, 0, [1.0, 0.0, 0.0]), (1, 0, 1, [1.2, 0.0, 0.0]), (1, 1, 2, [-1.0, 0.0, 0.0])], "uid long, cluster int, sample int, position array<double>")
    views = spark.createDataFrame([(1, 0, [3.0, 0.0, 0.0]), (1, 1, [3.0, 2.0, 0.0]), (1, 2, [-3.0, 0.0, 0.0])], "uid long, view int, position array<double>")
    got = {r["cluster"]: r["view"] for r in se.views_in_front(views, se.split_means(pts, pts)).collect()}
    assert got == {0: 0, 1: 2}
    alone = se.split_means(pts.where("cluster = 1"), pts).first()
    assert alone["other"] == [0.0, 0.0, 0.0]


def test_log_bins(spark):
    g = np.random.default_rng(7).random((4, 6, 2))
    holes = {(5, 3), (2, 1)}
    cells = [(9, x, y, g[y, x].tolist()) for y in range(4) for x in range(6)]
    grid = spark.createDataFrame(cells, "image long, cx int, cy int, vector array<double>")
    for df, left_out in ((grid, set()), (grid.where("NOT (cx = 5 AND cy = 3) AND NOT (cx = 2 AND cy = 1)"), holes)):
        got = {(r["cx"], r["cy"], r["bin"]): r["vector"] for r in fi.log_bins(df).collect()}
        want = {}
        for x in range(6):
            for y in range(4):
                places = [(0, i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)] + [(1, i, j) for j in (-3, 0, 3) for i in (-3, 0, 3) if i or j]
                for b, (level, i, j) in enumerate(places):
                    nx, ny = min(max(x + i, 0), 5), min(max(y + j, 0), 3)
                    box = [g[q, p] for p in range(nx - level, nx + level + 1) for q in range(ny - level, ny + level + 1) if 0 <= p < 6 and 0 <= q < 4 and (p, q) not in left_out]
                    if (x, y) not in left_out and (nx, ny) not in left_out:
                        want[x, y, b] = np.mean(box, axis=0)
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    whole = {(r["cx"], r["cy"]): r["vector"] for r in fi.log_binned(grid).collect()}
    assert len(whole) == 24 and all(len(v) == 34 for v in whole.values()) and np.allclose(whole[1, 1][8:10], g[1, 1])


def test_projection_and_depth(spark):
    eye = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 5.0], [0.0, 0.0, 0.0, 1.0]]  # at z = 5, looking down
    pts = [(1, 0, [0.0, 0.0, 0.0]), (1, 1, [0.0, 0.0, 1.0]), (1, 2, [1.0, 1.0, 0.0]), (1, 3, [0.0, 0.0, 4.99]), (1, 4, [9.0, 0.0, 0.0]), (1, 5, [0.0, 0.0, 6.0])]
    p = pr.project(spark.createDataFrame(pts, POINT), spark.createDataFrame([(1, 7, eye)], "uid long, view int, transform array<array<double>>"), np.pi / 2, 100, 50)
    got = {r["sample"]: (r["x"], r["y"], round(r["z"], 9)) for r in p.collect()}
    assert got == {0: (50.0, 25.0, 5.0), 1: (50.0, 25.0, 4.0), 2: (55.0, 30.0, 5.0), 4: (95.0, 25.0, 5.0)}  # 3 too near, 5 behind
    wide = p.where("sample < 4").unionByName(p.where("sample = 4").withColumn("x", F.lit(100.0)))
    seen = {r["sample"]: r["visible"] for r in pr.with_visibility(wide, pr.depth_buffer(wide, 100, 50)).collect()}
    assert seen == {0: 0, 1: 1, 2: 1, 4: 0}


def test_python_functions_need_no_copy_of_the_package(tmp_path):
    """Queries with Python functions run from another working folder, where workers cannot import the package."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from vantage.operators import clustering as cl
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
d = s.createDataFrame([(0, i, [float(i % 2), float(i)]) for i in range(8)], "uid long, sample long, vector array<double>")
assert cl.cluster_items(d, 1, 2).count() == 8
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=200, capture_output=True)


def test_classification_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x, c = rng.normal(size=(80, 6)), rng.normal(size=(30, 6))
    c[7] = c[3]  # a tie: the first name wins
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "uid long, vector array<double>")
    cats = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(c)] + [("none", None)], "category string, vector array<double>")
    s = np.copysign(np.floor(np.abs(x @ c.T) * 1e6 + 0.5), x @ c.T) / 1e6
    want = {i: (f"c{s[i].argmax():02d}", s[i].max()) for i in range(80) if s[i].max() > 0.5}
    for size in (ev.BLOCK_BYTES, 6 * 8 * 7):
        monkeypatch.setattr(ev, "BLOCK_BYTES", size)
        assert {r["uid"]: (r["predicted"], r["similarity"]) for r in ev.classify(items, cats, 0.5).collect()} == want
    assert ev.classify(items, cats.limit(0)).count() == 0


def test_config_digests(spark):
    from vantage.plans import digests as dg

    texts = ['{"_target":"A","device":{"n":[1]},"b":[1,{"c":null}],"a":"x"}', '{"a":"x","b":[1,{"c":null}],"device":2}', '{"a":"x","b":[1,{"c":0}]}', "{}", '{"devices":1}']
    got = {r["key"]: r["digest"] for r in dg.config_digests(spark.createDataFrame(list(enumerate(texts)), "key int, config string")).collect()}
    assert got[0] == got[1] and len(set(got.values())) == 4
    found = {(r["path"], r["value"]) for r in dg.leaves(spark.createDataFrame([(0, texts[1])], "key int, config string")).collect()}
    assert found == {(".a", '"x"'), (".b[0]", "1"), (".b[1].c", "null"), (".device", "2")}


def _scene(spark):
    points = spark.createDataFrame([(1, i, [i / 40 - 0.5, (i * 7 % 40) / 40 - 0.5, (i * 3 % 40) / 40 - 0.5]) for i in range(40)], POINT)
    views = ge.sphere_views(spark, 4, 3).select(F.lit(1).cast("long").alias("uid"), F.col("index").alias("view"), "transform")
    return pr.project(points, views, 1.0, 24, 16), points


def test_depth_buffer_is_compiled(spark):
    """Methods of more than 8,000 bytes are interpreted, at a tenth of the speed and less."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pr.depth_buffer(_scene(spark)[0], 24, 16)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan))) < 8000


def test_visibility_does_not_shuffle_the_samples(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p, _ = _scene(spark)
        plan = pr.with_visibility(p, pr.depth_buffer(p, 24, 16))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_view_counts_equal_the_tested_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((600, 3)) - 0.5, 2)
    x[::7], x[1], x[2], x[3] = x[0], [np.nan, 0, 0], [np.inf, 0, 0], [0.0, 0.0, 9e9]
    rows = [(u if u < 4 else None, i, p.tolist()) for u in range(5) for i, p in enumerate(x[: 600 // (u + 1)])]
    rows += [(0, 900, None), (0, 901, [None, 0.0, 0.0]), (1, 902, [0.5, None, 0.5]), *((2, 1000 + i, [0.1, 0.1, 0.1]) for i in range(50))]
    points = spark.createDataFrame(rows, POINT)
    views = ge.sphere_views(spark, 3, 2).select(F.col("index").alias("view"), "transform")
    views = views.unionByName(views.where("view = 1")).unionByName(views.where("view = 2").withColumn("view", F.lit(None).cast("long")))
    uids = spark.createDataFrame([(0,), (1,), (2,), (9,), (None,)], "uid long")  # 3 has points only, 9 cameras only
    cameras = uids.crossJoin(views).where("uid > 0 OR view > 3")
    args = (1.0, 24, 16, 1.6, 3.0)
    p = pr.project(points, cameras, *args)
    tested = pr.with_visibility(p, pr.depth_buffer(p, 24, 16)).groupBy("uid", "view").agg(F.sum("visible"), F.sum(1 - F.col("visible")))
    want = sorted(str(tuple(r)) for r in tested.collect())
    assert len(want) == 2 + 2 * 7
    for sizes in ({}, {"STEP_PAIRS": 5, "HELD_PAIRS": 40}, {"DENSE_CELLS": 0, "HELD_PAIRS": 300}, {"BROADCAST_BYTES": 0}):
        with monkeypatch.context() as m:
            for k, v in sizes.items():
                m.setattr(pr, k, v)
            assert sorted(str(tuple(r)) for r in pr.view_counts(points, cameras, *args).collect()) == want, sizes
    assert pr.view_counts(points, cameras.limit(0), *args).count() == pr.view_counts(points.limit(0), cameras, *args).count() == 0


def test_pixels_of_counts_are_pixels_of_rows(spark):
    xs = [n + s * d for n in (-1, 0, 1, 7, 24, 4095) for s in (-1, 1) for d in (0, 1e-7, 4.999e-7, 4.9999999e-7, 5e-7, 5.0000001e-7, 5.001e-7, 1e-6, 1.5e-6, 0.25)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(map(float, xs))], "i int, x double")
    assert [r["p"] for r in df.orderBy("i").select(F.floor(rounded("x")).alias("p")).collect()] == pr._floors(np.array(xs, float)).astype(int).tolist()


def test_counts_by_view_write_no_row_a_point_and_view(spark, monkeypatch):
    """A row for each of the 12 views of a point, twice, is most of the time at 36 million lines."""
    from vantage.queries import geometry

    monkeypatch.setattr(pr, "project", lambda *a, **b: pytest.fail("a row a point and view"))
    rows = geometry.visible_and_obstructed(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 400 and all(r["visible"] > 0 for r in rows)


def test_picked_correspondences_read_the_lines_once(spark, monkeypatch):
    from vantage.queries import geometry

    reads = []
    real = geometry.table
    monkeypatch.setattr(geometry, "table", lambda *a: reads.append(a) or real(*a))
    plan = geometry.picked_correspondences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert len(reads) == 2 and "l_extendedprice" not in plan  # points, which are stored, and the items' keys


def test_rounded_is_round(spark):
    rng = np.random.default_rng(3)
    xs = [*(rng.normal(0, 50, 4000)).tolist(), *((rng.integers(-(10**7), 10**7, 4000) + 0.5) / 1e6).tolist(), 0.0, -1e-9, 2.5e-7, 5e-7, -5e-7, 1e6, 123456789.1234565, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(rounded("x").alias("a"), F.round("x", 6).alias("b"))
    assert df.where("NOT (a <=> b)").count() == 0
