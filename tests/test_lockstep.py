"""X-means in lockstep against numpy, and broadcasts behind a check of bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import clustering as cl
from vantage.operators import selection as se
from vantage.operators import xmeans as xm
from vantage.operators.joins import checked


def _blobs():
    rng = np.random.default_rng(3)
    rows = []
    for uid, n in ((1, 2), (2, 4)):
        for c in range(n):
            rows += [(uid, 100 * c + i, (10.0 * c + rng.normal(0, 0.3, 2)).tolist()) for i in range(25)]
    return rows + [(3, i, [1.0, 1.0]) for i in range(4)] + [(4, 0, [2.0, 3.0]), (5, 0, None)]


@pytest.mark.parametrize("criterion", ["bic", "mndl"])
def test_lockstep_finds_the_blobs_and_scores_like_numpy(spark, criterion):
    rows = _blobs()
    s = spark.createDataFrame(rows, "uid long, sample long, vector array<double>")
    r = xm.x_means_lockstep(s, 1, 6, 2 if criterion == "bic" else 1, 1, criterion, whitened=False, normalize=False)
    centers, labels = {}, {}
    for c in r.centers.collect():
        centers.setdefault(c["uid"], {})[c["cluster"]] = np.array(c["vector"])
    for x in r.labels.collect():
        labels.setdefault(x["uid"], {})[x["sample"]] = x["cluster"]
    assert sorted(centers) == sorted(labels) == [1, 2, 3, 4]  # the item without a vector has no rows
    if criterion == "bic":
        assert len(centers[1]) == 2 and len(centers[2]) == 4
        assert all(len({labels[2][100 * c + i] for i in range(25)}) == 1 for c in range(4))
    assert len(centers[3]) == len(centers[4]) == 1  # equal rows and single rows are not split
    trace = {}
    for t in sorted(r.trace.collect()):
        trace[t["uid"]] = t
    score = cl.bic if criterion == "bic" else cl.mndl
    for uid in (1, 2):
        own = [(sample, v) for u, sample, v in rows if u == uid]
        x = np.array([v for _, v in own])
        k = len(centers[uid])
        got = score(x, np.array([labels[uid][sample] for sample, _ in own]), np.stack([centers[uid][c] for c in range(k)]))
        assert trace[uid]["k"] == k and abs(trace[uid]["score"] - got) < 1e-5
    assert trace[4]["score"] is None  # no more rows than clusters


def test_lockstep_limits_and_empty_input(spark):
    s = spark.createDataFrame(_blobs(), "uid long, sample long, vector array<double>")
    r = xm.x_means_lockstep(s, 2, 3, 1, 1)
    assert r.trace.agg(F.max("k")).collect()[0][0] == 3  # the room of an item is kept
    empty = xm.x_means_lockstep(s.where("false"), 1, 3)
    assert empty.centers.count() == empty.labels.count() == 0
    with pytest.raises(ValueError):
        xm.x_means_lockstep(s, 0, 3)
    with pytest.raises(ValueError):
        xm.x_means_lockstep(s, 1, 3, criterion="aic")


def test_broadcast_by_bytes(spark):
    kinds = "k long, t string, v array<double>, r array<struct<a: int, w: array<double>>>, m map<string, int>"
    rows = [(i, "x" * 100, [1.0] * 50, [(1, [1.0] * 50)], {"a": 1}) for i in range(100)] + [(None,) * 5]
    df = spark.createDataFrame(rows, kinds)
    hinted = lambda d: "strategy=broadcast" in df.join(d, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(checked(df, 200_000)) and not hinted(checked(df, 80_000))  # about 1 kB a row
    assert hinted(checked(df.where("false"), 0))


def test_selected_view_shades(spark):
    s = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 1, [0.0, 1.0]), (1, 2, None, None), (2, 0, 0, [1.0, 0.0]), (3, 0, 0, [1.0, 1.0])], "uid long, sample long, cluster int, vector array<double>")
    v = spark.createDataFrame([(1, 0, 7, [2.0, 0.0]), (1, 1, 8, [0.0, 1.0]), (2, 0, 7, [3.0, 0.0])], "uid long, cluster int, view long, vector array<double>")
    got = {(r["uid"], r["cluster"], r["sample"]): (r["own"], r["similarity"], r["shade"]) for r in se.selected_view_shades(s, v).collect()}
    assert got[1, 0, 0] == (True, 2.0, 1.0) and got[1, 0, 1] == (False, 0.0, 0.0) and got[1, 1, 1] == (True, 1.0, 0.5)
    assert got[1, 0, 2] == (None, None, None)  # no vector: nothing to compare
    assert got[2, 0, 0] == (True, 3.0, 0.0)  # all equal
    assert len(got) == 7  # the item without a selected view has no rows
