"""Column functions against plain Python."""

import hashlib
import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantage.functions import geometry as ge
from vantage.functions import scalars as sc
from vantage.functions import vectors as ve


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["a", "seed|1", "", "é\n"])
def test_seed_is_the_digest_modulo(spark, text):
    assert one(spark, sc.derive_seed("a", "b"), a=text, b="x") == int(hashlib.sha1((text + "x").encode()).hexdigest(), 16) % (2**32 - 1)


def test_identifiers(spark):
    assert one(spark, sc.uuid5_dns("a"), a="example.org") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "example.org"))
    assert one(spark, sc.frame_name("a"), a=7) == "frame_00008.png" and one(spark, sc.frame_name("a"), a=123455) == "frame_123456.png"
    assert one(spark, sc.prompt("a"), a="ice_cream") == "a photo of a ice cream."
    assert one(spark, sc.strip_suffix("a"), a="x.glb") == "x" and one(spark, sc.strip_suffix("a"), a="x.glbb") == "x.glbb"
    assert one(spark, sc.repo_id("a"), a="https://h/org/repo/blob/abc/x/y.obj") == "org/repo@abc"
    assert one(spark, sc.query_value("a", "fileId"), a="http://x/t:1/f?fileId=42&z=1") == "42"
    assert one(spark, sc.render_cache_key("a", "b"), a="/m/item.v1.glb", b="img.png") == "item.v1_img"
    assert one(spark, sc.is_object_file("a"), a="X/Y.OBJ") and not one(spark, sc.is_object_file("a"), a="x.objx")
    assert one(spark, sc.cache_key("a"), a=["b", "a"]) == hashlib.sha1(b"a\0b\0").hexdigest()


def test_numbers(spark):
    assert one(spark, sc.interpolate("a", 0.05, 1.0, 0.15, 0.5), a=0.1) == pytest.approx(0.75)
    assert one(spark, sc.stride_scale("a", 0.5), a=9.0) == 0.5
    assert one(spark, sc.opacity("a"), a=float("nan")) == 0.0
    assert one(spark, sc.huber("a"), a=-3.0) == pytest.approx(1.25 * (3 - 0.625))
    assert one(spark, sc.focal_length("a", "b"), a=90.0, b=200.0) == pytest.approx(100.0)
    assert not one(spark, sc.is_finite("a"), a=float("inf"))
    assert 0 <= one(spark, sc.uniform(F.lit("s"), "a"), a="k") < 1


vec = st.lists(st.floats(-50, 50, allow_nan=False), min_size=3, max_size=3)


@settings(max_examples=15, deadline=None)
@given(vec, vec)
def test_vector_algebra(spark, a, b):
    cols = [ve.dot("a", "b"), ve.euclidean("a", "b"), ve.norm("a")]
    df = spark.range(1).select(F.array(*map(F.lit, a)).alias("a"), F.array(*map(F.lit, b)).alias("b"))
    got = df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols)), ve.cross("a", "b").alias("x"), ve.l2_normalize("a").alias("n")).first()
    x, y = np.array(a), np.array(b)
    assert np.allclose([got["c0"], got["c1"], got["c2"]], [x @ y, np.linalg.norm(x - y), np.linalg.norm(x)], atol=1e-6)
    assert np.allclose(got["x"], np.cross(x, y), atol=1e-6)
    assert np.allclose(got["n"], x / (np.linalg.norm(x) or 1), atol=1e-9)


def test_cameras_are_rotations(spark):
    for views in (ge.sphere_views(spark, 5, 3, 2, 1.0, 3.0), ge.fermat_views(spark, 9, 2, 1.0, 2.0)):
        rows = views.orderBy("index").collect()
        assert [r["index"] for r in rows] == list(range(len(rows)))
        for r in rows:
            m = np.array(r["transform"])
            assert np.allclose(m[:3, :3].T @ m[:3, :3], np.eye(3), atol=1e-9) and np.linalg.det(m[:3, :3]) == pytest.approx(1)
            assert np.allclose(m[:3, 3], m[:3, 2] * r["distance"])
    assert views.select(ge.is_rigid("transform").alias("ok")).where("NOT ok").count() == 0


def test_euler_angles_give_the_matrix_back(spark):
    v = ge.sphere_views(spark, 4, 3).withColumn("m", ge.quarter_turn_x("transform")).select("m", ge.euler_xyz("m").alias("e"))
    for r in v.collect():
        (a, b, c), m = r["e"], np.array(r["m"])[:3, :3]
        rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
        ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
        rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
        assert np.allclose(rz @ ry @ rx, m, atol=1e-9)


def test_matrix_product(spark):
    v = ge.sphere_views(spark, 3, 2)
    for r in v.select("transform", ge.matmul4("transform", "transform").alias("p")).collect():
        assert np.allclose(np.array(r["transform"]) @ np.array(r["transform"]), np.array(r["p"]))
