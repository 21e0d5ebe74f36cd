"""Readers and writers round trip through files; stages and configurations."""

import json

import pytest
from pyspark.sql import functions as F

from vantage.plans import config, stages
from vantage.sources import tables as st
from vantage.streaming import tracker as tk


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data))


def test_stage_files(spark, tmp_path):
    put(tmp_path / "a/transforms.json", {"fl_x": 1.0, "w": 4, "frames": [{"file_path": "x.png", "transform_matrix": [[1.0]]}, {"file_path": "/abs.png", "transform_matrix": [[2.0]]}]})
    rows = st.cameras(spark, str(tmp_path / "a")).orderBy("view").collect()
    assert rows[0]["path"].endswith("/a/x.png") and rows[1]["path"] == "/abs.png" and rows[1]["transform"] == [[2.0]]
    put(tmp_path / "p/positions.json", [[1, 2, 3], [4, 5, 6]])
    assert st.positions(spark, str(tmp_path / "p")).count() == 2
    put(tmp_path / "e/embeddings.json", {"type": "CLIP", "dict": {"CLIP": [[1.0]], "DINO": [[2.0], [3.0]]}})
    assert sorted((r["type"], r["is_default"], r["sample"]) for r in st.embeddings(spark, str(tmp_path / "e")).collect()) == [("CLIP", True, 0), ("DINO", False, 0), ("DINO", False, 1)]
    put(tmp_path / "c/clusters.json", {"parameters": {"centroids": [[1.0], [2.0]]}, "indices": [0, 1, 1]})
    centers, labels = st.clusters(spark, str(tmp_path / "c"))
    assert centers.count() == 2 and [r["cluster"] for r in labels.orderBy("sample").collect()] == [0, 1, 1]
    put(tmp_path / "k/avg.json", {"ks": [2, 3], "ds": [1.0, 0.5], "pred_k": 3})
    assert sorted((r["k"], r["d"]) for r in st.elbows(spark, str(tmp_path / "k")).collect()) == [(2, 1.0), (3, 0.5)]
    put(tmp_path / "s/loss.json", [{"step": 1, "value": 0.5}])
    (tmp_path / "s/bad.json").write_text("{broken")
    assert [(r["metric"], r["value"]) for r in st.series(spark, str(tmp_path / "s")).collect()] == [("loss", 0.5)]
    put(tmp_path / "v/views.json", [{"index": 3, "transform": [[1.0]], "path": "p"}])
    assert st.selected_views(spark, str(tmp_path / "v")).first()["index"] == 3


def test_metadata_maps(spark, tmp_path):
    put(tmp_path / "ann/000.json", {"u1": {"name": "x"}, "u2": {"name": "y"}})
    put(tmp_path / "ann/001.json", {"u3": {}})
    uids = spark.createDataFrame([("u2",)], "uid string")
    shards = spark.createDataFrame([("u1", "000.json"), ("u2", "000.json"), ("u3", "001.json")], "uid string, shard string")
    assert [r["uid"] for r in st.annotations(spark, str(tmp_path / "ann"), uids, shards).collect()] == ["u2"]
    put(tmp_path / "items.json", {"cat": ["u2", "u1"]})
    assert [tuple(r) for r in st.category_items(spark, str(tmp_path / "items.json")).orderBy("pos").collect()] == [("cat", 0, "u2"), ("cat", 1, "u1")]
    put(tmp_path / "paths.json", {"u1": "a/u1.glb"})
    assert st.object_paths(spark, str(tmp_path / "paths.json")).first()["path"] == "a/u1.glb"
    assert st.listing(spark, str(tmp_path / "ann"), r"^00\d\.json$", content=True).count() == 2


def test_sinks(spark, tmp_path):
    images = spark.createDataFrame([("i", 0, "a.png", "h", "a.json", "g")], "uid string, n int, image string, image_sha1 string, transform string, transform_sha1 string")
    st.write_index(images, str(tmp_path / "index"))
    assert (tmp_path / "index/_SUCCESS").exists()
    assert st.read_index(spark, str(tmp_path / "index" / "*")).first()["selected_views"][0]["image"]["sha1"] == "h"
    with pytest.raises(Exception, match="image without transform"):
        st.write_index(images.withColumn("transform", F.lit(None).cast("string")), str(tmp_path / "bad"))
    st.write_stage(images, str(tmp_path / "stage"))
    assert st.read_result(spark, str(tmp_path / "stage")).first()["uid"] == "i"
    st.append_cache(images, str(tmp_path / "cache"))
    st.append_cache(images, str(tmp_path / "cache"))
    assert st.read_result(spark, str(tmp_path / "cache")).count() == 2
    v = spark.createDataFrame([("u", 1, [[1.0]]), ("u", 0, [[0.0]])], "uid string, view int, transform array<array<double>>")
    data = json.loads(st.cameras_json(v, 1.0, 2.0, 8, 6).first()["json"])
    assert [f["file_path"] for f in data["frames"]] == ["frame_00001.png", "frame_00002.png"] and data["cx"] == 4.0
    t = spark.createDataFrame([("u", "a", "p")], "uid string, name string, path string")
    assert st.rebuild_index(t, t).count() == 1
    with pytest.raises(Exception, match="no transform"):
        st.rebuild_index(t, t.where("false")).collect()


def test_dataset_cache_in_records(spark, tmp_path, monkeypatch):
    """A large set is several records: no row holds it whole, and no uid is looked up in a map of all."""
    rows = [(c, i, f"{c}{i}", f"p{c}{i}") for c in "ab" for i in range(9)] + [("c", 0, "a1", "pa1")]
    items = spark.createDataFrame(rows, "category string, pos int, uid string, path string")
    monkeypatch.setattr(st, "CACHE_ITEMS", 4)
    st.write_dataset_cache(items, str(tmp_path / "d"), limit=9)
    got = st.dataset_cache(spark, str(tmp_path / "d"), limit=9)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert len(list((tmp_path / "d").glob("part-*.json"))) == 5 and "element_at" not in got._jdf.queryExecution().toString()
    assert st.dataset_cache(spark, str(tmp_path / "d"), limit=8).count() == 0


def test_caches(spark, tmp_path):
    items = spark.createDataFrame([("a", 0, "u1", "p1"), ("a", 1, "u2", "p2"), ("b", 0, "u3", "p3")], "category string, pos int, uid string, path string")
    st.write_dataset_cache(items, str(tmp_path / "d"), categories=["b", "a"], limit=2)
    got = st.dataset_cache(spark, str(tmp_path / "d"), ["a", "b"], None, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, items.collect()))
    assert st.dataset_cache(spark, str(tmp_path / "d"), ["a"], None, 2).count() == 0
    made = []

    def create():
        made.append(1)
        return spark.range(3)

    for config, n in (({"k": 1}, 1), ({"k": 1}, 1), ({"k": 2}, 2), ({"k": 1}, 3)):
        assert st.feature_cache(spark, str(tmp_path / "f"), config, create).count() == 3 and len(made) == n


def test_run_names():
    import datetime

    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert config.run_name(t, set()) == "2024-01-02_030405" and config.run_name(t, {"2024-01-02_030405"}) == "2024-01-02_030405_2"


def test_stages():
    assert stages.between("render", "train_field") == ["render", "sample_positions", "train_field"]
    assert stages.depends_on("cluster", "render", transitive=True) and not stages.depends_on("cluster", "render")
    with pytest.raises(ValueError, match="unknown"):
        stages.select_stages(["x"])
    with pytest.raises(ValueError, match="no stages"):
        stages.select_stages([])


def test_configs():
    data, filled = config.load('{"a": {"b": null}}', {"a": {"b": 1, "c": 2}, "d": 3})
    assert data == {"a": {"b": None, "c": 2}, "d": 3} and filled == ["a.c", "d"]
    assert config.get_path(data, "a.c") == 2 and config.get_path(data, "x.y", 5) == 5
    assert config.working_dir("/x", "old/run/a/b", ["/new/run/a/b", "/new/b"]) == "/new/run/a/b"
    assert config.working_dir("/x", "/old/run/a/b", ["/new/run/a/b"]) is None
    m = config.Methods(("a",))
    with pytest.raises(ValueError, match="unknown components"):
        m.parse("nope")
    assert config.first_of_type([{"type": "x"}, {"type": "y", "v": 1}], "y")["v"] == 1


def test_tracker_stream(spark, tmp_path):
    events = [("loss", "scalar", 1, "0.5"), ("loss", "scalar", 2, "bad"), ("other", "scalar", 1, "1"), ("stats", "dict", 1, '{"a": 2, "z": 3}'), ("stats", "dict", 2, "not json")]
    df = spark.createDataFrame(events, tk.EVENT)
    want = {("train_loss", 1, 0.5), ("stat_a", 1, 2.0)}
    scalars, dicts = {"loss": "train_loss"}, {"stats": {"a": "stat_a"}}
    assert {tuple(r) for r in tk.track(df, scalars, dicts).collect()} == want
    df.coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        tk.run_tracker(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), scalars, dicts)
    assert {(r["metric"], r["step"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_readers_of_parameters_and_rounds(spark, tmp_path):
    trace = """{"improve_parameters_count": 2, "improve_structure_count": 1, "iterations_global_scores": [1.0, 3.0],
      "iterations_pre_split_clusters": [1, 2], "iterations_post_split_clusters": [2, 2], "iterations_local_pre_split_scores": [[1.0], []],
      "iterations_local_post_split_scores": [[2.0], []], "clusters_iterations": [0, 1], "clusters_global_scores": [1.0, 3.0],
      "clusters_indices": [[[0, 1, 2]], [[0, 2], [1]]], "clusters_centers": [[[0.5]], [[0.25], [1.0]]]}"""
    files = {"solution": '{"indices": [[0, 2], [1]], "centers": [[0.5, 1.0], [2.0, 3.0]], "score": 0.5}', "trace": trace, "norm": '{"scale": [2.0, 2.0, 2.0], "offset": [0.0, 1.0, 0.0]}', "params": '{"clip": {"parameters": {"dim": [4]}}}'}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    at = lambda name: str(tmp_path / f"{name}.json")
    rows = lambda df: sorted(map(tuple, df.drop("file").collect()))
    assert rows(st.x_means_solutions(spark, at("solution"))) == [(0, [0, 2], [0.5, 1.0], 2, 0.5), (1, [1], [2.0, 3.0], 2, 0.5)]
    assert rows(st.x_means_data(spark, at("trace"))) == [(0, 0, 1.0, 1, [[0, 1, 2]], [[0.5]]), (1, 1, 3.0, 2, [[0, 2], [1]], [[0.25], [1.0]])]
    assert rows(st.x_means_iterations(spark, at("trace"))) == [(0, 1, 2, 0, 1.0, 2.0), (1, 2, 2, None, None, None)]
    assert rows(st.x_means_scores(spark, at("trace"))) == [(0, 1.0), (1, 3.0)]
    assert st.normalizations(spark, at("norm")).first()["offset"] == [0.0, 1.0, 0.0]
    assert st.transform_parameters(spark, at("params")).select("type", "parameters").first() == ("clip", '{"dim":[4]}')


def test_annotations_of_wanted_shards(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"s{i}.json").write_text(f'{{"u{i}": {{"n": {i}}}}}')
    uids = spark.createDataFrame([("u0",), ("u2",)], "uid string")
    shards = spark.createDataFrame([(f"u{i}", f"s{i}.json") for i in range(3)], "uid string, shard string")
    read = lambda uids: sorted(r["uid"] for r in st.annotations(spark, str(tmp_path), uids, shards).collect())
    assert read(uids) == ["u0", "u2"] and read(uids.limit(0)) == []
    monkeypatch.setattr(st, "NAMED_SHARDS", 1)  # more than can be named: all files are read, none is dropped
    assert read(uids) == ["u0", "u2"]
