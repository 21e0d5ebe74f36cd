"""Sources and sinks: tables are written in the layouts of the pipeline's files and read back by the typed readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..functions.vectors import as_double
from ..operators.dataset import ranked
from ..operators.joins import first_wins
from ..plans import config
from ..sources import tables as st
from .base import registrar, table

ALL, query = registrar()


#: Items of a category that one file holds.
PIECE = 20_000


def _map_file(spark, df, path, key, value, *folders):
    """One JSON map of df's rows a file: several files, by a hash of the key, in folders by the other columns."""
    part = F.pmod(F.xxhash64(key), F.lit(4)).cast("int")
    rows = df.groupBy(*folders, part.alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value"))
    rows.write.partitionBy(*folders, "part").text(path)
    return path


@query("SELECT part.p_partkey::VARCHAR AS uid, p_brand AS brand, p_size AS size FROM part WHERE p_size > 25")
def annotations_of_files(spark, sf_dir):
    """Annotation maps in files, those of wanted uids only."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uid"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("annotation"), "p_size")
    path = _map_file(spark, p, scratch(spark), "uid", "annotation")
    a = st.annotations(spark, path, p.where("p_size > 25").select("uid"))
    return a.select("uid", F.get_json_object("annotation", "$.brand").alias("brand"), F.get_json_object("annotation", "$.size").cast("int").alias("size"))


@query("SELECT doc_id::VARCHAR AS uid, 'glbs/' || source || '/' || doc_id || '.glb' AS path FROM documents")
def object_paths_of_files(spark, sf_dir):
    """Uid -> path maps in files."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uid"), F.concat(F.lit("glbs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".glb")).alias("path"))
    return st.object_paths(spark, _map_file(spark, d, scratch(spark), "uid", "path")).select("uid", "path")


@query("SELECT lang AS category, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INTEGER AS pos, doc_id::VARCHAR AS uid FROM documents")
def category_items_of_files(spark, sf_dir):
    """Category -> uids maps, and the same through a data-set cache."""
    d = ranked(table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), "doc_id"), ["category"], [F.col("doc_id")])
    d = d.groupBy("category", (F.floor((F.col("rank") - 1) / PIECE) * PIECE).alias("start")).agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("uids"))
    items = st.category_items(spark, _map_file(spark, d, scratch(spark), "category", "uids", "start"))
    path = scratch(spark)
    st.write_dataset_cache(items.withColumn("path", F.concat(F.lit("/f/"), "uid")), path, limit=7)
    cached = st.dataset_cache(spark, path, limit=7).where(F.col("path") == F.concat(F.lit("/f/"), "uid"))
    stale = st.dataset_cache(spark, path, limit=8)  # made with another limit: no rows
    return cached.unionByName(stale).select("category", F.col("pos").cast("int").alias("pos"), "uid")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def metadata_of_files(spark, sf_dir):
    """Metadata tables in Parquet, one a source, read with a constant column."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("fileIdentifier"), F.lit("x").alias("license"), "source", F.col("lang").alias("fileType"), F.sha2("text", 256).alias("sha256"))
    path = scratch(spark)
    d.write.parquet(path)
    m = st.metadata(spark, path, constant_metadata=True).where("metadata = '{}'")
    return m.groupBy("source", F.col("fileType").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label::BIGINT AS uid, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS view, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings")
def cameras_of_files(spark, sf_dir):
    """Camera files written from views and read back."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("uid"), F.col("vec_id").alias("view"), F.array(*(F.transform(F.slice("embedding", 4 * i + 1, 4), lambda x: x.cast("double")) for i in range(4))).alias("transform"))
    path = scratch(spark)
    st.cameras_json(e, 1.5, 1.5, 64, 48).select("uid", F.col("json").alias("value")).write.partitionBy("uid").text(path)
    c = st.cameras(spark, f"{path}/*")
    uid = F.regexp_extract("file", "uid=([0-9]+)", 1).cast("long")
    return c.where("fl_x = 1.5 AND w = 64 AND cy = 24").select(uid.alias("uid"), F.col("view").cast("int").alias("view"), F.round(F.col("transform")[0][0], 6).alias("x"))


@query("SELECT label::BIGINT AS uid, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x FROM embeddings GROUP BY label")
def embeddings_of_files(spark, sf_dir):
    """Sample embeddings and positions as JSON stage files, a file an item."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("uid"), "vec_id", as_double("embedding").alias("v"))
    lists = e.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("vs"))
    folder, places = scratch(spark), scratch(spark)
    record = F.to_json(F.struct(F.lit("clip").alias("type"), F.create_map(F.lit("clip"), F.col("vs")).alias("dict")))
    lists.select("uid", record.alias("value")).write.partitionBy("uid").text(folder)
    lists.select("uid", F.to_json("vs").alias("value")).write.partitionBy("uid").text(places)
    uid = F.regexp_extract("file", "uid=([0-9]+)", 1).cast("long")
    a = st.embeddings(spark, f"{folder}/*").where("is_default").select(uid.alias("uid"), "sample", "vector")
    b = st.positions(spark, f"{places}/*").select(uid.alias("uid"), "sample", "position")
    same = a.join(b, ["uid", "sample"]).where(F.col("vector") == F.col("position"))
    return same.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("vector")[0]), 6).alias("x"))


@query("SELECT p_brand AS uid, p_size AS k, round(100.0 / p_size, 6) AS d, max(p_size) OVER (PARTITION BY p_brand) AS pred_k FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def elbows_of_files(spark, sf_dir):
    """Elbow files written and read back."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct().groupBy(F.col("p_brand").alias("uid")).agg(F.array_sort(F.collect_list("p_size")).alias("ks"))
    path = scratch(spark)
    rows = p.select(F.regexp_replace("uid", "[^0-9]", "").alias("uid"), "ks", F.transform("ks", lambda k: F.lit(100.0) / k).alias("ds"), F.array_max("ks").alias("pred_k"))
    rows.write.partitionBy("uid").json(path)
    e = st.elbows(spark, f"{path}/*")
    brand = F.concat(F.lit("Brand#"), F.regexp_extract("file", "uid=([0-9]+)", 1))
    return e.select(brand.alias("uid"), "k", F.round("d", 6).alias("d"), "pred_k")


GROUPED = "e AS (SELECT label::BIGINT AS uid, (vec_id % 3)::INTEGER AS cluster, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id, embedding FROM embeddings), c AS (SELECT uid, dense_rank() OVER (PARTITION BY uid ORDER BY cluster) - 1 AS cluster, avg(embedding[1]::DOUBLE) AS x, avg(embedding[2]::DOUBLE) AS y, list(i ORDER BY i) AS indices FROM e GROUP BY uid, cluster)"


def _grouped(spark, sf_dir):
    """(uid, cluster, indices, center): an item a label, three clusters by number."""
    from ..operators.dataset import ranked

    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("uid"), (F.col("vec_id") % 3).cast("int").alias("cluster"), "vec_id", as_double("embedding").alias("v"))
    e = ranked(e, ["uid"], [F.col("vec_id")]).withColumn("i", (F.col("rank") - 1).cast("int"))
    return e.groupBy("uid", "cluster").agg(F.array_sort(F.collect_list("i")).alias("indices"), F.array(F.avg(F.col("v")[0]), F.avg(F.col("v")[1])).alias("center")), e


@query(f"WITH {GROUPED} SELECT uid, cluster::INTEGER AS cluster, len(indices)::INTEGER AS n, list_sum(indices)::BIGINT AS places, round(x, 6) + 0 AS x, count(*) OVER (PARTITION BY uid)::INTEGER AS k, (uid * 0.5)::DOUBLE AS score FROM c")
def x_means_solutions_of_files(spark, sf_dir):
    """Solutions of x-means in their file layout, written an item a file and read back."""
    clusters, _ = _grouped(spark, sf_dir)
    path = scratch(spark)
    scores = clusters.select("uid").distinct().withColumn("score", F.col("uid") * 0.5)
    st.write_item_files(st.x_means_solution_json(clusters, scores), path)
    r = st.x_means_solutions(spark, f"{path}/*")
    places = F.aggregate("indices", F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select(st.uid_of().cast("long").alias("uid"), "cluster", F.size("indices").alias("n"), places.alias("places"), (F.round(F.col("center")[0], 6) + 0.0).alias("x"), "k", "score")


@query(f"""WITH {GROUPED}, g AS (SELECT uid, count(*) AS k, sum(len(indices)) AS n FROM c GROUP BY uid)
SELECT uid, 'whole' AS kind, 0 AS n, k::INTEGER AS k, uid::DOUBLE * 0.5::DOUBLE AS score FROM g UNION ALL SELECT uid, 'whole', 1, k::INTEGER, uid::DOUBLE * 0.25::DOUBLE FROM g
UNION ALL SELECT uid, 'split', cluster::INTEGER, k::INTEGER, len(indices)::DOUBLE FROM c JOIN g USING (uid) UNION ALL SELECT uid, 'improved', 0, 1, n::DOUBLE FROM g""")
def x_means_data_of_files(spark, sf_dir):
    """What x-means runs keep of their rounds, in its file layout, written and read back."""
    clusters, _ = _grouped(spark, sf_dir)
    sizes = clusters.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("k"), F.sum(F.size("indices")).cast("double").alias("score"))
    lists = clusters.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("cluster", "indices", "center"))).alias("c"))
    whole = lists.select("uid", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), F.col("c.indices").alias("indices"), F.col("c.center").alias("centers"))
    whole = whole.select("uid", "n", F.col("n").alias("iteration"), (F.col("uid") * F.pow(F.lit(0.5), F.col("n") + 1)).alias("score"), "indices", "centers")
    rounds = lists.select("uid", F.lit(0).alias("iteration"), F.size("c").alias("pre_split"), F.size("c").alias("post_split"), F.transform("c", lambda x: F.size(x["indices"]) * 1.0).alias("before"), F.transform("c", lambda x: F.size(x["indices"]) * 1.0).alias("after"))
    path = scratch(spark)
    st.write_item_files(st.x_means_data_json(sizes.select("uid", F.lit(0).alias("n"), "score"), rounds, whole), path)
    uid = st.uid_of().cast("long").alias("uid")
    a = st.x_means_data(spark, f"{path}/*").select(uid, F.lit("whole").alias("kind"), "n", "k", "score")
    b = st.x_means_iterations(spark, f"{path}/*").where("before = after").select(uid, F.lit("split").alias("kind"), F.col("cluster").alias("n"), F.col("pre_split").alias("k"), F.col("before").alias("score"))
    c = st.x_means_scores(spark, f"{path}/*").select(uid, F.lit("improved").alias("kind"), "n", F.lit(1).alias("k"), "score")
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {GROUPED}, b AS (SELECT uid, min(embedding[1]::DOUBLE) AS lo, max(embedding[1]::DOUBLE) AS hi, count(*) AS n FROM e GROUP BY uid)
SELECT b.uid, round(hi - lo, 6) + 0 AS scale, round(-lo, 6) + 0 AS "offset", 'pca' AS type, n AS dim, (SELECT sum(cluster)::BIGINT FROM e WHERE e.uid = b.uid) AS clusters,
 (SELECT count(DISTINCT cluster)::INTEGER FROM e WHERE e.uid = b.uid) AS centroids, 2 AS views, (SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY i) FROM e WHERE e.uid = b.uid AND i < 2) AS chosen FROM b""")
def stages_of_files(spark, sf_dir):
    """Normalizations, transform parameters, clusters and selected views, each in its file layout, written an
    item a file and read back."""
    clusters, e = _grouped(spark, sf_dir)
    box = e.groupBy("uid").agg(F.min(F.col("v")[0]).alias("lo"), F.max(F.col("v")[0]).alias("hi"), F.count(F.lit(1)).alias("n"))
    paths = [scratch(spark) for _ in range(4)]
    st.write_item_files(st.normalization_json(box.select("uid", F.array(F.col("hi") - F.col("lo")).alias("scale"), F.array(-F.col("lo")).alias("offset"))), paths[0])
    st.write_item_files(st.transform_json(box.select("uid", F.lit("pca").alias("type"), F.to_json(F.struct(F.array("n").alias("dim"), F.array(F.array("lo")).alias("mean"))).alias("parameters"))), paths[1])
    centroids = clusters.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "center"))), lambda x: x["center"]).alias("centroids"))
    st.write_item_files(st.clusters_json(e.select("uid", F.col("i").alias("sample"), "cluster"), centroids), paths[2])
    turn = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(4))) for i in range(4)))
    views = e.where("i < 2").select("uid", F.col("i").alias("n"), F.col("vec_id").alias("index"), turn.alias("transform"), F.concat(F.lit("images/"), F.col("vec_id").cast("string")).alias("path"))
    st.write_item_files(st.selected_views_json(views), paths[3])
    uid = st.uid_of().cast("long").alias("uid")
    a = st.normalizations(spark, f"{paths[0]}/*").select(uid, (F.round(F.col("scale")[0], 6) + 0.0).alias("scale"), (F.round(F.col("offset")[0], 6) + 0.0).alias("offset"))
    b = st.transform_parameters(spark, f"{paths[1]}/*").select(uid, "type", F.get_json_object("parameters", "$.dim[0]").cast("long").alias("dim"))
    d, c = st.clusters(spark, f"{paths[2]}/*")
    c = c.groupBy("file").agg(F.sum("cluster").alias("clusters")).select(uid, "clusters")
    d = d.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("centroids")).select(uid, "centroids")
    v = st.selected_views(spark, f"{paths[3]}/*").where("path = concat('images/', index) AND transform[2][2] = 1")
    v = v.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("views"), F.array_join(F.array_sort(F.collect_list("index")).cast("array<string>"), ",").alias("chosen")).select(uid, "views", "chosen")
    return a.join(b, "uid").join(c, "uid").join(d, "uid").join(v, "uid")


@query("SELECT event_type AS metric, event_id AS step, value FROM events")
def series_of_files(spark, sf_dir):
    """Results and loss series written, one folder a metric, and read back."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")
    path = scratch(spark)
    st.write_result(e, path)
    return st.read_result(spark, path).select("metric", "step", "value")


@query("SELECT (page_id // 5)::BIGINT AS item, (row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) - 1)::INTEGER AS n, sha1(html) AS sha1 FROM pages")
def index_of_files(spark, sf_dir):
    """An index rebuilt by name, written, and read back."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("uid"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("name"), F.sha1(F.col("html").cast("binary")).alias("h"))
    images = p.select("uid", "name", F.concat(F.col("uid").cast("string"), F.lit("/"), "name", F.lit(".png")).alias("path"))
    joined = st.rebuild_index(images, p.select("uid", "name", F.concat("name", F.lit(".json")).alias("path"))).join(p, ["uid", "name"])
    path = scratch(spark)
    st.write_index(joined.select("uid", F.col("name").alias("n"), "image", F.col("h").alias("image_sha1"), "transform", F.col("h").alias("transform_sha1")), path)
    v = st.read_index(spark, f"{path}/*").select(F.posexplode("selected_views").alias("n", "v")).where("v.image.sha1 = v.transform.sha1")
    return v.select(F.element_at(F.split("v.image.file", "/"), 1).cast("long").alias("item"), F.col("n").cast("int").alias("n"), F.col("v.image.sha1").alias("sha1"))


@query("SELECT vec_id AS key, label AS value FROM embeddings")
def caches_of_files(spark, sf_dir):
    """A cache grown by appends, and features made once for a configuration."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("value"))
    grown, made = scratch(spark), scratch(spark)
    for part in (0, 1):
        st.append_cache(e.where(F.col("key") % 2 == part), grown)
    cached = st.read_result(spark, grown)
    first = st.feature_pyramid(spark, made, {"levels": 2}, lambda: cached)
    again = st.feature_pyramid(spark, made, {"levels": 2}, lambda: cached.limit(0))  # found: not made again
    return first_wins([first.select("key", "value"), again.select("key", "value")], "key")


@query("SELECT DISTINCT o_orderpriority AS method, o_orderstatus AS category FROM orders")
def nested_values(spark, sf_dir):
    """a path taken out of nested maps: all cells of method and category."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.collect_set("o_orderstatus").alias("c"))
    nested = {r[0]: {"cells": {"categories": sorted(r[1])}} for r in o.limit(1000).collect()} | {"none": {"cells": {}}}  # configurations are small
    rows = [(m, c) for m, cs in config.extract_nested(nested, "cells.categories").items() for c in cs]
    return spark.createDataFrame(rows, "method string, category string")
