"""Readers and writers of the pipeline's files as DataFrames: typed JSON layouts, metadata tables, indexes, caches.

All paths are read by Spark's readers, so any file system that Spark reaches will do.  Malformed files give no rows
where the original skips them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.dataset import ranked

VECTORS = "array<array<double>>"
CAMERAS = "camera_model string, fl_x double, fl_y double, cx double, cy double, w int, h int, frames array<struct<file_path string, transform_matrix array<array<double>>>>"
METADATA = "fileIdentifier string, license string, source string, fileType string, sha256 string, metadata string"
INDEX = "selected_views array<struct<image struct<file string, sha1 string>, transform struct<file string, sha1 string>>>"
ELBOW = "ks array<int>, ds array<double>, pred_k int, pred_k_d double, pred_frac_k double, pred_frac_k_d double"
CLUSTERS = "parameters struct<centroids array<array<double>>, normalization array<double>, input_centroids array<array<double>>>, indices array<int>"
VIEWS = "index int, transform array<array<double>>, path string"
SERIES = "step int, value double"
SOLUTION = "indices array<array<int>>, centers array<array<double>>, score double"
#: What an x-means run keeps: a score each time centers were improved; clusters before and after each round of splits,
#: with the scores of what was split; and every clustering that was scored as a whole.
TRACE = (
    "improve_parameters_count int, improve_structure_count int, iterations_global_scores array<double>, "
    "iterations_pre_split_clusters array<int>, iterations_post_split_clusters array<int>, "
    "iterations_local_pre_split_scores array<array<double>>, iterations_local_post_split_scores array<array<double>>, "
    "clusters_iterations array<int>, clusters_global_scores array<double>, "
    "clusters_indices array<array<array<int>>>, clusters_centers array<array<array<double>>>"
)
#: Shards that are named to the reader one by one.
NAMED_SHARDS = 100_000
LISTING = "sha256 string, fileIdentifier string"


#: Items of a data set that one record of its cache holds at most.
CACHE_ITEMS = 50_000


def _json(spark: SparkSession, path, schema: str) -> DataFrame:
    """Whole-file JSON with column file; records that do not parse are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.col("_metadata.file_path"))


def item_of(file="file", levels: int = 2):
    """The item's directory name: so many levels above the file's name."""
    return F.element_at(F.split(file, "/"), -levels)


# --- metadata tables ------------------------------------------------------------------------------------------------


def annotations(spark: SparkSession, path, uids: DataFrame | None = None, shards: DataFrame | None = None) -> DataFrame:
    """(uid, annotation JSON) of gzip or plain JSON maps uid -> object.

    With shards (uid, shard), only the files of the wanted uids' shards are read: up to NAMED_SHARDS are named to the
    reader; of more, all files are read and joined with the wanted ones.  Without wanted shards there are no rows."""
    wanted = names = None
    if shards is not None and uids is not None:
        wanted = shards.join(uids, "uid", "left_semi").select("shard").distinct()
        names = [r["shard"] for r in wanted.limit(NAMED_SHARDS + 1).collect()]
        if not names:
            return spark.createDataFrame([], "uid string, annotation string")
        if len(names) <= NAMED_SHARDS:
            wanted, path = None, [f"{path.rstrip('/')}/{s}" for s in names]
    rows = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    if wanted is not None:
        w = wanted.select("shard", item_of("shard", 1).alias("shard_name"))
        rows = rows.join(w, (item_of("file", 1) == F.col("shard_name")) & F.col("file").endswith(F.concat(F.lit("/"), "shard")), "left_semi")
    rows = rows.select(F.explode(F.from_json("value", "map<string, string>")).alias("uid", "annotation"))
    return rows.join(uids.select("uid"), "uid", "left_semi") if uids is not None else rows


def object_paths(spark: SparkSession, path) -> DataFrame:
    """(uid, path) of a JSON map."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string, string>")).alias("uid", "path"))


def category_items(spark: SparkSession, path) -> DataFrame:
    """(category, pos, uid) of JSON maps category -> list of uids; a list may be in pieces, in folders start=N by the
    place of their first uid."""
    m = spark.read.option("wholetext", True).text(path)
    start = F.col("start").cast("int") if "start" in m.columns else F.lit(0)
    m = m.select(start.alias("start"), F.explode(F.from_json("value", "map<string, array<string>>")).alias("category", "uids"))
    return m.select("start", "category", F.posexplode("uids").alias("pos", "uid")).select("category", (F.col("pos") + F.col("start")).alias("pos"), "uid")


def metadata(spark: SparkSession, path, constant_metadata: bool = False) -> DataFrame:
    """A metadata table in Parquet; constant_metadata gives tables without that column the empty object."""
    df = spark.read.parquet(path)
    return df.withColumn("metadata", F.lit("{}")) if constant_metadata else df


def x_means_solutions(spark: SparkSession, path) -> DataFrame:
    """(file, cluster, indices, center, k, score): the solution of each x-means run, a row a cluster."""
    rows = _json(spark, path, SOLUTION).select("file", "score", F.size("centers").alias("k"), F.posexplode(F.arrays_zip("indices", "centers")).alias("cluster", "c"))
    return rows.select("file", "cluster", F.col("c.indices").alias("indices"), F.col("c.centers").alias("center"), "k", "score")


def x_means_data(spark: SparkSession, path) -> DataFrame:
    """(file, n, iteration, score, k, indices, centers): the clusterings that a run scored as a whole, in order."""
    rows = _json(spark, path, TRACE)
    zipped = F.arrays_zip(*(F.col(f"clusters_{c}").alias(c) for c in ("iterations", "global_scores", "indices", "centers")))
    rows = rows.select("file", F.posexplode(zipped).alias("n", "c"))
    return rows.select("file", "n", F.col("c.iterations").alias("iteration"), F.col("c.global_scores").alias("score"), F.size("c.centers").alias("k"), F.col("c.indices").alias("indices"), F.col("c.centers").alias("centers"))


def x_means_iterations(spark: SparkSession, path) -> DataFrame:
    """(file, iteration, pre_split, post_split, cluster, before, after): clusters before and after each round of splits; a
    row a cluster that was tried, with its score and that of its two parts, or one without for a round that tried none.

    Parts are listed for clusters that could be split only, so `after` counts those in order."""
    zipped = F.arrays_zip(*(F.col(f"iterations_{c}").alias(n) for c, n in (("pre_split_clusters", "pre"), ("post_split_clusters", "post"), ("local_pre_split_scores", "a"), ("local_post_split_scores", "b"))))
    rows = _json(spark, path, TRACE).select("file", F.posexplode(zipped).alias("iteration", "c"))
    rows = rows.select("file", "iteration", "c.pre", "c.post", F.posexplode_outer(F.arrays_zip(F.col("c.a").alias("a"), F.col("c.b").alias("b"))).alias("cluster", "s"))
    return rows.select("file", "iteration", F.col("pre").alias("pre_split"), F.col("post").alias("post_split"), "cluster", F.col("s.a").alias("before"), F.col("s.b").alias("after"))


def x_means_scores(spark: SparkSession, path) -> DataFrame:
    """(file, n, score): the score of the whole each time a run improved its centers."""
    return _json(spark, path, TRACE).select("file", F.posexplode("iterations_global_scores").alias("n", "score"))


def normalizations(spark: SparkSession, path) -> DataFrame:
    """(file, scale, offset) of each item."""
    return _json(spark, path, "scale array<double>, offset array<double>")


def transform_parameters(spark: SparkSession, path) -> DataFrame:
    """(file, type, parameters JSON): the parameters of each embedding type's transform."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string, struct<parameters: string>>").alias("m"))
    return rows.select("file", F.explode("m").alias("type", "p")).select("file", "type", F.col("p.parameters").alias("parameters"))


def feature_pyramid(spark: SparkSession, path: str, config: dict, create) -> DataFrame:
    """(scale, image, cx, cy, vector): the cached levels of a feature pyramid, one part a scale; made on a miss."""
    return feature_cache(spark, path, config | {"kind": "pyramid"}, create)


def empty_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], METADATA)


def resolve_objects(wanted: DataFrame, paths: DataFrame, present: DataFrame) -> DataFrame:
    """(uid, path, status): the suffix is taken off; unknown uids are marked, others are present or to download."""
    from ..functions.scalars import strip_suffix

    w = wanted.select(strip_suffix("uid").alias("uid")).distinct()
    j = w.join(paths, "uid", "left").join(present.select("uid").distinct().withColumn("__p", F.lit(True)), "uid", "left")
    status = F.when(F.col("path").isNull(), "unknown").when(F.col("__p"), "present").otherwise("download")
    return j.select("uid", "path", status.alias("status"))


# --- stage files ----------------------------------------------------------------------------------------------------


def cameras(spark: SparkSession, path) -> DataFrame:
    """(file, view, path, transform, camera...): frames by their place; relative paths are taken from the file's folder."""
    f = _json(spark, path, CAMERAS)
    f = f.select("file", "fl_x", "fl_y", "cx", "cy", "w", "h", F.posexplode("frames").alias("view", "frame"))
    p = F.col("frame.file_path")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return f.select("file", "view", F.when(p.startswith("/"), p).otherwise(F.concat(folder, F.lit("/"), p)).alias("path"), F.col("frame.transform_matrix").alias("transform"), "fl_x", "fl_y", "cx", "cy", "w", "h")


def positions(spark: SparkSession, path) -> DataFrame:
    """(file, sample, position)."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", VECTORS).alias("p"))
    return rows.select("file", F.posexplode("p").alias("sample", "position"))


def embeddings(spark: SparkSession, path) -> DataFrame:
    """(file, type, is_default, sample, vector)."""
    rows = _json(spark, path, f"type string, dict map<string, {VECTORS}>")
    rows = rows.select("file", F.col("type").alias("__default"), F.explode("dict").alias("type", "vectors"))
    return rows.select("file", "type", (F.col("type") == F.col("__default")).alias("is_default"), F.posexplode("vectors").alias("sample", "vector"))


def clusters(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(file, cluster, vector) and (file, sample, cluster)."""
    rows = _json(spark, path, CLUSTERS)
    return rows.select("file", F.posexplode("parameters.centroids").alias("cluster", "vector")), rows.select("file", F.posexplode("indices").alias("sample", "cluster"))


def selected_views(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, VIEWS)


def elbows(spark: SparkSession, path) -> DataFrame:
    """(file, k, d, pred_k, ...): a row a point of the curve."""
    rows = _json(spark, path, ELBOW).select("*", F.explode(F.arrays_zip("ks", "ds")).alias("p"))
    return rows.select("file", F.col("p.ks").alias("k"), F.col("p.ds").alias("d"), "pred_k", "pred_k_d", "pred_frac_k", "pred_frac_k_d")


def series(spark: SparkSession, path) -> DataFrame:
    """(file, metric, step, value); the metric is the file's name."""
    rows = _json(spark, path, SERIES)
    return rows.withColumn("metric", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", ""))


def file_hashes(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, LISTING)


def listing(spark: SparkSession, path, pattern: str | None = None, content: bool = False) -> DataFrame:
    """(path, name, length[, content, sha1]) of files whose name matches the pattern."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1))
    df = df.where(F.col("name").rlike(pattern)) if pattern else df
    return df.select("path", "name", "length", "content", F.sha1("content").alias("sha1")) if content else df.select("path", "name", "length")


def validated_index(index: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """(file, image, transform) of an index whose files exist with the hashes it states.

    Items with any other view are left out whole, or an error if strict.  files: (path, sha1)."""
    folder = F.regexp_replace("file", "/[^/]*$", "/")
    v = index.select("file", F.posexplode("selected_views").alias("n", "v"))
    v = v.select("file", "n", F.concat(folder, F.col("v.image.file")).alias("image"), F.col("v.image.sha1").alias("image_sha1"), F.concat(folder, F.col("v.transform.file")).alias("transform"), F.col("v.transform.sha1").alias("transform_sha1"))
    for c in ("image", "transform"):
        v = v.join(files.select(F.col("path").alias(c), F.col("sha1").alias(f"__{c}")), c, "left")
    ok = F.coalesce((F.col("__image") == F.col("image_sha1")) & (F.col("__transform") == F.col("transform_sha1")), F.lit(False))
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("index does not match: "), F.col("file"))).cast("boolean"))
    bad = v.where(~ok).select("file").distinct()
    return v.where(ok).join(bad, "file", "left_anti").select("file", "n", "image", "transform")


def read_index(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, INDEX)


# --- sinks ----------------------------------------------------------------------------------------------------------


def write_index(images: DataFrame, path: str) -> None:
    """A JSON file an item, in a folder of its uid, of images (uid, n, image, image_sha1, transform, transform_sha1); the writer's _SUCCESS
    file is the commit mark. An image without its transform is an error."""
    ok = F.when(F.col("transform").isNotNull() & F.col("image").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("image without transform")).cast("boolean"))
    view = F.struct("n", F.struct(F.col("image").alias("file"), F.col("image_sha1").alias("sha1")).alias("image"), F.struct(F.col("transform").alias("file"), F.col("transform_sha1").alias("sha1")).alias("transform"))
    rows = images.where(ok).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(view)), lambda v: F.struct(v["image"].alias("image"), v["transform"].alias("transform"))).alias("selected_views"))
    rows.write.mode("overwrite").partitionBy("uid").json(path)


def cameras_json(views: DataFrame, focal_x: float, focal_y: float, width: int, height: int) -> DataFrame:
    """(uid, json): the camera file of each item's views (uid, view, transform), frames named by number."""
    from ..functions.scalars import frame_name

    frame = F.struct("view", F.struct(frame_name("view").alias("file_path"), F.col("transform").alias("transform_matrix")).alias("f"))
    rows = views.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(frame)), lambda v: v["f"]).alias("frames"))
    head = [F.lit("OPENCV").alias("camera_model"), F.lit(focal_x).alias("fl_x"), F.lit(focal_y).alias("fl_y"), F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), F.lit(width).alias("w"), F.lit(height).alias("h")]
    return rows.select("uid", F.to_json(F.struct(*head, "frames")).alias("json"))


def _listed(df: DataFrame, key: str, order: str, value, name: str) -> DataFrame:
    """(key, name): the values of a key in order; an item's file holds them all, so they meet in its record."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name))


def x_means_solution_json(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """(uid, json) of clusters (uid, cluster, indices, center) and scores (uid, score)."""
    c = _listed(clusters, "uid", "cluster", F.struct("indices", "center"), "c").join(scores, "uid")
    return c.select("uid", F.to_json(F.struct(F.col("c.indices").alias("indices"), F.col("c.center").alias("centers"), "score")).alias("json"))


def x_means_data_json(scores: DataFrame, iterations: DataFrame, clusterings: DataFrame) -> DataFrame:
    """(uid, json) of scores (uid, n, score), iterations (uid, iteration, pre_split, post_split, before, after; the last
    two arrays) and clusterings (uid, n, iteration, score, indices, centers)."""
    s = _listed(scores, "uid", "n", F.col("score"), "s")
    i = _listed(iterations, "uid", "iteration", F.struct("pre_split", "post_split", "before", "after"), "i")
    c = _listed(clusterings, "uid", "n", F.struct("iteration", "score", "indices", "centers"), "c")
    fields = [
        F.size("s").alias("improve_parameters_count"), F.size("i").alias("improve_structure_count"), F.col("s").alias("iterations_global_scores"),
        F.col("i.pre_split").alias("iterations_pre_split_clusters"), F.col("i.post_split").alias("iterations_post_split_clusters"),
        F.col("i.before").alias("iterations_local_pre_split_scores"), F.col("i.after").alias("iterations_local_post_split_scores"),
        F.col("c.iteration").alias("clusters_iterations"), F.col("c.score").alias("clusters_global_scores"), F.col("c.indices").alias("clusters_indices"), F.col("c.centers").alias("clusters_centers"),
    ]
    return s.join(i, "uid").join(c, "uid").select("uid", F.to_json(F.struct(*fields)).alias("json"))


def normalization_json(rows: DataFrame) -> DataFrame:
    """(uid, json) of rows (uid, scale, offset)."""
    return rows.select("uid", F.to_json(F.struct("scale", "offset")).alias("json"))


def transform_json(rows: DataFrame) -> DataFrame:
    """(uid, json) of rows (uid, type, parameters): parameters are the JSON of an object."""
    g = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("type", "parameters"))).alias("r"))
    entry = F.transform("r", lambda x: F.struct(x["type"], F.struct(F.parse_json(x["parameters"]).alias("parameters"))))
    return g.select("uid", F.to_json(F.map_from_entries(entry)).alias("json"))


def clusters_json(assigned: DataFrame, parameters: DataFrame) -> DataFrame:
    """(uid, json) of assigned (uid, sample, cluster) and parameters (uid, and an array column each); a parameter that is
    null is left out of the file."""
    names = [c for c in parameters.columns if c != "uid"]
    c = _listed(assigned, "uid", "sample", F.col("cluster"), "indices").join(parameters, "uid")
    return c.select("uid", F.to_json(F.struct(F.struct(*names).alias("parameters"), "indices")).alias("json"))


def selected_views_json(views: DataFrame) -> DataFrame:
    """(uid, json) of views (uid, n, index, transform, path) in order of n; a view without a path is an error."""
    path = F.coalesce("path", F.raise_error(F.concat(F.lit("view without path: "), F.col("index").cast("string"))).cast("string"))
    v = _listed(views, "uid", "n", F.struct("index", "transform", path.alias("path")), "v")
    return v.select("uid", F.to_json("v").alias("json"))


def write_item_files(records: DataFrame, path: str) -> None:
    """A file an item of records (uid, json), in a folder of its uid."""
    records.select("uid", F.col("json").alias("value")).write.mode("overwrite").partitionBy("uid").text(path)


def uid_of(file="file"):
    """The uid of a file that write_item_files has written."""
    return F.regexp_extract(file, "uid=([^/]+)/", 1)


def write_stage(df: DataFrame, path: str, key: str = "uid") -> None:
    """A stage's table, one folder a key."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_cache(df: DataFrame, path: str) -> None:
    """Adds (key, config_hash, object_hash, data_hash, value) rows to a cache table."""
    df.write.mode("append").parquet(path)


def dataset_cache(spark: SparkSession, path: str, categories: list[str] | None = None, uids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(category, pos, uid, path) of a cached data set; no rows if it was made with other filters."""
    schema = "dataset map<string, array<string>>, uid_to_file map<string, string>, categories array<string>, uids array<string>, per_category_limit int, starts map<string, int>"
    c = _json(spark, path, schema)
    same = lambda col, want: F.array_sort(F.coalesce(col, F.array().cast("array<string>"))) == F.array_sort(F.array(*map(F.lit, want or [])).cast("array<string>"))
    c = c.where(same(F.col("categories"), categories) & same(F.col("uids"), uids) & F.col("per_category_limit").eqNullSafe(F.lit(limit).cast("int")))
    rows = c.select("file", "starts", F.explode("dataset").alias("category", "list"))
    rows = rows.select("file", "category", F.coalesce(F.col("starts")[F.col("category")], F.lit(0)).alias("start"), F.posexplode("list").alias("pos", "uid"))
    # by a join: to look each uid up in its record's map takes the square of their number
    paths = c.select("file", F.explode("uid_to_file").alias("uid", "path"))
    return rows.join(paths, ["file", "uid"], "left").select("category", (F.col("pos") + F.col("start")).alias("pos"), "uid", "path")


def write_dataset_cache(items: DataFrame, path: str, categories: list[str] | None = None, uids: list[str] | None = None, limit: int | None = None) -> None:
    """A data set (category, pos, uid, path) as JSON records with its filters, a file each: one for up to CACHE_ITEMS items,
    more above.  Records of a longer set also tell at which place in each category they start."""
    order = ranked(items.select("category", "pos", "uid", "path"), ["category"], [F.col("pos"), F.col("uid")]).withColumnRenamed("rank", "place")
    order = ranked(order, [], [F.col("category"), F.col("place")])
    order = cut(order.withColumn("record", F.floor((F.col("rank") - 1) / CACHE_ITEMS)))
    lists = order.groupBy("record", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "uid"))), lambda s: s["uid"]).alias("list"), (F.min("place") - 1).cast("int").alias("start"))
    later = F.map_from_entries(F.collect_list(F.struct("category", "start")))
    d = lists.groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct("category", "list"))).alias("dataset"), F.when(F.max("start") > 0, later).alias("starts"))
    f = order.select("record", "uid", "path").distinct().groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct("uid", "path"))).alias("uid_to_file"))
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if x else F.lit(None).cast("array<string>")
    row = d.join(f, "record").drop("record").withColumns({"categories": arr(categories), "uids": arr(uids), "per_category_limit": F.lit(limit).cast("int")})
    row.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def feature_cache(spark: SparkSession, path: str, config: dict, create, delete_stale: bool = True) -> DataFrame:
    """The table cached under path for this configuration (compared as JSON, part of the path); made and saved on a miss.

    delete_stale drops what other configurations left, by an overwrite of the whole path."""
    import hashlib
    import json

    key = hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()  # noqa: S324
    part = f"{path.rstrip('/')}/config={key}"
    try:
        return spark.read.parquet(part)
    except Exception as e:  # AnalysisException: the path does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
    made = create().withColumn("config", F.lit(key))
    made.write.mode("overwrite" if delete_stale else "append").partitionBy("config").parquet(path)
    return spark.read.parquet(part)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def rebuild_index(images: DataFrame, transforms: DataFrame) -> DataFrame:
    """(uid, name, image, transform) joined by name; an image without a transform is an error, empty items go."""
    j = images.select("uid", "name", F.col("path").alias("image")).join(transforms.select("uid", "name", F.col("path").alias("transform")), ["uid", "name"], "left")
    return j.withColumn("transform", F.coalesce("transform", F.raise_error(F.concat(F.lit("no transform for "), F.col("image"))).cast("string")))
