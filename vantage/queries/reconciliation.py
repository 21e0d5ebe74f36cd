"""Reconciliation, caching, priorities and configuration differences; index validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import joins as jo
from ..plans import config, stages
from ..sources import tables as st
from .base import registrar, table

ALL, query = registrar()


def _expected_actual(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sc.sha256_content("text").alias("sha256"), "lang", "source")
    a = d.where("source <> 'src7'").withColumn("sha256", F.when(F.col("lang") == "es", F.lit("x")).otherwise(F.col("sha256")))
    return d.where("source <> 'src9'"), a


@query("""WITH d AS (SELECT doc_id AS id, sha256(text) AS h, lang, source FROM documents), e AS (SELECT * FROM d WHERE source <> 'src9'),
a AS (SELECT id, CASE WHEN lang = 'es' THEN 'x' ELSE h END AS h FROM d WHERE source <> 'src7')
SELECT coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'new' WHEN e.h = a.h THEN 'found' ELSE 'modified' END AS status FROM e FULL JOIN a ON e.id = a.id""")
def reconciled_files(spark, sf_dir):
    """J10, J11."""
    return jo.reconcile(*_expected_actual(spark, sf_dir), "id", "sha256").select("id", "status")


@query("SELECT doc_id AS id, lang <> 'fr' AS present FROM documents")
def present_or_not(spark, sf_dir):
    """A status instead of a path for what is not there."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return jo.split_present(d.select("id"), d.where("lang <> 'fr'"), "id")


@query("""WITH a AS (SELECT o_custkey AS k, 1 AS p, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, 2 AS p, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
c AS (SELECT c_custkey AS k, 3 AS p, 0 AS v FROM customer), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM u) WHERE n = 1""")
def first_readable_input(spark, sf_dir):
    """The first input that has a key wins."""
    o = table(spark, sf_dir, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v"))
    return jo.first_wins([part("F"), part("O"), c], "k")


@query("SELECT k, v FROM (SELECT s_nationkey AS k, max(s_suppkey) AS v FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, -1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier))")
def later_overrides_earlier(spark, sf_dir):
    """S25, U8."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("v"))
    return jo.last_wins([n, s], "k")


@query("SELECT vec_id AS key, CASE WHEN label NOT IN (0, 3, 6) AND label <> 5 THEN label END AS value FROM embeddings")
def cached_embeddings(spark, sf_dir):
    """A hit needs the key and all three hashes."""
    e = table(spark, sf_dir, "embeddings")
    hashes = [F.sha1(F.col("vec_id").cast("string").cast("binary")).alias(h) for h in ("config_hash", "object_hash")]
    wanted = e.select(F.col("vec_id").alias("key"), *hashes, F.sha1(F.lit("data").cast("binary")).alias("data_hash"))
    stale = F.when(F.col("value") == 5, F.lit("old")).otherwise(F.col("data_hash"))
    cache = wanted.join(e.select(F.col("vec_id").alias("key"), F.col("label").alias("value")), "key").where("value NOT IN (0, 3, 6)").withColumn("data_hash", stale)
    return jo.cached_values(wanted, cache).select("key", "value")


@query("SELECT * FROM (VALUES ('a.c', 'missing'), ('b', 'changed'), ('d', 'unknown')) t(path, change)")
def config_differences(spark, sf_dir):
    """Nested configurations compared by path."""
    want, have = {"a": {"b": 1, "c": 2}, "b": 3}, {"a": {"b": 1}, "b": 4, "d": 5}
    return jo.compare_configs(config.table(spark, want), config.table(spark, have)).select("path", "change")


@query("SELECT * FROM (VALUES ('a.b', '1'), ('a.c', '2'), ('b', '4'), ('d', '5')) t(path, value)")
def config_with_defaults(spark, sf_dir):
    """F16, S30, R30, X20."""
    data, _ = config.load('{"a": {"b": 1}, "b": 4}', {"a": {"b": 9, "c": 2}, "b": 3})
    return config.table(spark, config.set_path(config.override(data, {"b": None}), "d", 5))


@query("SELECT * FROM (VALUES (2, 'render'), (3, 'sample_positions'), (4, 'train_field')) t(ord, stage)")
def stage_range(spark, sf_dir):
    """F17, F18."""
    wanted = spark.createDataFrame([(s,) for s in stages.between("render", "train_field")], "stage string")
    return stages.stage_table(spark).join(wanted, "stage").select("ord", "stage")


@query("SELECT * FROM (VALUES ('normalize'), ('sample_views'), ('render'), ('sample_positions')) t(needs)")
def stages_before(spark, sf_dir):
    """the transitive test goes by order."""
    s = stages.stage_table(spark)
    at = s.where("stage = 'train_field'").select(F.col("ord").alias("limit_ord"))
    return s.join(F.broadcast(at), F.col("ord") < F.col("limit_ord")).select(F.col("stage").alias("needs"))  # one row


@query("SELECT * FROM (VALUES ('sample_views', false, true), ('normalize', false, false), ('render', false, true), ('sample_positions', false, false), ('train_field', false, true), ('sample_embeddings', false, false), ('transform', false, true), ('cluster', true, false), ('select', true, false)) t(stage, run, load)")
def stages_to_run(spark, sf_dir):
    """F20."""
    todo = stages.select_stages(["select", "cluster"])
    rows = [(s, stages.should_run(s, todo), stages.should_load(s, todo)) for s in stages.ORDER]
    return spark.createDataFrame(rows, "stage string, run boolean, load boolean")


@query("SELECT item, n::INTEGER AS n FROM (SELECT (page_id // 5) AS item, page_id % 5 AS n, max(CASE WHEN contains(url, '?page=2') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id // 5) AS bad FROM pages) WHERE bad = 0")
def validated_index(spark, sf_dir):
    """Views of items all of whose files have the stated hashes."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/r/"), F.floor(F.col("page_id") / 5).cast("string"), F.lit("/"))
    name = (F.col("page_id") % 5).cast("string")
    h = F.sha1(F.col("html").cast("binary"))
    rows = p.select((F.col("page_id") % 5).alias("n"), path.alias("dir"), name.alias("name"), h.alias("h"), F.when(F.col("url").contains("?page=2"), F.lit("bad")).otherwise(h).alias("stated"))
    view = F.struct("n", F.struct(F.concat("name", F.lit(".png")).alias("file"), F.col("stated").alias("sha1")).alias("image"), F.struct(F.concat("name", F.lit(".json")).alias("file"), F.col("h").alias("sha1")).alias("transform"))
    index = rows.groupBy(F.concat("dir", F.lit("index.json")).alias("file")).agg(F.transform(F.array_sort(F.collect_list(view)), lambda v: F.struct(v["image"].alias("image"), v["transform"].alias("transform"))).alias("selected_views"))
    files = rows.select(F.concat("dir", "name", F.lit(".png")).alias("path"), F.col("h").alias("sha1")).union(rows.select(F.concat("dir", "name", F.lit(".json")), "h"))
    v = st.validated_index(index, files)
    return v.select(F.element_at(F.split("file", "/"), -2).cast("long").alias("item"), "n")


@query("SELECT * FROM (VALUES ('kmeans', 2), ('view', 1)) t(slot, value)")
def parsed_method(spark, sf_dir):
    """Z14, R34."""
    m = config.Methods(("kmeans", "view"))
    m.add("kmeans", "two", {"value": 2})
    m.add("view", "best", {"value": 1})
    return spark.createDataFrame([(k, v["value"]) for k, v in m.parse("two.best").items()], "slot string, value int")


@query("SELECT doc_id AS uid, CASE WHEN lang = 'es' THEN 'unknown' WHEN lang = 'en' THEN 'present' ELSE 'download' END AS status FROM documents")
def resolved_objects(spark, sf_dir):
    """Suffix taken off, unknown ids marked, present ones split from those to download."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uid"), "lang")
    wanted = d.select(F.concat("uid", F.lit(".glb")).alias("uid"))
    paths = d.where("lang <> 'es'").select("uid", F.concat(F.lit("glbs/"), "uid").alias("path"))
    r = st.resolve_objects(wanted, paths, d.where("lang = 'en'"))
    return r.select(F.col("uid").cast("long").alias("uid"), "status")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, '{}' AS metadata FROM documents GROUP BY 1")
def metadata_by_kind(spark, sf_dir):
    """Metadata tables with a constant column, an empty one in the union."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("fileType"), "source").withColumn("metadata", F.lit("{}"))
    every = d.unionByName(st.empty_metadata(spark), allowMissingColumns=True)
    return every.groupBy(F.col("fileType").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.first("metadata").alias("metadata"))
