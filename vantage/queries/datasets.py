"""Data-set preparation over the star-schema tables: filters, limits, samples, set operations, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import dataset as ds
from ..operators import joins as jo
from ..operators import sampling as sa
from ..plans import digests as dg
from .base import ITEMS, items, registrar, table

ALL, query = registrar()


def _u(key: str) -> str:
    """The seeded uniform in SQL."""
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


@query("WITH i AS (SELECT p_partkey AS uid, p_brand AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 10) AND p_size > 15) SELECT uid, category FROM i WHERE n <= 4")
def filtered_items(spark, sf_dir):
    """F1, F6, W5, T2 limits: categories, uids, first n of each category."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("pos"), "p_size")
    cats = ds.categories_of_size(p, 11).select("category")
    return ds.filter_items(p, cats, p.where("p_size > 15"), 4).select("uid", "category")


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 12")
def categories_of_size(spark, sf_dir):
    """F3."""
    return ds.categories_of_size(table(spark, sf_dir, "part").withColumnRenamed("p_type", "category"), 12)


@query(f"WITH s AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_u(chr(39) + 's1/' + chr(39) + ' || c_mktsegment || ' + chr(39) + '|' + chr(39) + ' || c_custkey')}, c_custkey) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM s WHERE n <= 10")
def stratified_sample(spark, sf_dir):
    """Exactly n of each category, in order of a seeded hash."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ds.seeded_sample(c, ["c_mktsegment"], "c_custkey", 10, "s1", exact=True)


@query(f"SELECT s_suppkey FROM supplier ORDER BY {_u(chr(39) + 's2|' + chr(39) + ' || s_suppkey')}, s_suppkey LIMIT 7")
def seeded_limit(spark, sf_dir):
    """T8, T7, R23."""
    return ds.sample_limit(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 7, "s2")


@query(f"""WITH v AS (SELECT l_orderkey AS uid, l_linenumber AS view, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
n AS (SELECT DISTINCT uid, 1 + uid % 3 AS n FROM v),
r AS (SELECT v.uid, v.view, n.n, row_number() OVER (PARTITION BY v.uid ORDER BY {_u("'s3/' || v.uid || '|' || v.view")}, v.view) AS r FROM v JOIN n USING (uid) WHERE size >= n.n)
SELECT uid, view FROM r WHERE r <= n""")
def random_views(spark, sf_dir):
    """A given number of views without replacement; items with too few are left out."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("view"))
    n = v.select("uid").distinct().withColumn("n", (1 + F.col("uid") % 3).cast("int"))
    return ds.random_views(v, n, "s3").select("uid", "view")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS batch FROM orders")
def order_batches(spark, sf_dir):
    """Batches of 1000 rows, the last one included."""
    return ds.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT s_name AS name, s_acctbal AS balance, NULL AS segment, 'supplier' AS source_name FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment, 'customer' FROM customer")
def union_of_sources(spark, sf_dir):
    """Union by name with missing columns; a source that is not wanted is not read."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return ds.union_annotations({"supplier": s, "customer": c, "nation": n}, ["supplier", "customer"]).select("name", "balance", "segment", "source_name")


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_of_ids(spark, sf_dir):
    """U2, U7, F2."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def intersection_of_ids(spark, sf_dir):
    """U3, J12."""
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    both = side("F").intersect(side("O"))
    return table(spark, sf_dir, "customer").select("c_custkey").distinct().join(both, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    """What is still to do."""
    from ..plans.stages import unfinished

    return unfinished(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def include_and_exclude(spark, sf_dir):
    """J15."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return jo.include_exclude(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", o.where("o_totalprice > 100000"), o.where("o_orderpriority = '1-URGENT'"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def required_subset(spark, sf_dir):
    """Fails on an unknown key."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    known = o.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return jo.require_subset(known, table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey")


@query("SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def aligned_counts(spark, sf_dir):
    """F10, A15."""
    n = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return jo.align(n, table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", "n", default=0)


@query("SELECT coalesce(r_name, n_name) AS name, count(*) AS n FROM nation LEFT JOIN (SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey GROUP BY 1")
def renamed_keys(spark, sf_dir):
    """A name where there is one, else the key."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), "r_name")
    j = n.join(r, F.col("n_regionkey") == F.col("k"), "left").withColumn("name", sc.display_name("n_name", "r_name"))
    return j.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT part.p_type AS category, 'a photo of a ' || replace(coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, p_type), '_', ' ') || '.' AS prompt, p_partkey FROM part")
def prompts(spark, sf_dir):
    """F7."""
    p = table(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_size") % 2 == 0, F.col("p_name")))
    return p.select(F.col("p_type").alias("category"), sc.prompt("p_type", "name").alias("prompt"), "p_partkey")


@query("SELECT user_id AS uid, last(event_type ORDER BY event_id) AS category FROM events GROUP BY 1")
def last_category(spark, sf_dir):
    """Dataset rule of section 1: a uid in several categories keeps the last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("category"), F.col("event_id").alias("pos"))
    return ds.last_category(e)


@query("SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def categories_of_items(spark, sf_dir):
    """F14, F12."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left_semi").select("n_name").distinct()


@query("SELECT url, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS first, split_part(url, '/', -1) AS last, CASE WHEN starts_with(url, 'https://') THEN 'http://' || substr(url, 9) ELSE url END AS plain, lower(url) LIKE '%.obj' OR lower(url) LIKE '%.glb' AS is_object, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages")
def url_parts(spark, sf_dir):
    """X10 to X13, F22."""
    p = table(spark, sf_dir, "pages")
    return p.select("url", sc.path_part("url", 2).alias("host"), sc.path_part("url", 3).alias("first"), sc.last_part("url").alias("last"), sc.replace_prefix("url", "https://", "http://").alias("plain"), sc.is_object_file("url", (".obj", ".glb")).alias("is_object"), sc.query_value("url", "page").alias("page"))


@query("SELECT p_partkey, sha1(p_name) AS sha1, sha256(p_name) AS sha256, 'prompt_' || sha1(p_name) AS prompt_key, 'frame_' || lpad((p_partkey + 1)::VARCHAR, greatest(5, length((p_partkey + 1)::VARCHAR))::INTEGER, '0') || '.png' AS frame FROM part")
def hashes_and_names(spark, sf_dir):
    """X1 to X3, X8, X9."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sc.sha1_text("p_name").alias("sha1"), sc.sha256_content("p_name").alias("sha256"), sc.prompt_cache_key("p_name").alias("prompt_key"), sc.frame_name("p_partkey").alias("frame"))


@query("WITH h AS (SELECT c_custkey, sha1('seed' || c_name) AS h FROM customer) SELECT c_custkey, (list_sum(list_transform(range(0, 5), lambda i: ('0x' || substr(h, (1 + 8 * i)::INTEGER, 8))::BIGINT)) % 4294967295)::BIGINT AS seed FROM h")
def derived_seeds(spark, sf_dir):
    """X6, X7, G10."""
    return table(spark, sf_dir, "customer").select("c_custkey", sc.derive_seed(F.lit("seed"), "c_name").alias("seed"))


@query(f"SELECT s_suppkey, {_u(chr(39) + 'a|' + chr(39) + ' || s_suppkey')} AS u, 0.5 + 1.5 * {_u(chr(39) + 'b|' + chr(39) + ' || s_suppkey')} AS scale FROM supplier")
def seeded_uniforms(spark, sf_dir):
    """G10, G13."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", sc.uniform(F.lit("a"), "s_suppkey").alias("u"))
    return sa.random_scale(s, 0.5, 2.0, "b", "s_suppkey")


@query(f"""WITH h AS (SELECT p_size AS x, count(*)::DOUBLE AS y FROM part GROUP BY 1), c AS (SELECT x, sum(y) OVER (ORDER BY x) AS hi, sum(y) OVER () AS total FROM h),
d AS (SELECT s_suppkey AS uid, {_u("'g9|' || s_suppkey")} AS u FROM supplier)
SELECT uid, (SELECT min(x) FROM c WHERE hi > u * total) AS x FROM d""")
def discrete_draws(spark, sf_dir):
    """Inversion of a discrete distribution."""
    h = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return sa.discrete_draws(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid")), h, "g9")


@query("WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT p_brand, string_agg(p_type || '=' || k, ';' ORDER BY p_type) AS entries FROM m GROUP BY 1")
def grouped_maps(spark, sf_dir):
    """A24, A17."""
    m = ds.group_map(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey")
    return m.select("p_brand", F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("entries"))


@query("SELECT n_nationkey, min(n_regionkey) AS n_regionkey FROM nation GROUP BY 1")
def one_value_per_key(spark, sf_dir):
    """Fails if a key has several values."""
    return ds.require_one(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query("SELECT count(*) * 9 AS total FROM customer")
def progress_total(spark, sf_dir):
    """A28."""
    from ..plans.stages import ORDER, progress

    return progress(table(spark, sf_dir, "customer"), list(ORDER))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS views FROM lineitem WHERE l_quantity > 5 GROUP BY 1")
def distinct_views_per_item(spark, sf_dir):
    """A4, A16, A6."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("views"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(lag(l_returnflag) OVER w <> l_returnflag, true) AS starts, coalesce(lead(l_returnflag) OVER w <> l_returnflag, true) AS ends FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def change_marks(spark, sf_dir):
    """Where a run of equal values starts and ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce(F.lag(f).over(w) != f, F.lit(True)).alias("starts"), F.coalesce(F.lead(f).over(w) != f, F.lit(True)).alias("ends"))


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_of_kind(spark, sf_dir):
    """W6."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT p_partkey, round(least(greatest(p_size / 50.0, 0.1), 0.9), 6) AS clipped, round(1 + (least(greatest(p_size / 200.0, 0.05), 0.15) - 0.05) / 0.1 * (0.5 - 1), 6) AS stride, round(degrees(2 * atan(tan(radians(60.0) / 2) * p_size / 50)), 6) AS fov, round(0.5 * p_size / tan(0.5 * radians(60.0)), 6) AS focal FROM part")
def camera_scalars(spark, sf_dir):
    """X16 to X18."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(sc.clip(F.col("p_size") / 50.0, 0.1, 0.9), 6).alias("clipped"), F.round(sc.stride_scale(F.col("p_size") / 200.0, 0.5), 6).alias("stride"), F.round(sc.fov_y(F.lit(60.0), F.lit(50.0), "p_size"), 6).alias("fov"), F.round(sc.focal_length(F.lit(60.0), "p_size"), 6).alias("focal"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def scalars_of_json(spark, sf_dir):
    """X19, X20."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select("event_id", sc.to_scalar("k").alias("k"), sc.to_scalar("event_type").alias("none"))


@query("SELECT o_orderkey, round(avg(1 - exp(-l_quantity / 20)), 6) AS opacity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def mean_opacity(spark, sf_dir):
    """X23, R19."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), sc.opacity(F.col("l_quantity") / 20).alias("a"))
    return li.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("o_orderkey").agg(F.round(F.avg("a"), 6).alias("opacity"))


@query(f"WITH {ITEMS}, b AS (SELECT category, string_agg(uid::VARCHAR || chr(0), '' ORDER BY uid::VARCHAR) AS s FROM e GROUP BY 1) SELECT category, sha1(s) AS key FROM b")
def cache_keys(spark, sf_dir):
    """X4, X5."""
    g = items(spark, sf_dir).groupBy("category").agg(F.collect_list(F.col("uid").cast("string")).alias("uids"))
    return g.select("category", sc.cache_key("uids").alias("key"))


@query("WITH h AS (SELECT n_nationkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation) SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (1 + (('0x' || substr(h, 17, 1))::INTEGER & 3))::INTEGER, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h")
def name_based_ids(spark, sf_dir):
    """F21."""
    return table(spark, sf_dir, "nation").select("n_nationkey", sc.uuid5_dns("n_name").alias("id"))


#: A configuration a part, as JSON; equal in all that counts for parts of equal brand and size.
_CONFIG = """'{"_target": "T' || p_partkey || '", "device": {"name": "d' || p_partkey || '"}, "model": {"size": ' || p_size || ', "layers": [{"w": 1}, {"w": ' || p_size || '}], "tags": []}, "brand": "' || p_brand || '"}'"""


@query("""SELECT p_partkey, sha1('.brand="' || p_brand || '"' || chr(10) || '.model.layers[0].w=1' || chr(10) || '.model.layers[1].w=' || p_size || chr(10)
  || '.model.size=' || p_size || chr(10) || '.model.tags=[]' || chr(10)) AS digest FROM part""")
def config_digests(spark, sf_dir):
    """Digests of configurations in JSON: leaves in order of their paths, without what says where they run."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CONFIG).alias("config"))
    return dg.config_digests(p, "p_partkey").select(F.col("key").alias("p_partkey"), "digest")


@query("""WITH h AS (SELECT page_id, sha1('42' || sha1(coalesce(html, ''))) AS h FROM pages)
SELECT page_id, (list_sum(list_transform(range(0, 5), lambda i: ('0x' || substr(h, (1 + 8 * i)::INTEGER, 8))::BIGINT)) % 4294967295)::BIGINT AS seed FROM h""")
def item_seeds(spark, sf_dir):
    """A run's seed and the hash of each item's file make the item's seed."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", dg.item_seed(F.lit(42), F.coalesce("html", F.lit(""))).alias("seed"))
