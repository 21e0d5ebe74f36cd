"""Components that users add, each driven through its interface."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..operators import transform as tr
from ..plans import components as co
from ..plans import estimators as es
from .base import registrar, table
from .learning import LABELS, LLOYD, ROUNDS, _samples

ALL, query = registrar()


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings")
def transform_components(spark, sf_dir):
    """Identity, and all principal components turned back, by create and apply."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    same, turn = co.IdentityTransform(), co.PrincipalComponents()
    s = same.apply(s, same.create(s))
    model = turn.create(s)
    back = [F.lit(row[0]) for row in model["components"]]  # first component of each axis
    first = sum((F.col("vector")[i] * c for i, c in enumerate(back)), F.lit(model["mean"][0]))
    return turn.apply(s, model).select("vec_id", F.round(first, 6).alias("x"))


@query(LLOYD + f", d AS (SELECT x.uid, x.sample, c.cluster, list_distance(x.v, c.v) AS d FROM x0 x JOIN c{ROUNDS} c ON c.uid = x.uid), w AS (SELECT uid, sample, cluster, round(d / sum(d) OVER (PARTITION BY uid, sample), 6) AS weight FROM d) SELECT uid, sample, cluster::INTEGER AS cluster, weight FROM w JOIN (SELECT uid, sample, cluster FROM {LABELS}) USING (uid, sample, cluster)")
def clustering_components(spark, sf_dir):
    """Cluster, hard and soft classifier; the weight of each sample's own cluster."""
    method = co.KMeans(3, ROUNDS)
    p = method.prepare(_samples(spark, sf_dir))
    c = method.cluster(p)
    hard, soft = method.hard_classifier(p, c).select("uid", "sample", "cluster"), method.soft_classifier(p, c)
    j = hard.join(soft, ["uid", "sample", "cluster"])
    return j.select("uid", "sample", F.col("cluster").cast("int").alias("cluster"), F.round("weight", 6).alias("weight"))


@query("""SELECT n_nationkey AS n, i + n_nationkey AS index, round(2 * cos(asin(2.0 * i / (2 * n_nationkey + 1))) * cos(2 * pi() * i * ((1 + sqrt(5)) / 2 - 1)), 6) + 0 AS x, round(2 * sin(asin(2.0 * i / (2 * n_nationkey + 1))), 6) + 0 AS y
FROM (SELECT n_nationkey, unnest(range(-n_nationkey, n_nationkey + 1)) AS i FROM nation)""")
def generated_points(spark, sf_dir):
    """A generator as a table function, called for each row of a table."""
    co.register_generators(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("__vantage_nation")
    return spark.sql("SELECT n_nationkey AS n, index, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM __vantage_nation, LATERAL spiral_points(n_nationkey, 2.0D)")


@query("SELECT label::BIGINT AS uid, (vec_id % 3)::INTEGER AS cluster, arg_max(vec_id, (round(embedding[1]::DOUBLE, 9), -vec_id)) AS view FROM embeddings GROUP BY ALL")
def selected_by_function(spark, sf_dir):
    """A user's selection, on the views of each cluster."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("label").cast("long").alias("uid"), (F.col("vec_id") % 3).cast("int").alias("cluster"), F.col("vec_id").alias("view"), F.round(F.col("embedding")[0].cast("double"), 9).alias("score"))
    return co.select_views(v, lambda pdf: pdf["view"][pdf["score"] == pdf["score"].max()].head(1))


@query("SELECT doc_id, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 'z', '')) AS z FROM documents")
def encoded_texts(spark, sf_dir):
    """An encoder of one's own, in batches."""
    d = table(spark, sf_dir, "documents").select("doc_id", co.encoded("text", co.LetterEncoder()).alias("v"))
    return d.select("doc_id", *(F.col("v")[ord(c) - 97].cast("long").alias(c) for c in "aez"))


@query("SELECT 'documents' AS stage, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents")
def stage_hook(spark, sf_dir):
    """A hook that gets a stage's measures after it ran."""
    got: list[tuple] = []
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out, done = co.with_hook(d, "documents", lambda stage, m: got.append((stage, m["rows"], m["chars"])), chars=F.sum("n_chars"))
    out.write.parquet(scratch(spark))
    done()
    return spark.createDataFrame(got, "stage string, rows long, chars long")


@query("SELECT count(*) AS n, 0.0 AS mx, 0.0 AS my FROM embeddings")
def projected_samples(spark, sf_dir):
    """Samples on two axes; both are centred."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    p = co.projection(s)
    return p.agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("x"), 6) + 0.0).alias("mx"), (F.round(F.avg("y"), 6) + 0.0).alias("my"))


#: Principal components of two columns in closed form: the angle of the first axis, signs by the largest entry.
AXES = """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM e),
t AS (SELECT *, 0.5 * atan2(2 * b, a - c) AS t, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2 FROM m),
g AS (SELECT *, CASE WHEN (CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END) < 0 THEN -1 ELSE 1 END AS g1,
  CASE WHEN (CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sin(t) ELSE cos(t) END) < 0 THEN -1 ELSE 1 END AS g2 FROM t)"""


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("vector"))


def _kept(spark, stage):
    """The stage written and read back."""
    path = scratch(spark)
    stage.write().save(path)
    return type(stage).load(path)


@query(AXES + " SELECT vec_id, round(g1 * ((x - mx) * cos(t) + (y - my) * sin(t)), 6) + 0 AS first, round(g2 * ((y - my) * cos(t) - (x - mx) * sin(t)), 6) + 0 AS second FROM e, g")
def fitted_projection(spark, sf_dir):
    """A pipeline's stage, saved before and after it was fitted; projections against the closed form."""
    s = _pairs(spark, sf_dir)
    model = _kept(spark, _kept(spark, Pipeline(stages=[es.Projection(k=2)])).fit(s))
    p = model.transform(s)
    return p.select("vec_id", *((F.round(F.col("projected")[i], 6) + 0.0).alias(name) for i, name in enumerate(("first", "second"))))


@query(AXES + " SELECT 0 AS component, round(l1 / (l1 + l2), 6) AS ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM t UNION ALL SELECT 1, round(l2 / (l1 + l2), 6), 1.0::DOUBLE FROM t")
def explained_shares(spark, sf_dir):
    """The share of every component and their running sum."""
    model = es.Projection(variance=1.0).fit(_pairs(spark, sf_dir))
    return tr.explained_variance(model.parameters, spark).select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


@query(LLOYD + f" SELECT sample AS vec_id, uid AS label, cluster::INTEGER AS cluster, round(d, 6) AS distance FROM {LABELS}")
def fitted_clusters(spark, sf_dir):
    """Clusters of all items as an estimator; the model is saved and read back before it assigns."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    model = es.ItemKMeans(3, ROUNDS, inputCol="embedding", itemCol="label", sampleCol="vec_id").fit(e)
    out = _kept(spark, model).transform(e)
    return out.select("vec_id", "label", F.col("cluster").cast("int").alias("cluster"), F.round("distance", 6).alias("distance"))
