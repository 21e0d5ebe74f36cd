"""Stages of pyspark.ml pipelines: fitted, saved, loaded, applied."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector

from vantage.operators import clustering as cl
from vantage.operators import transform as tr
from vantage.plans.estimators import ItemKMeans, ItemKMeansModel, Projection


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    rows = [(u, i, (rng.normal(size=3) * [3, 1, 0.1] + (i % 2) * 8).tolist()) for u in (1, 2) for i in range(12)]
    return spark.createDataFrame(rows, "uid long, sample long, vector array<double>")


def test_pipeline_saved_and_loaded_equals_the_plain_operators(spark, samples, tmp_path):
    stages = [Projection(k=2), ItemKMeans(2, 3, inputCol="projected")]
    model = Pipeline(stages=stages).fit(samples)
    model.write().save(str(tmp_path / "model"))
    got = PipelineModel.load(str(tmp_path / "model")).transform(samples)
    plain = tr.apply_pca(samples, tr.pca(samples, 2))
    want = {(r["uid"], r["sample"]): r for r in cl.k_means(plain, 2, 3)[1].collect()}
    vectors = {(r["uid"], r["sample"]): r["vector"] for r in plain.collect()}
    rows = got.collect()
    assert got.columns == [*samples.columns, "projected", "cluster", "distance"] and len(rows) == 24
    for r in rows:
        at = r["uid"], r["sample"]
        assert r["projected"] == pytest.approx(vectors[at], abs=1e-9)
        assert (r["cluster"], pytest.approx(r["distance"], abs=1e-6)) == (want[at]["cluster"], want[at]["distance"])


def test_ml_vectors_params_nulls_and_unknown_items(spark, samples, tmp_path):
    ml = samples.withColumn("vector", array_to_vector("vector"))
    a, b = (Projection(variance=0.9, normalize=True).fit(x) for x in (samples, ml))
    assert a.parameters["components"] == b.parameters["components"] and sum(a.parameters["explained"]) >= 0.9
    assert all(abs(np.linalg.norm(r["projected"]) - 1) < 1e-9 for r in b.transform(ml).collect())
    model = ItemKMeans(2, 2, predictionCol="part").fit(samples)
    model.write().save(str(tmp_path / "k"))
    back = ItemKMeansModel.load(str(tmp_path / "k"))
    assert back.uid == model.uid and back.getPredictionCol() == "part"
    more = spark.createDataFrame([(1, 99, None), (7, 0, [1.0, 2.0, 3.0]), (2, 50, [0.0, 0.0, 0.0])], samples.schema)
    got = {r["sample"]: (r["part"], r["distance"]) for r in back.transform(more).collect()}
    assert got[99] == got[0] == (None, None) and got[50][0] in (0, 1)
