"""Embedding transforms: identity with a dimension check, and principal components by a distributed Gram sum."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import as_double, l2_normalize, total


def identity(samples: DataFrame, dim: int) -> DataFrame:
    """samples; fails at run time if a vector has another length."""
    return samples.where(F.coalesce(F.when(F.size("vector") == dim, F.lit(True)), F.raise_error(F.lit(f"expected {dim} components")).cast("boolean")))


def covariance(samples: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population covariance, rows): each batch gives its sums, so only d x d numbers a partition move."""

    def sums(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), float)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    rows = samples.select(as_double(vector).alias("v")).where("v IS NOT NULL").mapInPandas(sums, "n long, s array<double>, g array<double>")
    rows = cut(rows)  # read three times
    plus = lambda name: rows.select(F.posexplode(name).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").toPandas()["x"].to_numpy()
    n = rows.agg(F.sum("n")).collect()[0][0] or 0
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0
    mean = plus("s") / n
    return mean, plus("g").reshape(len(mean), -1) / n - np.outer(mean, mean), n


def pca(samples: DataFrame, k: int | None = None, variance: float | None = None) -> dict:
    """mean, components (k x d, largest first, the largest entry of each positive), explained (ratios).

    k components, or the fewest that explain `variance` of the whole."""
    mean, cov, _ = covariance(samples)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    vectors = vectors * np.where(signs == 0, 1, signs)[:, None]
    ratios = values / max(values.sum(), 1e-300)
    if variance is not None:
        k = int(np.searchsorted(np.cumsum(ratios), variance - 1e-12) + 1)
    k = min(k or len(values), len(values))
    return {"mean": mean.tolist(), "components": vectors[:k].tolist(), "explained": ratios[:k].tolist()}


def explained_variance(model: dict, spark) -> DataFrame:
    """(component, ratio, cumulative)."""
    rows = zip(range(len(model["explained"])), model["explained"], np.cumsum(model["explained"]).tolist(), strict=True)
    return spark.createDataFrame(list(rows), "component int, ratio double, cumulative double")


def projected(vector: Column, model: dict, normalize: bool = False) -> Column:
    """The centred projection of a vector on the model's components."""
    mean = F.from_json(F.lit(json.dumps(model["mean"])), "array<double>")
    rows = F.from_json(F.lit(json.dumps(model["components"])), "array<array<double>>")
    centred = F.zip_with(vector, mean, lambda a, b: a - b)
    out = F.transform(rows, lambda row: total(F.zip_with(centred, row, lambda a, b: a * b)))
    out = F.when(vector.isNotNull(), out)
    return l2_normalize(out) if normalize else out


def apply_pca(samples: DataFrame, model: dict, normalize: bool = False) -> DataFrame:
    """samples with vector replaced by its centred projection."""
    return samples.withColumn("vector", as_double("vector")).withColumn("vector", projected(F.col("vector"), model, normalize))
