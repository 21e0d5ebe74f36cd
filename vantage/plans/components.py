"""Components that users add: transforms, clusterings, view generators, view selections, encoders, and stage hooks.

A component is a small class with the methods named here; `config.Methods` finds it by slot and name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..operators import clustering as cl
from ..operators import transform as tr

# --- transforms: create learns parameters from samples, apply uses them ----------------------------------------------


class IdentityTransform:
    def create(self, samples: DataFrame) -> dict:
        """The dimension of the samples; no parameters if there are none."""
        row = samples.select(F.size("vector").alias("n")).limit(1).collect()
        return {"dim": row[0]["n"]} if row else {}

    def apply(self, samples: DataFrame, parameters: dict) -> DataFrame:
        return tr.identity(samples, parameters["dim"]) if parameters else samples


class PrincipalComponents:
    """k components, or the fewest that explain a share of the variance."""

    def __init__(self, k: int | None = None, variance: float | None = None, normalize: bool = False):
        self.k, self.variance, self.normalize = k, variance, normalize

    def create(self, samples: DataFrame) -> dict:
        return tr.pca(samples, self.k, self.variance)

    def apply(self, samples: DataFrame, parameters: dict) -> DataFrame:
        return tr.apply_pca(samples, parameters, self.normalize)


def projection(samples: DataFrame, normalize: bool = False) -> DataFrame:
    """(keys, x, y): the samples on their two first principal components, for charts."""
    component = PrincipalComponents(k=2, normalize=normalize)
    out = component.apply(samples, component.create(samples))
    return out.withColumns({"x": F.col("vector")[0], "y": F.get("vector", F.lit(1))}).drop("vector")


# --- clusterings: cluster finds centroids, the classifiers assign samples to them ------------------------------------


class KMeans:
    def __init__(self, k: int, rounds: int = 10):
        self.k, self.rounds = k, rounds

    def prepare(self, samples: DataFrame) -> DataFrame:
        """Whitened samples: clustering and classifying work on these."""
        return cl.whiten(samples, cl.whitening(samples))

    def cluster(self, prepared: DataFrame) -> DataFrame:
        return cl.lloyd(prepared, cl.first_centroids(prepared, self.k), self.rounds)

    def hard_classifier(self, prepared: DataFrame, centroids: DataFrame) -> DataFrame:
        return cl.nearest(prepared, centroids)

    def soft_classifier(self, prepared: DataFrame, centroids: DataFrame) -> DataFrame:
        return cl.soft_assignment(prepared, centroids)


class LargestKMeans(KMeans):
    """The n largest clusters of k."""

    def __init__(self, k: int, n: int, rounds: int = 10):
        super().__init__(k, rounds)
        self.n = n

    def cluster(self, prepared: DataFrame) -> DataFrame:
        centroids = super().cluster(prepared)
        return cl.largest_clusters(cl.nearest(prepared, centroids), centroids, self.n)


# --- generators as table functions ---------------------------------------------------------------------------------


class SpiralPoints:
    """Rows (index, x, y, z) of 2 n + 1 points spread evenly on a sphere."""

    def eval(self, n: int, radius: float) -> Iterator[tuple[int, float, float, float]]:
        golden = (1 + 5**0.5) / 2
        for i in range(-n, n + 1):
            lat, lon = np.arcsin(2.0 * i / (2 * n + 1)), 2 * np.pi * i * (golden - 1)
            yield i + n, float(radius * np.cos(lat) * np.cos(lon)), float(radius * np.sin(lat)), float(radius * np.cos(lat) * np.sin(lon))


def register_generators(spark: SparkSession) -> None:
    """Makes generators callable in SQL: SELECT * FROM spiral_points(31, 2.0)."""
    spark.udtf.register("spiral_points", F.udtf(SpiralPoints, returnType="index int, x double, y double, z double"))


# --- selections: a function on the views of one item's cluster -------------------------------------------------------


def select_views(views: DataFrame, choose: Callable[[pd.DataFrame], pd.Series], keys: tuple[str, ...] = ("uid", "cluster")) -> DataFrame:
    """(keys, view): what `choose` picks of each group's views (a series of view numbers). A group is one task's."""
    kinds = dict(views.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "view"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        picked = pd.Series(choose(pdf.sort_values("view", ignore_index=True)), dtype=pdf["view"].dtype)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(picked) for k in keys}, "view": picked.to_numpy()})

    return views.groupBy(*keys).applyInPandas(run, schema)


# --- encoders --------------------------------------------------------------------------------------------------------


class Encoder:
    """Base of text encoders: encode gets an array of texts and gives a row of numbers for each."""

    dim = 0

    def encode(self, texts: np.ndarray) -> np.ndarray:
        raise TypeError("an encoder defines encode")


class LetterEncoder(Encoder):
    """Counts of the letters a to z: a small stand-in for a trained encoder."""

    dim = 26

    def encode(self, texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            out[i] = np.bincount(codes[(codes >= 97) & (codes < 123)] - 97, minlength=26)
        return out


def encoded(text: str | Column, encoder: Encoder, batch_size: int = 256) -> Column:
    """Vectors of a text column, in batches; the encoder is made once a worker."""
    predict = predict_batch_udf(lambda: encoder.encode, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return predict(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


# --- hooks -----------------------------------------------------------------------------------------------------------


def with_hook(df: DataFrame, stage: str, hook: Callable[[str, dict], None], **measures: Column) -> tuple[DataFrame, Callable[[], None]]:
    """df with measures taken while it is computed, and a function that hands them to the hook after an action ended."""
    seen = Observation(stage)
    out = df.observe(seen, *(c.alias(k) for k, c in ({"rows": F.count(F.lit(1))} | measures).items()))
    return out, lambda: hook(stage, seen.get)
