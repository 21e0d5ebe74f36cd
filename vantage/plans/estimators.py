"""Transforms and clusterings as stages of `pyspark.ml` pipelines: fitted, saved, loaded and applied like Spark's own.

Input columns hold arrays of numbers or ml vectors; outputs are arrays of double.  A null vector gives null.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from ..operators import clustering as cl
from ..operators import transform as tr


def _vector(df: DataFrame, name: str) -> Column:
    return vector_to_array(name) if isinstance(df.schema[name].dataType, VectorUDT) else as_double(name)


class _TablesWriter(MLWriter):
    """Params as metadata, the model's tables as Parquet beside them."""

    def __init__(self, model: _TablesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        tables = self.model.tables(self.sparkSession)
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"tables": sorted(tables)})
        for name, df in tables.items():
            df.write.parquet(f"{path.rstrip('/')}/{name}")


class _TablesReader(MLReader):
    def __init__(self, kind: type[_TablesModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        read = {name: self.sparkSession.read.parquet(f"{path.rstrip('/')}/{name}") for name in metadata["tables"]}
        model = self.kind.of_tables(read)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _TablesModel(Model, MLReadable, MLWritable):
    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        raise TypeError("a model defines tables")

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame]):
        raise TypeError("a model defines of_tables")

    def write(self) -> MLWriter:
        return _TablesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TablesReader(cls)


# --- principal components --------------------------------------------------------------------------------------------


class _ProjectionParams(HasInputCol, HasOutputCol):
    normalize = Param(Params._dummy(), "normalize", "projections are brought to length 1", TypeConverters.toBoolean)


class Projection(Estimator, _ProjectionParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns k principal components, or the fewest that explain a share of the variance (all, if neither is given)."""

    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)
    variance = Param(Params._dummy(), "variance", "share of the variance to explain", TypeConverters.toFloat)

    def __init__(self, inputCol: str = "vector", outputCol: str = "projected", normalize: bool = False, **limit):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, normalize=normalize, **limit)

    def _fit(self, dataset: DataFrame) -> ProjectionModel:
        limit = {p: self.getOrDefault(p) for p in ("k", "variance") if self.isSet(p)}
        found = tr.pca(dataset.select(_vector(dataset, self.getInputCol()).alias("vector")), **limit)
        return self._copyValues(ProjectionModel(found))


class ProjectionModel(_TablesModel, _ProjectionParams):
    def __init__(self, parameters: dict | None = None):
        super().__init__()
        self.parameters = parameters or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), tr.projected(_vector(dataset, self.getInputCol()), self.parameters, self.getOrDefault("normalize")))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        p = self.parameters
        return {"parameters": spark.createDataFrame([(p["mean"], p["components"], p["explained"])], "mean array<double>, components array<array<double>>, explained array<double>")}

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame]) -> ProjectionModel:
        return cls(tables["parameters"].first().asDict())  # one row


# --- clusters of each item's samples ---------------------------------------------------------------------------------


class _ItemParams(HasInputCol, HasPredictionCol):
    itemCol = Param(Params._dummy(), "itemCol", "the item that a sample belongs to", TypeConverters.toString)
    sampleCol = Param(Params._dummy(), "sampleCol", "order of an item's samples; the first ones start its clusters", TypeConverters.toString)
    distanceCol = Param(Params._dummy(), "distanceCol", "distance to the nearest centroid, whitened", TypeConverters.toString)

    def _samples(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(
            F.col(self.getOrDefault("itemCol")).alias("uid"), F.col(self.getOrDefault("sampleCol")).alias("sample"),
            _vector(dataset, self.getInputCol()).alias("vector"), F.struct(*(F.col(f"`{c}`") for c in dataset.columns)).alias("__row"),
        )


class ItemKMeans(Estimator, _ItemParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns k whitened centroids for every item at once."""

    k = Param(Params._dummy(), "k", "clusters an item", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds of assignment and means", TypeConverters.toInt)

    def __init__(self, k: int = 2, rounds: int = 10, inputCol: str = "vector", itemCol: str = "uid", sampleCol: str = "sample", predictionCol: str = "cluster", distanceCol: str = "distance"):
        super().__init__()
        self._set(k=k, rounds=rounds, inputCol=inputCol, itemCol=itemCol, sampleCol=sampleCol, predictionCol=predictionCol, distanceCol=distanceCol)

    def _fit(self, dataset: DataFrame) -> ItemKMeansModel:
        samples = self._samples(dataset).drop("__row").where("vector IS NOT NULL")
        scales = cl.cut(cl.whitening(samples))
        work = cl.whiten(samples, scales)
        centroids = cl.lloyd(work, cl.first_centroids(work, self.getOrDefault("k")), self.getOrDefault("rounds"))
        return self._copyValues(ItemKMeansModel(scales, centroids))


class ItemKMeansModel(_TablesModel, _ItemParams):
    """Adds the nearest centroid of the row's item and the distance; null for items that were not learned."""

    def __init__(self, scales: DataFrame | None = None, centroids: DataFrame | None = None):
        super().__init__()
        self.scales, self.centroids = scales, centroids

    def _transform(self, dataset: DataFrame) -> DataFrame:
        both = self.scales.join(self.centroids.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("cluster", "vector"))).alias("__c")), "uid")
        j = self._samples(dataset).join(cl.checked(both), "uid", "left").withColumn("__x", F.zip_with("vector", "scale", lambda x, s: x * s))
        best = cl.nearest_of("__x")
        out = {self.getOrDefault("predictionCol"): best["cluster"], self.getOrDefault("distanceCol"): best["d"]}
        return j.select("__row.*", *(c.alias(name) for name, c in out.items()))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"scales": self.scales, "centroids": self.centroids}

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame]) -> ItemKMeansModel:
        return cls(tables["scales"], tables["centroids"])
