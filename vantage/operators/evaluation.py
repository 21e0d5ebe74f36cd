"""Retrieval evaluation over embedded items: similarities, classification, precision and recall, matrices, histograms.

items: (uid, category, ...); vectors: (uid, vector); categories: (category, vector).  Similarities are rounded to
DIGITS before they are ranked, so that ranks do not hang on the order of a sum; ties go to the smaller uid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import cut
from ..functions.vectors import as_double, dot, l2_normalize, mean_vectors
from .dataset import ranked
from .joins import checked

DIGITS = 6


def category_centroids(items: DataFrame, category: str = "category", vector: str = "vector") -> DataFrame:
    """(category, vector): normalised mean of each category's vectors."""
    return mean_vectors(items, [category], vector, "vector").withColumn("vector", l2_normalize("vector"))


def similarity_to_own(items: DataFrame, categories: DataFrame) -> DataFrame:
    """(uid, category, similarity) of each item to the vector of its category."""
    c = checked(categories.select("category", F.col("vector").alias("__c")))
    return items.join(c, "category").select("uid", "category", F.round(dot("vector", "__c"), DIGITS).alias("similarity"))


def similarity_to_all(items: DataFrame, categories: DataFrame, keep: tuple[str, ...] = ("uid",), single: bool = False) -> DataFrame:
    """(keep..., category, similarity): the best of an item's vectors against every category.

    Every pair is part of the result; the categories are the small side.  single: items have one vector each, so that
    the pairs need no shuffle."""
    c = checked(categories.select("category", F.col("vector").alias("__c")))
    i = items.select(*(F.col(k).alias(f"__{k}") for k in keep), F.col("vector").alias("__v"))
    pairs = i.join(c, F.lit(True)).select(*(F.col(f"__{k}").alias(k) for k in keep), "category", F.round(dot("__v", "__c"), DIGITS).alias("similarity"))
    return pairs if single else pairs.groupBy(*keep, "category").agg(F.max("similarity").alias("similarity"))


#: Bytes of category vectors that one scoring pass sends to the tasks.
BLOCK_BYTES = 32 << 20


def classify(items: DataFrame, categories: DataFrame, floor: float = -1.0) -> DataFrame:
    """(uid, predicted, similarity): the most similar category, the first by name on ties; none at or below the floor.

    Categories go in blocks of about BLOCK_BYTES, by a hash: each pass over the items multiplies Arrow batches of them by
    one block and keeps a row an item, and the passes' best are merged, so no row or task ever holds all categories.
    Null vectors and those of another length than the categories' find none."""
    c = cut(categories.where(F.col("vector").isNotNull()).select("category", as_double("vector").alias("vector")))
    n, dim = next(iter(c.agg(F.count(F.lit(1)), F.max(F.size("vector"))).collect()))  # one row
    kinds = {f.name: f.dataType.simpleString() for f in (items.schema["uid"], categories.schema["category"])}
    schema = f"uid {kinds['uid']}, predicted {kinds['category']}, similarity double"
    rows = items.where(F.size("vector") == (dim or 0)).select("uid", as_double("vector").alias("vector"))
    passes = max(1, -(-n * (dim or 1) * 8 // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("category"), F.lit(passes))
    kind, found = to_arrow_type(categories.schema["category"].dataType), None
    for k in range(passes):
        part = sorted(c.where((block == k) & (F.size("vector") == (dim or 0))).collect(), key=lambda r: r["category"])  # a block
        best = rows.mapInArrow(_scorer([r["category"] for r in part], np.array([r["vector"] for r in part], float).reshape(len(part), dim or 0), kind), schema)
        found = best if found is None else found.unionByName(best)
    best = found.where(F.col("similarity") > floor).groupBy("uid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "predicted")).alias("b"))
    return best.select("uid", F.col("b.predicted").alias("predicted"), (-F.col("b.s")).alias("similarity"))


def _scorer(names: list, vectors: np.ndarray, kind: pa.DataType):
    """Batches (uid, vector) to (uid, the best of the named vectors, its similarity); the first name, of this type, on ties."""
    unit = 10.0**DIGITS

    def score(batches):
        for batch in batches:
            if not names or not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = x @ vectors.T
            s = np.copysign(np.floor(np.abs(s) * unit + 0.5), s) / unit
            s[np.isnan(s)] = -np.inf
            at = s.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([names[i] for i in at], kind), pa.array(s[np.arange(len(s)), at])], ["uid", "predicted", "similarity"])

    return score


def best_view(views: DataFrame, categories: DataFrame) -> DataFrame:
    """(uid, view, similarity): the item's view most similar to its own category; the lowest view on ties."""
    c = checked(categories.select("category", F.col("vector").alias("__c")))
    s = views.join(c, "category").select("uid", "view", F.round(dot("vector", "__c"), DIGITS).alias("similarity"))
    best = s.groupBy("uid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "view")).alias("b"))
    return best.select("uid", F.col("b.view").alias("view"), (-F.col("b.s")).alias("similarity"))


def precision_recall(scores: DataFrame, keys: tuple[str, ...] = ("category",), sizes: DataFrame | None = None) -> DataFrame:
    """(keys, uid, relevant, rank, similarity, tp, size, precision, recall) of scores (keys, uid, similarity, relevant), ranked.

    Recall divides by size, the number of relevant rows of the group, or by sizes (keys, size); groups of size 0 are left
    out.  Every item is scored against every category, so a group is as long as the table: ranks are made over ranges."""
    s = scores.select(*keys, "uid", "similarity", F.coalesce("relevant", F.lit(False)).alias("relevant"))
    s = s.withColumn("__hit", F.col("relevant").cast("long"))
    out = ranked(s, list(keys), [F.desc("similarity"), F.col("uid")], "__hit").withColumnsRenamed({"running": "tp", "whole": "size"})
    if sizes is not None:
        out = out.drop("size").join(checked(sizes), [k for k in keys if k in sizes.columns])
    out = out.where("size > 0").withColumns({"precision": F.col("tp") / F.col("rank"), "recall": F.col("tp") / F.col("size")})
    return out.select(*keys, "uid", "relevant", "rank", "similarity", "tp", "size", "precision", "recall")


def with_anchor(curve: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """(keys, rank, precision, recall) with a first point (precision 1, recall 0) at rank 0, for charts only."""
    first = curve.select(*keys).distinct().select(*keys, F.lit(0).alias("rank"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.select(*keys, "rank", "precision", "recall").unionByName(first)


def area_under_curve(curve: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """(keys, auc) of a curve by precision_recall: trapezoids between consecutive points, without an anchor, in [0, 1];
    one point gives 0.

    The point before is known from the row itself: one rank less, and one hit less if the row is one."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    tp0, rank0 = F.col("tp") - F.col("relevant").cast("long"), F.col("rank") - 1
    width = F.greatest(clip(F.col("tp") / F.col("size")) - clip(tp0 / F.col("size")), F.lit(0.0))
    height = (clip(F.col("tp") / F.col("rank")) + clip(tp0 / F.when(rank0 > 0, rank0))) / 2
    piece = F.when(rank0 > 0, width * height).otherwise(0.0)
    return curve.groupBy(*keys).agg(F.round(clip(F.sum(piece)), DIGITS).alias("auc"))


def average_by(values: DataFrame, value: str, keys: tuple[str, ...] = ("category",), out: str = "avg") -> DataFrame:
    """Mean by group, of the groups that occur."""
    return values.groupBy(*keys).agg(F.round(F.avg(value), DIGITS).alias(out))


def dense_average(values: DataFrame, value: str, rows: DataFrame, columns: DataFrame, default: float = 0.0, out: str = "avg") -> DataFrame:
    """Mean for each pair of the two key tables; pairs without values get the default. The full grid is the result."""
    keys = [*rows.columns, *columns.columns]
    grid = rows.distinct().join(checked(columns.distinct()), F.lit(True))
    means = values.groupBy(*keys).agg(F.avg(value).alias(out))
    return grid.join(means, keys, "left").select(*keys, F.round(F.coalesce(out, F.lit(default)), DIGITS).alias(out))


def category_matrix(items: DataFrame, categories: DataFrame, only: str | None = None) -> DataFrame:
    """(model_category, query_category, avg): mean similarity of a category's items to every category.

    The mean of products is the product with the mean, so items are averaged first and the product is taken between
    category vectors: no pair of item and category is made."""
    means = mean_vectors(items if only is None else items.where(F.col("category") == only), ["category"], "vector", "__m")
    c = checked(categories.select(F.col("category").alias("query_category"), F.col("vector").alias("__c")))
    pairs = means.withColumnRenamed("category", "model_category").join(c, F.lit(True))
    return pairs.select("model_category", "query_category", F.round(dot("__m", "__c"), DIGITS).alias("avg"))


def discrete_histogram(counts: DataFrame, value: str = "value", category: str = "category") -> DataFrame:
    """(category, bucket, n): rows of each value, with empty buckets from 0 to the category's largest."""
    n = counts.groupBy(category, F.col(value).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    tops = n.groupBy(category).agg(F.max("bucket").alias("top"))
    grid = tops.select(category, F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bucket"))
    return grid.join(n, [category, "bucket"], "left").select(category, "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def average_histogram(histogram: DataFrame, category: str = "category") -> DataFrame:
    """(bucket, avg): mean of the categories' histograms; a bucket that a category lacks counts as 0."""
    groups = histogram.agg(F.countDistinct(category).alias("__g"))
    sums = histogram.groupBy("bucket").agg(F.sum("n").alias("s"))
    return sums.join(F.broadcast(groups), F.lit(True)).select("bucket", F.round(F.col("s") / F.col("__g"), DIGITS).alias("avg"))  # one row


def trim_histogram(histogram: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """Without the empty buckets before the first and after the last non-empty one."""
    ends = histogram.where("n > 0").groupBy(*keys).agg(F.min("bucket").alias("__lo"), F.max("bucket").alias("__hi"))
    return histogram.join(ends, list(keys)).where("bucket BETWEEN __lo AND __hi").select(*keys, "bucket", "n")


def bucket_range(histogram: DataFrame) -> DataFrame:
    """(lo, hi): first and last non-empty bucket over all histograms; 0 where there is none."""
    full = F.when(F.col("n") > 0, F.col("bucket"))
    return histogram.agg(F.coalesce(F.min(full), F.lit(0)).alias("lo"), F.coalesce(F.max(full), F.lit(0)).alias("hi"))


def loss_statistics(losses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, step, avg, std): mean and population deviation by step of the finite values."""
    v = F.col("value")
    finite = losses.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return finite.groupBy(*keys, "step").agg(F.round(F.avg(v), DIGITS).alias("avg"), F.round(F.stddev_pop(v), DIGITS).alias("std"))


def loss_band(statistics: DataFrame) -> DataFrame:
    """Statistics with lo and hi, one deviation around the mean."""
    return statistics.withColumns({"lo": F.round(F.col("avg") - F.col("std"), DIGITS), "hi": F.round(F.col("avg") + F.col("std"), DIGITS)})


def mean_and_list(views: DataFrame, distinct: bool = False, first_is_mean: bool = False) -> DataFrame:
    """(uid, mean, vectors): mean of an item's view vectors, and the vectors in view order.

    distinct drops repeated views (the first stays); first_is_mean puts the mean in the first place if there are
    several, as an earlier implementation did."""
    if distinct:
        views = views.dropDuplicates(["uid", "view"])
    lists = views.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("view", "vector"))), lambda s: s["vector"]).alias("vectors"))
    out = mean_vectors(views, ["uid"], "vector", "mean").join(lists, "uid")
    if first_is_mean:
        several = F.size("vectors") > 1
        out = out.withColumn("vectors", F.when(several, F.concat(F.array("mean"), F.slice("vectors", 2, F.greatest(F.size("vectors") - 1, F.lit(1))))).otherwise(F.col("vectors")))
    return out.select("uid", "mean", "vectors")


def group_difference(values: DataFrame, group_a: list[str], group_b: list[str], best_of: str = "max") -> DataFrame:
    """(category, a, b, diff): extreme value of two groups of methods for each category, and their difference."""
    f = F.max if best_of == "max" else F.min
    pick = lambda g: f(F.when(F.col("method").isin(g), F.col("value")))
    out = values.groupBy("category").agg(pick(group_a).alias("a"), pick(group_b).alias("b"))
    return out.where("a IS NOT NULL AND b IS NOT NULL").withColumn("diff", F.round(F.col("a") - F.col("b"), DIGITS))


def top_and_bottom(df: DataFrame, order: str, key: str, top: int, bottom: int) -> DataFrame:
    """The `top` largest and then, of what is left, the `bottom` smallest; column side. Each end is a distributed top-k."""
    largest = df.orderBy(F.desc(order), key).limit(top)
    rest = df.join(largest.select(key), key, "left_anti")
    return largest.withColumn("side", F.lit("top")).unionByName(rest.orderBy(order, F.desc(key)).limit(bottom).withColumn("side", F.lit("bottom")))


def pivot_methods(values: DataFrame, methods: list[str], missing: float = float("nan")) -> DataFrame:
    """A row a category, a column a method, with `missing` in empty cells."""
    out = values.groupBy("category").pivot("method", methods).agg(F.first("value"))
    return out.select("category", *(F.coalesce(F.col(f"`{m}`"), F.lit(missing)).alias(m) for m in methods))


def relevancy(positives: DataFrame, negatives: DataFrame, temperature: float = 10.0) -> DataFrame:
    """(uid, relevancy): least softmax weight of the positive similarity against each negative."""
    w = 1.0 / (1.0 + F.exp(F.lit(temperature) * (F.col("negative") - F.col("positive"))))
    return positives.join(negatives, "uid").groupBy("uid").agg(F.round(F.min(w), DIGITS).alias("relevancy"))


def best_scale(values: DataFrame) -> DataFrame:
    """(phrase, scale, relevancy): the scale with the largest relevancy of each phrase; the smallest scale on ties."""
    by_scale = values.groupBy("phrase", "scale").agg(F.max("relevancy").alias("relevancy"))
    best = by_scale.groupBy("phrase").agg(F.min(F.struct((-F.col("relevancy")).alias("r"), "scale")).alias("b"))
    return best.select("phrase", F.col("b.scale").alias("scale"), (-F.col("b.r")).alias("relevancy"))
