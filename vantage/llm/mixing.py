"""Mixing sources to target weights by Poisson replication.

Each source s with n_s documents gets a target share of the output; its mean repetition rate is
rate_s = share_s * total / n_s.  A document's number of copies is the inverse of the Poisson distribution with
that mean at a uniform number hashed from (seed, doc_id), so it depends on nothing but the document, the seed and
the rate: lost tasks that run again give the same copies.  Copies are then put in a global random order.

Edge cases: a null source is a source of its own; a null doc_id hashes as the empty string; repeated rows of a
doc_id draw the same number of copies each; empty or null texts are kept; an empty table gives an empty table.
Other columns are carried along, whatever their names; `copy` and `order_key` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, packed, unpacked

ALPHA, SEED = 0.7, "mix-1"


def uniform(key: Column, seed: str) -> Column:
    """52 bits of MD5 as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str = "source", alpha: float = ALPHA, weights: dict | None = None, epochs: float = 1.0) -> DataFrame:
    """(mix_source, rate) by each source's target share.

    weights are shares of the output.  Sources without one share what is left in proportion to n_s ** alpha; where
    nothing is left (all are given, or those given sum up to 1 or more) the given shares
    are scaled to 1 and the others get none.  Without weights all shares are in proportion to n_s ** alpha."""
    n = docs.groupBy(F.col(f"`{source}`").alias("mix_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights:
        n = materialize(n)
        given = F.lit(None).cast("double")
        for k, v in weights.items():
            if v < 0:
                raise ValueError(f"negative weight of {k!r}")
            given = F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(given)
        n = n.withColumn("given", given)
        used, mass = next(iter(n.agg(F.coalesce(F.sum("given"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("given").isNull(), F.pow("n", F.lit(alpha)))), F.lit(0.0))).collect()))  # one row
        rest = (1.0 - used) / mass if mass and used < 1 else 0.0
        target = F.coalesce("given", F.pow("n", F.lit(alpha)) * F.lit(rest))
    else:
        target = F.pow("n", F.lit(alpha))
    n = materialize(n.withColumn("target", target))
    sums = n.agg(F.sum("n").alias("docs"), F.sum("target").alias("mass"))
    docs_total, mass = next(iter(sums.collect()))  # one row
    if not docs_total or not mass:
        return n.select("mix_source", F.lit(0.0).alias("rate"))
    return n.select("mix_source", (F.col("target") / F.lit(mass) * F.lit(docs_total * epochs) / F.col("n")).alias("rate"))


def cumulative(rate: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... up to where what is left is below 2**-52. Logarithms keep large means exact."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("term"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf")),
        lambda a, k: F.struct(
            (a["term"] + F.log(rate) - F.log(k)).alias("term"),
            (a["sum"] + F.exp(a["term"] + F.log(rate) - F.log(k))).alias("sum"),
            F.concat(a["cdf"], F.array(a["sum"] + F.exp(a["term"] + F.log(rate) - F.log(k)))).alias("cdf"),
        ),
    )
    return F.when(rate > 0, logs["cdf"]).otherwise(F.array(F.lit(1.0)))


def poisson_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", alpha: float = ALPHA, weights: dict | None = None, epochs: float = 1.0, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """docs with each row as often as its source's rate asks, in a global random order (column order_key)."""
    table = rates(docs, source, alpha, weights, epochs)
    table = bounded(materialize(table.withColumn("cdf", cumulative(F.col("rate")))))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    rows = packed(docs, source=F.col(f"`{source}`"), key=key, u=uniform(key, seed))
    out = rows.join(table, F.col("source").eqNullSafe(F.col("mix_source")))
    out = out.select("row", "key", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("copies")).where("copies > 0")
    out = out.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = out.withColumn("order_key", F.md5(F.concat(F.lit(f"{seed}-order|"), F.col("key"), F.lit("|"), F.col("copy").cast("string"))))
    out = out.orderBy("order_key", "key", "copy") if shuffle else out
    return unpacked(out, docs.columns, copy=F.col("copy"), order_key=F.col("order_key"))


def query(spark, sf_dir: str) -> DataFrame:
    """Copies of all documents: doc_id, source, text, copy, order_key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return poisson_mix(docs)


SQL = f"""
WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
t AS (SELECT source, n, pow(n, {ALPHA}) AS target FROM n),
r AS (SELECT source, target / (SELECT sum(target) FROM t) * (SELECT sum(n) FROM t) / n AS rate FROM t),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
      FROM r, (SELECT unnest(range(0, 400)) AS k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT doc_id, source, text,
        ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents),
m AS (SELECT d.doc_id, d.source, d.text, count(*) AS copies
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY ALL)
SELECT doc_id, source, text, copy::INTEGER AS copy,
  md5('{SEED}-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS order_key
FROM (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM m)
"""
