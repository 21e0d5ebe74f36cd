"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are runs of letters and digits, lower-cased.  Fixed masks hash the words at some positions and ignore those
between, so a hit survives substitutions there.  Hashes of all benchmark positions are joined with those of all
document positions; each hit aligns an item with a document, and the alignment is verified: a document is contaminated
by an item if some WINDOW consecutive words of the item stand against equal words of the document in all but at most
SUBSTITUTIONS places.  An item of n < WINDOW words is compared as a whole, with n * SUBSTITUTIONS / WINDOW places of
tolerance, rounded down: none below 7 words, one from 7 to 12.

No such alignment is missed.  For long items two masks of 6 places are enough: for every pair of places in 13, one of
them has a shift that avoids both.  For 7 to 12 words every second word is hashed, from the first word and from the
second: one wrong place is in one of the two at most.  Shorter items have a solid mask of their length, down to items
of one word, and one place of such an item in a text is enough.

Hits, made distinct, are joined back to the texts that have any.  Benchmark hashes, and the tables of hits, are sent
to all executors only if they hold few bytes (BROADCAST_BYTES); else they are joined by a shuffle.

Edge cases: null and empty texts and texts without letters or digits have no words, neither contain nor are contained;
repeated document rows and items with equal texts are compared each; null ids are kept as null; an empty benchmark or
no documents give no pairs.  Extra columns are ignored by `contaminated_pairs` and carried along by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, materialize

#: Places of a mask that are hashed. Lossless for WINDOW and SUBSTITUTIONS (tests/llm checks it).
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
WINDOW, SUBSTITUTIONS = 13, 2


def tolerated(n):
    """Places that may differ in an item of n < WINDOW words."""
    return n * SUBSTITUTIONS // WINDOW


def word_hashes(text: Column) -> Column:
    """Array of 64-bit hashes of the words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _short_masks(lengths: list[int]) -> dict[tuple[int, ...], tuple[list[int], int]]:
    """mask -> (lengths of items below WINDOW words that it serves, first places in the item at which it is laid)."""
    out: dict[tuple[int, ...], tuple[list[int], int]] = {}
    for n in lengths:
        mask = tuple(range(0, n - 1, 2)) if tolerated(n) else tuple(range(n))
        out.setdefault(mask, ([], 2 if tolerated(n) else 1))[0].append(n)
    return out


def _positions(df: DataFrame, h: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """df with a row for each position and mask: `at`, `mask` and `seed` (left out where the mask would not fit)."""
    m = len(masks)
    df = df.withColumn("__slot", F.explode(F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) * m - 1))))
    at, which = F.floor(F.col("__slot") / m).cast("int"), (F.col("__slot") % m).cast("int")
    seed = None
    for i, mask in enumerate(masks):
        value = F.when(at + mask[-1] < F.size(h), F.xxhash64(F.lit(i), *(F.col(h)[at + p] for p in mask)))
        seed = F.when(which == i, value) if seed is None else seed.when(which == i, value)
    return df.withColumns({"at": at, "mask": which, "seed": seed}).drop("__slot").where("seed IS NOT NULL")


def _alignment(shift: Column) -> Column:
    """(best, total): equal words in the best WINDOW consecutive words of the item (all of a shorter one), and in all,
    where word k of the item stands against word shift + k of the document; outside it nothing is equal."""
    places = F.sequence(F.lit(0), F.size("item_h") - 1)
    inside = lambda k: (shift + k >= 0) & (shift + k < F.size("h"))
    same = F.transform(places, lambda k: F.when(inside(k) & (F.get("h", shift + k) == F.get("item_h", k)), F.lit(1)).otherwise(F.lit(0)))

    def slide(same: Column) -> Column:
        start = F.struct(*(F.lit(0).alias(x) for x in ("run", "best", "total")))
        run = lambda a, k: a["run"] + F.get(same, k) - F.when(k >= WINDOW, F.get(same, k - WINDOW)).otherwise(F.lit(0))
        return F.aggregate(places, start, lambda a, k: F.struct(run(a, k).alias("run"), F.greatest(a["best"], run(a, k)).alias("best"), (a["total"] + F.get(same, k)).alias("total")))

    return F.transform(F.array(same), slide)[0]  # bound to a lambda's variable, `same` is computed once


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words): the contaminated documents, with the item's words that stand in the
    best alignment against equal words."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), word_hashes(F.col(f"`{item_text}`")).alias("item_h")).where(F.size("item_h") > 0)
    items = materialize(items)
    n = F.size("item_h")
    lengths = [r["n"] for r in items.select(n.alias("n")).where(F.col("n") < WINDOW).distinct().orderBy("n").collect()]  # below WINDOW values
    short = _short_masks(lengths)
    masks = [*MASKS, *short]
    serves = (n >= WINDOW) & (F.col("mask") < len(MASKS))
    for i, (served, firsts) in enumerate(short.values(), len(MASKS)):
        serves = serves | ((F.col("mask") == i) & n.isin(served) & (F.col("at") < firsts))
    solid = n < F.lit(next((k for k in range(1, WINDOW) if tolerated(k)), WINDOW))
    seeds = _positions(items, "item_h", masks).where(serves).select("seed", "item_id", F.col("at").alias("item_at"), solid.alias("whole"))
    seeds = bounded(materialize(seeds), most)
    need = F.when(n >= WINDOW, F.lit(WINDOW - SUBSTITUTIONS)).otherwise(n - F.floor(n * SUBSTITUTIONS / WINDOW))
    keyed = d.withColumn("row_key", F.xxhash64(F.coalesce("__text", F.lit(""))))
    # h as the output of a generator: the plan computes it once; only numbers leave the stage that explodes positions
    spots = _positions(keyed.select("row_key", F.explode(F.array(word_hashes(F.col("__text")))).alias("h")), "h", masks).select("row_key", "seed", "at")
    spots = spots.join(seeds, "seed").select("row_key", F.col("item_id").alias("spot_item"), (F.col("at") - F.col("item_at")).alias("shift"), F.when(F.col("whole"), F.col("seed")).alias("once"))
    # an item without tolerance stands whole at each of its hits: the first is kept, so that a common word is not a row per place
    spots = spots.groupBy("row_key", "spot_item", "once", F.when(F.col("once").isNull(), F.col("shift")).alias("each")).agg(F.min("shift").alias("shift"))
    spots = materialize(spots.select("row_key", "spot_item", "shift"))
    keys = bounded(materialize(spots.select(F.col("row_key").alias("key")).distinct()), most)
    hits = keyed.join(keys, F.col("row_key") == F.col("key"), "left_semi").select("doc_id", "row_key", F.explode(F.array(word_hashes(F.col("__text")))).alias("h"))
    hits = hits.join(bounded(spots, most), "row_key").join(bounded(items, most), F.col("spot_item").eqNullSafe(F.col("item_id")))
    found = hits.select("doc_id", "item_id", n.alias("item_words"), need.alias("need"), F.explode(F.array(_alignment(F.col("shift")))).alias("a"))
    found = found.where("a.best >= need").select("doc_id", "item_id", "item_words", F.col("a.total").alias("matched_words"))
    return found.groupBy("doc_id", "item_id", "item_words").agg(F.max("matched_words").alias("matched_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated rows, told by a digest of their text: ids may repeat or be null."""
    digest = F.unhex(F.sha2(docs[f"`{text}`"].cast("binary"), 256))
    found = contaminated_pairs(docs.select(digest.alias("digest"), F.col(f"`{text}`").alias("text")), benchmark, "digest")
    bad = bounded(materialize(found.select(F.col("doc_id").alias("__bad")).distinct()))
    return docs.join(bad, digest == bad["__bad"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = f"""
WITH w AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
i AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ip AS (SELECT item_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM i WHERE w[1] <> ''),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM w WHERE w[1] <> ''),
eq AS (SELECT doc_id, item_id, dp.pos - ip.pos AS shift, ip.pos AS pos FROM dp JOIN ip USING (word)),
diag AS (SELECT doc_id, item_id, shift, list(pos ORDER BY pos) AS ats, count(*) AS matched FROM eq GROUP BY ALL HAVING count(*) >= 1),
n AS (SELECT item_id, len(w) AS n FROM i WHERE w[1] <> ''),
ok AS (
  SELECT doc_id, item_id, n, matched FROM diag JOIN n USING (item_id)
  WHERE matched >= least(n - n * {SUBSTITUTIONS} // {WINDOW}, {WINDOW - SUBSTITUTIONS}) AND CASE WHEN n < {WINDOW} THEN true ELSE
    list_max(list_transform(range(0, n - {WINDOW} + 1), lambda s: len(list_filter(ats, lambda a: a >= s AND a < s + {WINDOW})))) >= {WINDOW - SUBSTITUTIONS} END)
SELECT doc_id, item_id, n::INTEGER AS item_words, max(matched)::INTEGER AS matched_words FROM ok GROUP BY ALL
"""
