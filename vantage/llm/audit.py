"""Filter interaction audit: what each filter of a cleaning chain removes, in every order of the filters.

Five failure flags are told for each document.  Documents are counted by part and flags; SQL's CUBE over the flags and the
part then gives, for each subset of the filters, the documents that pass all of it: the grouping-set row in which the
subset's flags are false and the others are rolled up.  A step of an order takes the survivors of the filters before it
to those of the filters up to it, so every figure of a step comes from joining pairs of subsets: 600 steps meet 32 counts
a part, and no order is ever replayed over documents.

Flags: A under 50 words; B fewer than 65 distinct words in 100; C more than 5 capital letters A-Z in 100 code points;
D holds any of `#$%&*|`; E the same text as a document of smaller id, anywhere in the table.  A to D are told from a text
alone.  For E the smallest id of each text is found with partial aggregation, by a digest of the text, and rows are
matched with it by digest and id together, so that no task meets the rows of a text that a third of them share.

Edge cases: a null text is empty; a null part is the empty string; a null id is never a repeat nor the smallest id; rows
that repeat the smallest id are all first; labels of a repeated id count if any of them has the value; labels of null
ids or of no document count nothing; documents without a label are neither good nor toxic; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
_SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Flags A to D of a text, as columns."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
    return {
        "A": n < WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_SHARE * n.cast("long"),
        "C": 100 * capitals.cast("long") > CAPITAL_SHARE * F.length(t).cast("long"),
        "D": t.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents by part and flags, a row for each combination that occurs."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    same = {"h": F.unhex(F.md5(t)), "size": F.octet_length(t)}  # they stand for the text
    flags = text_flags(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), *(c.alias(k) for k, c in (same | flags).items()))
    rows = materialize(rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("rows")))
    first = rows.groupBy(F.col("h").alias("first_h"), F.col("size").alias("first_size")).agg(F.min("id").alias("first_id"))
    is_first = (F.col("h") == F.col("first_h")) & (F.col("size") == F.col("first_size")) & (F.col("id") == F.col("first_id"))
    rows = rows.join(first, is_first, "left").withColumn("E", F.col("id").isNotNull() & F.col("first_id").isNull())
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(has("quality").alias("is_good"), has("toxic").alias("is_toxic"))
    rows = rows.join(marks, F.col("id") == F.col("label_id"), "left")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("rows"))), F.lit(0)).cast("long")
    return rows.groupBy("part", *FILTERS).agg(F.sum("rows").alias("n"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that pass every filter of each subset (bit i: filter i), zeros included."""
    counts = materialize(counts)
    mask = sum(F.when(F.grouping(f) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = counts.cube("part", *FILTERS).agg(mask.alias("mask"), F.grouping("part").alias("all_parts"), *sums)
    passed = cube.where(F.col("all_parts") == 0)
    for f in FILTERS:  # rolled up, or selected and false
        passed = passed.where(~F.coalesce(F.col(f), F.lit(False)))
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    passed = passed.select("part", "mask", "n", "good", "toxic")
    return every.join(passed, ["part", "mask"], "left").select("part", "mask", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "good", "toxic")))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, subset before, filter's bit) of all orders: 600 rows."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k + 1, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each
    part, order and step; labels has doc_id, quality and toxic."""
    spark, every = docs.sparkSession, (1 << len(FILTERS)) - 1
    table = survivors(flagged(docs, labels, doc_id, text, part))
    of = lambda name, k: table.select("part", F.col("mask").alias(name), *(F.col(c).alias(f"{c}{k}") for c in ("n", "good", "toxic")))
    before, after = of("before", 0), of("after", 1)
    # pairs of subsets that differ by one filter: 80 a part
    pairs = before.withColumn("bit", F.explode(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))))).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    pairs = pairs.withColumn("after", F.col("before").bitwiseOR(F.col("bit"))).join(after, ["part", "after"])
    pairs = materialize(pairs.select("part", "before", "bit", F.col("n1").alias("kept"), (F.col("n0") - F.col("n1")).alias("removed"), (F.col("good0") - F.col("good1")).alias("good_lost"), (F.col("toxic0") - F.col("toxic1")).alias("toxic_lost")))
    size = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), (size + 1).cast("int"))
    own = pairs.groupBy("part", "bit").agg(
        F.sum(orders * F.col("removed")).cast("long").alias("shapley"),
        F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("before").bitwiseOR(F.col("bit")) == every, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    chain = spark.createDataFrame(steps(), "filter_order string, step int, before int, bit int")
    out = pairs.join(F.broadcast(chain), ["before", "bit"]).join(own, ["part", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


#: Replays every order over every document.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < {WORDS} THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_SHARE} * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_SHARE} * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN coalesce(d.doc_id > m.first_id, false) THEN 'E' ELSE '' END) AS fails
  FROM d JOIN m USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c3.x || d4.x || e.x AS filter_order FROM c a, c b, c c3, c d4, c e
  WHERE len(list_distinct([a.x, b.x, c3.x, d4.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step:step] AS x, filter_order[1:step - 1] AS earlier, filter_order[1:step] AS upto FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, x,
    sum(CASE WHEN len(list_intersect(string_split(fails, ''), string_split(upto, ''))) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, x) AND (earlier = '' OR len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) = 0) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, x) AND earlier <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, x) AND (earlier = '' OR len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) = 0) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, x) AND (earlier = '' OR len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) = 0) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""
