"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text are one group and stay in one shard.  Groups enter in order of falling size, each the shard of
least remaining capacity that still holds it; shards stand in a balanced tree by remaining capacity.  With a fixed
capacity as many shards are opened as that takes (`pack`: a group larger than the capacity is a shard of its own); with
a fixed number of shards the smallest capacity that fits is found by bisection, which brings their sizes as near to each
other as the groups allow.  There, a group larger than a fair share of what is left has a shard to itself, and the
others share the rest.

What is packed is not the groups but how many there are of each size: the groups of one size fill the tightest shard,
then the next, so a run of them is one step, and the result is that of placing them one by one.  Sizes are exact below
2**16 and rounded up to 16 binary digits above, so that there are at most 32,768 different ones in each further octave:
about 1.1 million for 100 TB, whatever the number of groups, which is what the driver may hold at most.  Runs are then
dealt to the groups by rank: groups are put in order (size, digest) by ranges, and a group's rank is its partition's
offset and its place there.  Slots number the rows of a shard the same way, in order of doc_id.

No task holds a shard, a size or a text's copies: groups are counted with partial aggregation, the groups with at least
1 / HEAVY of all rows (at most HEAVY of them) are sent to all tasks, and no other text is frequent enough to weigh on the
join that brings shards back to the rows.  Only narrow rows are shuffled: ids, sizes and digests, never texts.

Edge cases: a null text is a group of its own beside the empty text, both of 0 bytes and CRC 0; a null doc_id comes last
in its shard; repeated rows are rows of their own with slots of their own; an empty table gives an empty table; with
fewer groups than shards some shards stay empty; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARDS, OVERHEAD, LAW = 40, 16, "bytes"
#: Binary digits kept of a size.
DIGITS = 16
#: A group with one in so many of all rows is heavy.
HEAVY = 5000


class Tree:
    """AVL tree of keys: insert, remove, and the least key not below a bound, each in logarithmic time."""

    def __init__(self):
        self.root = None  # (key, left, right, height)

    @staticmethod
    def _height(t) -> int:
        return t[3] if t else 0

    def _node(self, key, left, right):
        """A node over two subtrees whose heights differ by at most 2, turned so that they differ by at most 1."""
        h = self._height
        if h(left) > h(right) + 1:
            k, a, b, _ = left
            if h(a) < h(b):
                kb, b1, b2, _ = b
                return self._node(kb, self._node(k, a, b1), self._node(key, b2, right))
            return self._node(k, a, self._node(key, b, right))
        if h(right) > h(left) + 1:
            k, a, b, _ = right
            if h(b) < h(a):
                ka, a1, a2, _ = a
                return self._node(ka, self._node(key, left, a1), self._node(k, a2, b))
            return self._node(k, self._node(key, left, a), b)
        return key, left, right, 1 + max(h(left), h(right))

    def insert(self, key) -> None:
        def put(t):
            if not t:
                return key, None, None, 1
            return self._node(t[0], put(t[1]), t[2]) if key < t[0] else self._node(t[0], t[1], put(t[2]))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def first(t):
            return first(t[1]) if t[1] else t[0]

        def cut(t, key):
            if key < t[0]:
                return self._node(t[0], cut(t[1], key), t[2])
            if key > t[0]:
                return self._node(t[0], t[1], cut(t[2], key))
            if not t[1] or not t[2]:
                return t[1] or t[2]
            after = first(t[2])
            return self._node(after, t[1], cut(t[2], after))

        self.root = cut(self.root, key)

    def ceiling(self, bound):
        """The least key >= bound, or None."""
        t, found = self.root, None
        while t:
            if t[0] >= bound:
                t, found = t[1], t[0]
            else:
                t = t[2]
        return found


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, shards: int | None = None, first: int = 0) -> list[tuple[int, int]] | None:
    """Runs (number of groups, shard) in order of the groups, for sizes as (size, number of groups) in falling order.

    With `shards` open shards numbered from `first`: None if the groups do not fit.  Without, shards are opened as needed;
    a group larger than the capacity has one of its own."""
    tree, runs, opened = Tree(), [], first
    if shards is not None:
        for i in range(first, first + shards):
            tree.insert((capacity, i))
    for size, n in sizes:
        while n:
            if (bin_ := tree.ceiling((size, -1))) is None:
                if shards is not None:
                    return None
                take = min(n, max(1, capacity // size))
                bin_, opened = (max(capacity, size), opened), opened + 1
            else:
                take = min(n, bin_[0] // size)
                tree.remove(bin_)
            runs.append((take, bin_[1]))
            n -= take
            if left := bin_[0] - take * size:
                tree.insert((left, bin_[1]))
    return runs


def even(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Runs (number of groups, shard) over exactly `shards` shards of the smallest capacity found by bisection."""
    total, runs, used = sum(s * n for s, n in sizes), [], 0
    rest = list(sizes)
    # groups larger than a fair share of what is left: a shard each (the last shard takes all that is left)
    while rest and used < shards - 1 and rest[0][0] * (shards - used) > total:
        size, n = rest[0]
        runs.append((1, used))
        used, total = used + 1, total - size
        rest = [(size, n - 1), *rest[1:]] if n > 1 else rest[1:]
    if not rest:
        return runs
    # any-fit places everything once the capacity is a fair share and the largest group; a fair share is the least
    low = max(-(-total // (shards - used)), rest[0][0])
    high = -(-total // (shards - used)) + rest[0][0]
    found = best_fit(rest, high, shards - used, used)
    while low < high:
        middle = (low + high) // 2
        if (fits := best_fit(rest, middle, shards - used, used)) is not None:
            high, found = middle, fits
        else:
            low = middle + 1
    return runs + found


def rounded(size: Column) -> Column:
    """Sizes rounded up to DIGITS binary digits: exact below 2**DIGITS."""
    drop = F.greatest(F.length(F.bin(size)) - DIGITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return F.floor((size + unit - 1) / unit).cast("long") * unit


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df, materialised, with `place`: the number of its partition and the row's place in it, in the order of the columns.

    The partitions are ranges, so rows are in order of place; equal rows may lie in either order."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(df.withColumn("place", F.monotonically_increasing_id()))


def _partition(place: Column) -> Column:
    return F.shiftright(place, 33)


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, digest) of every row; the digest tells texts apart, and null from all."""
    t = F.col(f"`{text}`")
    crc = F.crc32(F.coalesce(t, F.lit("")).cast("binary"))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc.alias("text_crc32"), F.coalesce(F.unhex(F.md5(t)), F.lit(b"")).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, n, bytes, place): groups of equal texts in order of falling rounded size, then digest."""
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    groups = groups.select("digest", "n", rounded(F.col("total")).alias("bytes"))
    return ranked(groups, F.col("bytes").desc(), F.col("digest").asc())


def dealt(groups: DataFrame, runs: list[tuple[int, int]]) -> DataFrame:
    """(digest, n, shard): the runs dealt to the groups in order."""
    counts = groups.groupBy(_partition(F.col("place")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    counts = sorted((r["p"], r["n"]) for r in counts)
    of = np.array([p for p, _ in counts], np.int64)
    offsets = np.cumsum([0, *(n for _, n in counts)])[:-1]
    ends, shard = np.cumsum([n for n, _ in runs]), np.array([s for _, s in runs], np.int32)

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        rank = offsets[np.searchsorted(of, p >> 33)] + (p & ((1 << 33) - 1))
        return pd.Series(shard[np.searchsorted(ends, rank, "right")])

    return groups.select("digest", "n", shard_of("place").alias("shard"))


def placed(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows with the shard of their group."""
    heavy = F.col("n") * HEAVY >= total
    named = groups.select(F.col("digest").alias("d"), "n", "shard")
    frequent = named.where(heavy).select("d", F.col("shard").alias("heavy_shard"))
    rows = rows.join(F.broadcast(frequent), F.col("digest") == F.col("d"), "left").drop("d")  # at most HEAVY rows
    rare = rows.where("heavy_shard IS NULL").drop("heavy_shard").join(named.where(~heavy).select("d", "shard"), F.col("digest") == F.col("d")).drop("d")
    return rows.where("heavy_shard IS NOT NULL").withColumnRenamed("heavy_shard", "shard").unionByName(rare)


def numbered(rows: DataFrame) -> DataFrame:
    """rows (with a key that tells them apart) with `slot`: 0, 1, 2, ... within each shard by doc_id, then CRC."""
    rows = ranked(rows, F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("key"))
    pieces = rows.groupBy("shard", _partition(F.col("place")).alias("p")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    starts, before = [], 0
    ordered = sorted(map(tuple, pieces.collect()))  # a row a partition, and a row more a shard
    for _, same in itertools.groupby(ordered, key=lambda r: r[0]):
        before = 0
        for s, p, first, n in same:
            starts.append((s, p, before - first))
            before += n
    starts = rows.sparkSession.createDataFrame(starts, "s int, p long, shift long")
    out = rows.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (_partition(F.col("place")) == F.col("p")))
    return out.withColumn("slot", F.col("place") + F.col("shift")).drop("s", "p", "shift", "place", "key")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, over a fixed number of shards, or over as few shards of a
    fixed capacity as best fit finds."""
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    rows = materialize(described(docs, doc_id, text).withColumn("key", F.monotonically_increasing_id()))
    total = rows.count()
    groups = grouped(rows)
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2**16, and 2**15 an octave above
    sizes = sorted(((r["bytes"], r["n"]) for r in sizes), reverse=True)
    runs = even(sizes, shards) if capacity is None else best_fit(sizes, capacity)
    out = placed(rows, materialize(dealt(groups, runs)), total) if runs else rows.withColumn("shard", F.lit(0))
    return numbered(out).select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_BITS = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: CRC-32 byte by byte over the UTF-8 form of each code point, with the usual table of 256 remainders.
_SQL_CRC = f"""
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: {_BITS})) AS t),
z AS (SELECT digest, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM (SELECT digest, flatten(list_transform(list_transform(regexp_extract_all(any_value(coalesce(text, '')), '(?s).'), lambda x: ord(x)::BIGINT), lambda o:
    CASE WHEN o < 128 THEN [o] WHEN o < 2048 THEN [192 + (o >> 6), 128 + (o & 63)]
      WHEN o < 65536 THEN [224 + (o >> 12), 128 + ((o >> 6) & 63), 128 + (o & 63)]
      ELSE [240 + (o >> 18), 128 + ((o >> 12) & 63), 128 + ((o >> 6) & 63), 128 + (o & 63)] END)) AS bytes FROM d GROUP BY digest), tab)"""

#: One group is placed in each step of the recursion, once for every capacity that the bisection tries.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + {OVERHEAD} AS size, coalesce(md5(text), '') AS digest FROM documents),
{_SQL_CRC.strip()},
g0 AS (SELECT digest, sum(size)::BIGINT AS total FROM d GROUP BY digest),
g1 AS (SELECT digest, (1::BIGINT << greatest(length(ltrim(bin(total), '0')) - {DIGITS}, 0)::INTEGER) AS unit, total FROM g0),
g AS (SELECT *, row_number() OVER w - 1 AS i, (sum(b) OVER w - b)::BIGINT AS before FROM (SELECT digest, ((total + unit - 1) // unit) * unit AS b FROM g1) WINDOW w AS (ORDER BY b DESC, digest)),
p AS (SELECT *, bool_and(i < {SHARDS} - 1 AND b * ({SHARDS} - i) > (SELECT sum(b) FROM g) - before) OVER (ORDER BY i) AS alone FROM g),
l AS (SELECT list(b ORDER BY i) AS sizes, sum(b)::BIGINT AS rest, max(b) AS most, {SHARDS} - (SELECT count(*) FROM p WHERE alone) AS m FROM p WHERE NOT alone),
s AS (
  SELECT greatest((rest + m - 1) // m, most) AS lo, (rest + m - 1) // m + most AS hi, 0 AS i, false AS last, 0 AS bin, NULL::BIGINT[] AS room FROM l WHERE rest > 0
  UNION ALL
  SELECT CASE WHEN bin IS NULL THEN (lo + hi) // 2 + 1 ELSE lo END,
    CASE WHEN full_ THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN bin IS NULL OR full_ THEN 0 ELSE i + 1 END,
    CASE WHEN full_ THEN lo >= (lo + hi) // 2 WHEN bin IS NULL THEN (lo + hi) // 2 + 1 >= hi ELSE last END,
    bin, CASE WHEN bin IS NULL OR full_ THEN NULL ELSE list_transform(room, lambda x, k: CASE WHEN k = bin + 1 THEN x - size ELSE x END) END
  FROM (
    SELECT lo, hi, i, room, size, bin, last OR lo >= hi AS last, i + 1 = n AND bin IS NOT NULL AND NOT (last OR lo >= hi) AS full_ FROM (
      SELECT s.lo, s.hi, s.i, s.last, s.room, size, n,
        list_min(list_filter(list_transform(s.room, lambda x, k: x * 1000 + k - 1), lambda x: x >= size * 1000)) % 1000 AS bin
      FROM (SELECT s.lo, s.hi, s.i, s.last, l.sizes[s.i + 1] AS size, len(l.sizes) AS n,
          coalesce(s.room, list_transform(range(l.m), lambda x: CASE WHEN s.last OR s.lo >= s.hi THEN s.hi ELSE (s.lo + s.hi) // 2 END)) AS room
        FROM s, l WHERE s.i < len(l.sizes)) s))),
a AS (SELECT p.digest, p.i AS shard FROM p WHERE alone
  UNION ALL SELECT p.digest, s.bin + ({SHARDS} - l.m) FROM s JOIN l ON true JOIN p ON p.i = s.i - 1 + {SHARDS} - l.m WHERE s.last AND s.i > 0 AND s.room IS NOT NULL)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, '{LAW}' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, crc) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN a USING (digest) JOIN z USING (digest)
"""
