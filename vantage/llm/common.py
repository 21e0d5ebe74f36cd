"""Helpers shared by the corpus operators: scratch tables, size-checked broadcasts, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a table that may be sent to every executor; above it operators use a shuffle join.
BROADCAST_BYTES = 8 << 20
#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows in one Arrow batch: whole texts can be long, so far fewer than Spark's default.
BATCH_ROWS = 1000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir, which all executors share.

    Only a local session may leave that setting out: then a temporary folder is used; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vantage-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/vantage-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage, fixes its size."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(field) -> Column:
    """Size of a column's values, about: 8 bytes for a number, what a string or an array holds."""
    kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if kind == "array":
        return F.greatest(F.size(c), F.lit(0)) * 8 + 8 if field.dataType.elementType.typeName() not in ("string", "array", "struct") else F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if kind in ("struct", "map") else F.lit(8)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (already materialised: it is read for its size) marked for broadcast if it holds at most `most` bytes; else
    unmarked, so that the join shuffles and its skewed keys are split at run time."""
    total = sum((_bytes(f) for f in df.schema.fields), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(total.cast("long"))).collect()[0][0] or 0) <= most else df  # one row


def hash_sample(ids: DataFrame, most: int) -> DataFrame:
    """(id, y, r): of the pairs (id, y) at most `most` of each y, the first r = 1, 2, ... in order of a hash of the id.

    Counts of different ids by y (estimated within a few per cent) give a share of hashes that holds about twice as many;
    only those are ranked, so what meets in a task is as small for a frequent y as for a rare one.  Pairs that repeat,
    however often, count once, in the counts as in the sample."""
    ids = ids.select("id", "y")
    counts = ids.groupBy(F.col("y").alias("__y")).agg(F.approx_count_distinct(F.xxhash64("id"), 0.02).alias("__n"))
    counts = bounded(materialize(counts))
    u = (F.xxhash64(F.lit("sample"), "id") / F.lit(2.0**64)) + 0.5
    near = ids.join(counts, F.col("y").eqNullSafe(F.col("__y"))).where(u * F.col("__n") <= 2 * most + 50).select("id", "y").distinct()
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.lit("sample"), "id"), "id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., text) of rows with these columns: of each key one text, that of the smallest hash, so that no more rows
    reach the driver than there are keys."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.coalesce("text", F.lit("")))).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one column `row`, beside the given columns: the rows' own names cannot clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in columns.items()))


def unpacked(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The columns of `row` again, the given columns in place of those of their names, or else at the end."""
    kept = [columns.get(c, F.col("row").getField(c)).alias(c) for c in names]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items() if k not in names))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string array; nulls are empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose outputs look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: Places of a word that have a table of random numbers each; later ones are mixed one by one.
_TABLED = 64
_TABLES = [mix(np.arange(_TABLED << 8, dtype=np.uint64) + np.uint64(seed)) for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_SEEDS = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts: 64-bit hashes, byte ranges, and the texts' first words.

    A word's hash is the sum of a random number for each pair of place and byte, mixed; with second=True there is
    another such hash from other numbers, so that words that share both are equal for all practical purposes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, second: bool = False):
        data = _LOWER[data] if lower else data
        n = len(data)
        word = ~_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | cut[1:])) + 1
        length = self.end - self.start
        at = np.flatnonzero(word)
        place = at - np.repeat(self.start, length)
        code = (place << 8) | data[at]
        far = np.flatnonzero(place >= _TABLED)
        first = np.cumsum(length) - length  # of each word's bytes among those of all words
        self.hash, *more = (self._hashes(code, far, first, length, k) for k in range(1 + second))
        self.second = more[0] if more else None
        #: words of text i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, off)
        self.data = data

    @staticmethod
    def _hashes(code: np.ndarray, far: np.ndarray, first: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        if not len(first):
            return np.zeros(0, np.uint64)
        value = _TABLES[k].take(code, mode="wrap")
        if len(far):
            value[far] = mix(code[far].astype(np.uint64) ^ _SEEDS[k])
        return mix(np.add.reduceat(value, first) ^ (length.astype(np.uint64) << np.uint64(48)))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (also across texts: the caller keeps those inside one)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = len(h) - k + 1
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out *= _STEP
        out += h[i : i + m]
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows(h, k): positions that lie in one text, and that text's number."""
    m = max(0, total - k + 1)
    row = np.searchsorted(first, np.arange(m), "right") - 1
    ok = np.arange(m) + k <= first[row + 1] if m else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    return at, row[at]
