"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors become integers floor(scale * x) and are cut into `parts` consecutive parts.  Each part position has a codebook of
at most `entries` integer vectors, at first that part of the rows of the smallest ids; `rounds` rounds assign every part
to its nearest entry and move each entry to the componentwise floor of its parts' mean.  A vector's code is the entries'
numbers in order of the parts.

Nearest entries: a codebook is sorted by norm.  A part first meets the entry of nearest norm; by the triangle inequality
only entries whose norm differs from the part's by no more than the best distance so far can be as near, so a binary
search cuts out that annulus, ends included, and its entries are compared exactly, outwards from the part's norm.  Each
better distance narrows the annulus.  Ties go to the lower number.

A round is one pass over the rows: each task sums its parts by entry, and at most parts * entries rows of sums a task
meet in an aggregation.  What the driver holds is the codebooks, `entries` vectors in all.  All sums are integers, so
neither the order of rows nor a task that runs twice can change a code.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; neither do vectors of
another length than that of the smallest id's (so that one length is left); a length that `parts` does not divide is cut
at floor(j * length / parts).  Null ids come last in the choice of the first entries, rows that repeat an id in order of
their components; each repeated row has a code of its own.  With fewer rows than entries the codebooks are smaller.  An
empty table gives an empty table.  Null labels are one label.  Other columns are ignored.  Components so large that
squared distances or sums leave the exact range of doubles raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that one vectorised step takes.
STEP = 4096


def integers(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part."""
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v"))


def cuts(dim: int, parts: int) -> list[int]:
    return [j * dim // parts for j in range(parts + 1)]


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.float64)
        norms = np.sqrt((self.entries**2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], self.entries[self.order]

    def _against(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.sorted[at]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest entry, squared distance) of each row, and how many entries were compared."""
        n, last = len(x), len(self.norms) - 1
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        slack = 1e-9 * (norm + self.norms[-1] + 1)  # for the rounding of roots: the annulus may only grow by it
        at = np.searchsorted(self.norms, norm)
        left = np.clip(at - 1, 0, last)
        right = np.clip(at, 0, last)
        seed = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        best, entry = self._against(x, seed), self.order[seed]
        reach = np.sqrt(best) + slack
        low = np.searchsorted(self.norms, norm - reach, "left")
        high = np.searchsorted(self.norms, norm + reach, "right")  # exclusive: equal norms are inside
        down, up, compared = seed - 1, seed + 1, n
        open_ = np.flatnonzero((down >= low) | (up < high))
        while len(open_):
            d, u, nx = down[open_], up[open_], norm[open_]
            gap_d = np.where(d >= low[open_], nx - self.norms[np.clip(d, 0, last)], np.inf)
            gap_u = np.where(u < high[open_], self.norms[np.clip(u, 0, last)] - nx, np.inf)
            inside = np.minimum(gap_d, gap_u) <= np.sqrt(best[open_]) + slack[open_]  # else nothing further out is nearer
            open_, lower = open_[inside], (gap_d <= gap_u)[inside]
            pick = np.where(lower, down[open_], up[open_])
            down[open_[lower]] -= 1
            up[open_[~lower]] += 1
            distance, number = self._against(x[open_], pick), self.order[pick]
            compared += len(open_)
            better = (distance < best[open_]) | ((distance == best[open_]) & (number < entry[open_]))
            best[open_[better]], entry[open_[better]] = distance[better], number[better]
            open_ = open_[(down[open_] >= low[open_]) | (up[open_] < high[open_])]
        return entry, best, compared


def _steps(batch: pa.RecordBatch, dim: int):
    """Blocks (first row, components as doubles, one row a vector) of an Arrow batch with a list column v."""
    v = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for i in range(0, len(v), STEP):
        yield i, v[i : i + STEP].astype(np.float64)


def _moved(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    at, size = cuts(dim, len(books)), len(books[0])

    def sums(batches):
        found = [Codebook(b) for b in books]
        total, count = np.zeros((size, dim), np.int64), np.zeros((len(books), size), np.int64)
        for batch in batches:
            for _, x in _steps(batch, dim):
                for j, book in enumerate(found):
                    part = np.ascontiguousarray(x[:, at[j] : at[j + 1]])
                    entry = book.nearest(part)[0]
                    count[j] += np.bincount(entry, minlength=size)
                    order = np.argsort(entry, kind="stable")
                    kinds, first = np.unique(entry[order], return_index=True)
                    total[kinds, at[j] : at[j + 1]] += np.add.reduceat(part[order].astype(np.int64), first, axis=0)
        j, k = np.nonzero(count)
        lists = pa.array([total[b, at[a] : at[a + 1]] for a, b in zip(j, k, strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(count[j, k]), lists], ["part", "entry", "n", "s"])

    each = rows.select("v").mapInArrow(sums, "part int, entry int, n long, s array<long>")
    each = each.select("part", "entry", "n", F.posexplode("s").alias("pos", "s")).groupBy("part", "entry", "pos")
    moved = [b.copy() for b in books]
    for r in each.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # at most entries * dim rows
        moved[r["part"]][r["entry"], r["pos"]] = r["s"] // r["n"]
    return moved


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of the one length that takes part, codebooks); rows as integers() makes them, already materialised."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return rows, []
    dim = len(first[0]["v"])
    rows = rows.where(F.size("v") == dim)
    start = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).select("v").collect()], np.int64)
    most, n = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.count(F.lit(1))).first()
    if 4 * int(most) ** 2 * dim >= 1 << 53 or int(most) * n >= 1 << 62:
        raise ValueError("components are too large for exact distances")
    at = cuts(dim, parts)
    books = [start[:, at[j] : at[j + 1]] for j in range(parts)]
    for _ in range(rounds):
        books = _moved(rows, books, dim)
    return rows, books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows without v, and code string, error long, compared long (entries compared exactly for the row, on average over
    its step); books as fit() makes them."""
    if not books:
        return rows.drop("v").selectExpr("*", "'' AS code", "0L AS error", "0L AS compared").where("false")
    dim = sum(b.shape[1] for b in books)
    at = cuts(dim, len(books))
    kept = [f for f in rows.schema.fields if f.name != "v"]
    digits = np.array([f"{k:02x}" for k in range(len(books[0]))])

    def codes(batches):
        found = [Codebook(b) for b in books]
        for batch in batches:
            code, error, compared = [], [], []
            for _, x in _steps(batch, dim):
                parts = [book.nearest(np.ascontiguousarray(x[:, at[j] : at[j + 1]])) for j, book in enumerate(found)]
                code += map("".join, zip(*(digits[p[0]] for p in parts), strict=True))
                error.append(sum(p[1] for p in parts).astype(np.int64))
                compared.append(np.full(len(x), sum(p[2] for p in parts) // len(x)))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(code, pa.string()), flat(error), flat(compared)], [*(f.name for f in kept), "code", "error", "compared"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*(f.name for f in kept), "v").mapInArrow(codes, f"{kind}, code string, error long, compared long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows that take part."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("entries must be 1 to 256, parts at least 1")
    rows, books = fit(materialize(integers(vectors, vec_id, embedding, label, scale)), parts, entries, rounds)
    coded = materialize(encode(rows, books).drop("compared"))
    sums = materialize(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    out = coded.join(bounded(sums), F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return compress(vectors).drop("label")


def _sql_round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (
  SELECT r, part, min((d, entry)) AS best FROM (
    SELECT x.r, x.part, c.entry, list_sum(list_transform(list_zip(x.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN c{i} c ON c.part = x.part) GROUP BY r, part)"""


def _sql_move(i: int) -> str:
    return f"""u{i} AS (
  SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT x.part, a.best[2] AS entry, unnest(x.p) AS v, unnest(range(len(x.p))) AS pos FROM x JOIN a{i} a ON a.r = x.r AND a.part = x.part) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS p FROM u{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)"""


SQL = f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM q),
x AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS p FROM n, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, r AS entry, p FROM x WHERE r < {ENTRIES}),
{", ".join(f"{_sql_round(i)}, {_sql_move(i)}" for i in range(ROUNDS))},
{_sql_round(ROUNDS)},
f AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM f JOIN n USING (r), h
"""
