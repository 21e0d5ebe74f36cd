"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors become integers floor(scale * x).  Candidates lie in blocks; each block keeps, for each dimension, its rows in
order of that component.  A query reads these lists from the large end where its weight is positive and from the small
end where it is negative (dimensions of weight 0 add nothing and are not read).  Each step lowers a level c and reads
every list down to the entries whose weight times component is above c, so lists of large weight times next value are
read further than others.  Every row met is scored in full, once.  The sum over the lists of weight times the first value not read
bounds every row not yet met: once it is below the kth best score, no such row of the block can enter, ties included.
A query leaves a block by this rule or when its lists have shown every row; there is no other way.  The blocks' results are then merged.
Queries of a block go in batches, step by step, and what a batch has newly met is scored by one matrix product.

In many dimensions of like spread the bound falls slowly and most lists show all rows before it stops; `top_k` can
report, per query and block, how many list entries were read, how many rows met, and which rule ended it.

The query set is a stated part of the rows.  A task builds the lists of one block once and answers a stream of query
blocks from them (QUERY_GROUP at most, so that a task stays bounded as the number of queries grows).  Scores are exact:
products are summed as floats where all sums are below 2**24, as doubles below 2**53; larger inputs raise an error.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate;
ids are whole numbers (others are an error), and a null id takes no part; ties go to the smaller id.  Rows are told apart by a key of their own: rows that repeat an id
are queries each, with a ranking each, and find the other rows of their id.  Vectors of different length than the
query's are no candidates of it; with fewer than k candidates all are returned; no queries or no candidates give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, K, EVERY = 64, 20, 20
CANDIDATE_BLOCK, QUERY_BLOCK, QUERY_GROUP = 4096, 1024, 16
#: Shares of a block's list entries that a query has read after each step, about; the last step reads all.
SHARES = (1 / 64, 1 / 16, 1 / 9, 1 / 6, 1 / 4, 3 / 8, 1 / 2, 1)
#: Places of the table that tells how many entries of a list lie below a value.
PLACES = 128
#: Queries of a block that walk their lists together.
SIDE_BY_SIDE = 32


def quantize(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(key, vec_id, v array<long>, dim) of the rows that take part; key tells rows apart."""
    e = F.col(f"`{embedding}`")
    usable = F.col(f"`{vec_id}`").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.where(usable & F.coalesce(finite, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"), F.size(e).alias("dim"))


def _pack(df: DataFrame, rows_per_block: int, rows: int, salt: str) -> DataFrame:
    """Rows (block, dim, keys, ids, vs): blocks of about rows_per_block rows of one length, dealt by a hash of the key."""
    blocks = max(1, -(-rows // rows_per_block))
    at = F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(blocks)).cast("int")
    own = F.collect_list(F.struct("key", "vec_id", "v"))
    return df.groupBy(at.alias("block"), "dim").agg(own.alias("r")).select("block", "dim", F.col("r.key").alias("keys"), F.col("r.vec_id").alias("ids"), F.flatten("r.v").alias("vs"))


class Lists:
    """A candidate block: vectors sorted by id, and per dimension the positions in ascending order of the component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray | None = None):
        keys = ids if keys is None else keys
        order = np.lexsort((keys, ids))
        self.ids, self.keys = ids[order], keys[order]
        whole = vectors[order]
        #: largest component, for the choice of a type in which sums are exact
        self.most = float(np.abs(whole).max()) if whole.size else 0.0
        self.v = whole.astype(np.float64)
        self.narrow = whole.astype(np.float32) if self.most < 1 << 24 else None
        by = np.argsort(whole, axis=0, kind="stable")
        #: one row a dimension: positions, and the components in that order
        self.order = np.ascontiguousarray(by.T.astype(np.int64))
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.v, by, 0).T)
        self.low, high = (self.v.min(), self.v.max()) if whole.size else (0.0, 0.0)
        self.step = max((high - self.low) / PLACES, 1e-300)
        self.below = np.stack([np.searchsorted(x, self.low + self.step * np.arange(PLACES + 1)) for x in self.sorted]) if whole.size else None

    def _reach(self, share: float, q: np.ndarray, used: np.ndarray, up: np.ndarray, read: np.ndarray) -> np.ndarray:
        """Entries of each list, from its own end, that each query has read after a step: all lists of a query down to
        one level, the one that lists read alike would reach at this share."""
        n, dim = self.v.shape
        depth = max(1, int(share * n))
        if depth >= n:
            return np.where(used, n, 0)
        ends = np.where(up, self.sorted[:, n - depth], self.sorted[:, depth - 1]) * q
        level = ends.sum(1, keepdims=True) / used.sum(1, keepdims=True) / np.where(used, q, 1)
        place = np.clip(np.ceil((level - self.low) / self.step), 0, PLACES).astype(np.int64)
        below = self.below[np.arange(dim), place]
        return np.where(used, np.maximum(read, np.where(up, n - below, below)), 0)

    def _met(self, read: np.ndarray, reach: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Rows (query, row) that stand in the entries between read and reach; a list read to its end shows every row."""
        n, dim = self.v.shape
        ended = (reach == n).any(1)
        size = np.where(ended[:, None], 0, reach - read).ravel()
        first = (np.where(up, n - reach, read) + np.arange(dim) * n).ravel()
        runs = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of = np.repeat(np.repeat(np.arange(len(reach)) * n, dim), size)
        met = np.zeros((len(reach), n), bool)
        met.ravel()[of + self.order.ravel()[runs]] = True
        met[ended] = True
        return met

    def walk(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, scores, reads) of the k best but row own[i] of each query i; position -1 where there are fewer.
        reads: entries read, rows met, and whether the bound stopped the query.

        The queries walk their lists side by side, a step at a time.  What any of them newly meets is scored by one
        matrix product (of the block as it lies once that is more than half of it); a query sees of it what it has met
        itself, and leaves by its own bound."""
        n, dim = self.v.shape
        exact = dim * self.most * float(np.abs(queries).max(initial=0.0))
        if exact >= 2.0**53:
            raise ValueError("components are too large for exact scores")
        v = self.narrow if self.narrow is not None and exact < 1 << 24 else self.v
        q = queries.astype(np.float64)
        weights, used, up = q.astype(v.dtype), q != 0, q > 0
        unseen = self.keys[None, :] != own[:, None]
        others = unseen.sum(1)
        left, read = others.copy(), np.zeros(q.shape, np.int64)
        at, best = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        scores, scored = np.zeros((len(q), n), v.dtype), np.zeros(n, bool)
        walking = np.flatnonzero(used.any(1) & (left > 0))
        for share in SHARES:
            if not len(walking):
                break
            own_used, own_up = used[walking], up[walking]
            reach = self._reach(share, q[walking], own_used, own_up, read[walking])
            new = self._met(read[walking], reach, own_up) & unseen[walking]
            unseen[walking] &= ~new
            read[walking] = reach
            fresh = new.any(0) & ~scored
            if 2 * np.count_nonzero(fresh) > n:
                scores[walking] = weights[walking] @ v.T
                scored[:] = True
            elif fresh.any():
                scores[np.ix_(walking, np.flatnonzero(fresh))] = weights[walking] @ v[fresh].T
                scored |= fresh
            self._keep(np.where(new, scores[walking], -np.inf), walking, at, best, k)
            left[walking] -= new.sum(1)
            over = (left[walking] == 0) | (reach == n).any(1)
            beyond = np.where(own_up, n - 1 - reach, reach)
            following = self.sorted[np.arange(dim), np.clip(beyond, 0, n - 1)]
            bound = np.where(own_used, following * q[walking], 0).sum(1)
            stopped = (at[walking, k - 1] >= 0) & (bound < best[walking, k - 1])
            walking = walking[~(over | stopped)]
        for i in np.flatnonzero(~used.any(1)):  # a query of zeros reads no list: all scores are 0, the smallest ids are best
            found = np.flatnonzero(unseen[i])[:k]
            at[i, : len(found)], best[i, : len(found)] = found, 0
        return at, best, np.stack([read.sum(1), others - left, left > 0], 1)

    @staticmethod
    def _keep(seen: np.ndarray, walking: np.ndarray, at: np.ndarray, best: np.ndarray, k: int) -> None:
        """Take the newly met scores (-inf: not met) into the k best of each walking query, by score, then position."""
        n = seen.shape[1]
        least = best[walking, k - 1]
        open_ = np.flatnonzero(np.isneginf(least))
        if len(open_) and n > k:
            least[open_] = np.partition(seen[open_], n - k, axis=1)[:, n - k]
        i, row = np.nonzero((seen >= least[:, None]) & (seen > -np.inf))
        held, place = np.nonzero(at[walking] >= 0)
        who = np.concatenate([i, held])
        rows = np.concatenate([row, at[walking[held], place]])
        score = np.concatenate([seen[i, row], best[walking[held], place]])
        order = np.lexsort((rows, -score, who))
        who, rows, score = who[order], rows[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < k
        at[walking[who[kept]], rank[kept]] = rows[kept]
        best[walking[who[kept]], rank[kept]] = score[kept]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int):
        """(query number, positions, scores, reads) of the k best of each query."""
        for first in range(0, len(queries), SIDE_BY_SIDE):
            at, best, reads = self.walk(own[first : first + SIDE_BY_SIDE], queries[first : first + SIDE_BY_SIDE], k)
            for i, (a, b, r) in enumerate(zip(at, best, reads, strict=True)):
                m = np.count_nonzero(a >= 0)
                yield first + i, a[:m], b[:m], r


OUT = "query_key long, query_id long, key long, vec_id long, score long, entries long, met long, stopped boolean"


def found_in_blocks(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", is_query=None, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_key, query_id, key, vec_id, score, entries, met, stopped): the k best of each query in each block, with
    what it read there; a query that finds nothing in a block gives no row."""
    rows = materialize(quantize(vectors, vec_id, embedding, scale))
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    queries = rows.where(is_query)
    n, nq = rows.count(), queries.count()
    blocks = max(1, -(-n // CANDIDATE_BLOCK))
    groups = max(1, -(-nq // (QUERY_BLOCK * QUERY_GROUP)))
    q = _pack(queries, QUERY_BLOCK, nq, "q").select("dim", "keys", "ids", "vs", F.floor(F.col("block") / QUERY_GROUP).cast("int").alias("grp"), F.col("block").alias("part"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    c = _pack(rows, CANDIDATE_BLOCK, n, "c").withColumns({"part": F.lit(-1), "grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    order = ("block", "grp", "dim", "part")
    # the lists of a block come first (part -1), then the query blocks that read them
    both = c.select(*order, "keys", "ids", "vs").unionByName(q.select(*order, "keys", "ids", "vs"))
    both = both.repartition(max(1, min(4096, blocks * groups)), "block", "grp", "dim").sortWithinPartitions(*order)

    def search(batches):
        lists = at = None
        for batch in batches:
            for row in range(batch.num_rows):
                block, grp, dim, part = (batch[c][row].as_py() for c in order)
                get = lambda name, row=row, batch=batch: batch[name].slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                keys, ids, vs = get("keys"), get("ids"), get("vs").reshape(-1, dim)
                if part < 0:
                    lists, at = Lists(ids, vs, keys), (block, grp, dim)
                elif at == (block, grp, dim):
                    out = []
                    for i, found, score, reads in lists.search(keys, vs, k):
                        m = len(found)
                        out.append((np.full(m, keys[i]), np.full(m, ids[i]), lists.keys[found], lists.ids[found], score.astype(np.int64), np.full(m, reads[0]), np.full(m, reads[1]), np.full(m, reads[2])))
                    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in columns[:7]), pa.array(columns[7].astype(bool))], [x.split()[0] for x in OUT.split(", ")])

    return both.mapInArrow(search, OUT)


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", is_query=None, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row for which is_query holds, against all other rows."""
    found = found_in_blocks(vectors, vec_id, embedding, is_query, k, scale).select("query_key", "query_id", "key", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
