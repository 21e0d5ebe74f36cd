"""Removal of repeated passages by suffix automata of reference shards.

A window is WINDOW consecutive words of one document; a word goes if a window covers it whose words also stand in a
document with a smaller id.  Windows that can repeat are found first: the least word ANCHOR-gram of a window, in an
order of all ANCHOR-grams that puts rare ones first (sketch.py), is its anchor, and equal windows have equal anchors
at the same place.  Anchors that occur in several documents name the shards.  The run of windows with one anchor is a
passage; equal passages are made one before they meet (their words, the smallest id that has them, the largest).  A
task holds one shard at a time: it streams the distinct passages in order of smallest id through the suffix automaton
of those before them.  Where the matching statistic (the longest match that ends at a word) reaches WINDOW, the window
that ends there is removed.  A passage that adds something is then put into the automaton.  The spans found hold for
the passage's first document; in all others the whole passage repeats.  They are joined back to the places of the passage.

The reference is as large as what repeats in the corpus, which has no bound; so shards are not broadcast, but brought
together with the passages to test by a shuffle on the anchor.  A frequent passage costs one row a task before the
shuffle and one row after it.  Anchors in very many documents (HOT_DOCS, or HOT_SHARE of all) are put last in the
order, by exact counts, and the windows that had them take their next rarest: what still has such an anchor are
windows of frequent n-grams only, which are few distinct passages.

Edge cases: a null text has no words; words are compared unchanged; texts shorter than a window lose nothing; rows of
one id are not compared with each other; rows with a null id are kept whole and are no reference; ids of any type
that has an order will do; repeated rows are judged each and meet as one; windows are judged on the input; an empty
table gives an empty table.  Extra columns are carried along by `remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, bounded, inside, materialize, mix, packed, slices, small_batches, unpacked, utf8, windows
from .sketch import PLACE_BITS, cells, corpus_counts, key_bits, may_hold

WINDOW, ANCHOR = 50, 10
#: Words that one vectorised step may number.
_PLACES = 22
#: An anchor is hot if it is in more documents than this, and than this share of all (document, anchor) pairs.
HOT_DOCS, HOT_SHARE = 1000, 1e-6
#: Up to so many shared anchors are told from others by a set of bits of fixed size, so that no text is shuffled.
MOST_BIT_KEYS = (1 << PLACE_BITS) // 8


class Automaton:
    """Generalized suffix automaton of word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                last = cur
                if p < 0:
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
            else:
                p, cur = last, None
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            if cur is None:
                last = clone
            else:
                link[cur] = clone

    def matching_statistics(self, words):
        """For each word, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.len
        at = n = 0
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                n = length[at]
            q = nxt[at].get(w)
            if q is None:
                n = 0
            else:
                at, n = q, n + 1
            yield n


def removed(automaton: Automaton, words: list, window: int) -> list[tuple[int, int]]:
    """Maximal spans of words that windows with a match in the automaton cover."""
    spans: list[list[int]] = []
    for i, n in enumerate(automaton.matching_statistics(words)):
        if n >= window:
            if spans and i + 1 - window <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i + 1 - window, i + 1])
    return [(a, b) for a, b in spans]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, width = x, 1
    while 2 * width <= w:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    return np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1]) if width < w else out


def anchors(h: np.ndarray, first: np.ndarray, counts: np.ndarray, window: int, anchor: int, hot: np.ndarray | None = None):
    """Of the windows inside texts: (text, anchor hash, first window, last window, moved) of each run with one anchor.

    hot: sorted hashes that come last in the order; moved tells of a run whether it has a window that lost such an anchor."""
    none = np.zeros(0, np.int64)
    at, row = inside(first, window, len(h))
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    grams = windows(h, anchor)
    place = np.arange(len(grams), dtype=np.uint64)
    # 16 bits of count, 26 of the hash, then the place: the leftmost of equals
    key = (counts[cells(grams)].astype(np.uint64) << np.uint64(48)) | ((mix(grams) >> np.uint64(38)) << np.uint64(_PLACES)) | place
    least = lambda key: (sliding_min(key, window - anchor + 1)[at] & np.uint64((1 << _PLACES) - 1)).astype(np.int64)
    low = least(key)
    moved = np.zeros(len(at), bool)
    if hot is not None and len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
        if is_hot.any():
            moved = is_hot[low]
            low = least(np.where(is_hot, key | (np.uint64(0xFFFF) << np.uint64(48)), key))
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(at)) - 1
    return row[start], grams[low[start]], at[start], at[end], np.logical_or.reduceat(moved, start)


def _chunks(array: pa.Array):
    """(number of the first row, Words) of consecutive rows of about SLICE_BYTES."""
    data, off = utf8(array)
    for lo, hi in slices(off, SLICE_BYTES):
        w = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, w


def _parts(w: Words, window: int):
    """Word ranges of at most 2**_PLACES words that together hold every window."""
    n, step = len(w.hash), (1 << _PLACES) - window
    if n <= step:
        yield 0, n
    else:
        for a in range(0, n - window + 1, step - window + 1):
            yield a, min(n, a + step)


def passages(array: pa.Array, counts: np.ndarray, window: int, anchor: int, hot: np.ndarray | None = None):
    """(first row, words w, row, anchor, first word in w, word after the last in w, moved): each anchor's run of windows."""
    for lo, w in _chunks(array):
        for a, b in _parts(w, window):
            first = np.clip(w.first - a, 0, b - a)
            row, gram, start, end, moved = anchors(w.hash[a:b], first, counts, window, anchor, hot)
            yield lo, w, row, gram, start + a, end + a + window, moved


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_docs: int = HOT_DOCS, most_bit_keys: int = MOST_BIT_KEYS) -> DataFrame:
    """(id, text_key, spans): for each row with repeated passages, the word ranges to remove (flat: start, end, ...)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    id_type = dict(docs.dtypes)["id"]

    def grams(array):
        for _, w in _chunks(array):
            at, _row = inside(w.first, anchor, len(w.hash))
            yield windows(w.hash, anchor)[at]

    counts = spark.sparkContext.broadcast(corpus_counts(docs.select("text"), grams))

    def candidates(batches):
        for batch in batches:
            for lo, _w, row, gram, *_ in passages(batch.column(2), counts.value, window, anchor):
                if len(row):
                    pairs = np.unique(np.stack([gram.view(np.int64), lo + row], 1), axis=0)
                    at = pa.array(pairs[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), batch.column(0).take(at), batch.column(1).take(at)], ["anchor", "id", "text_key"])

    pairs = materialize(docs.mapInArrow(candidates, f"anchor long, id {id_type}, text_key long"))
    shared = pairs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", "n")
    shared = materialize(shared)
    least = max(hot_docs, int(HOT_SHARE * pairs.count()))
    hot = [r["anchor"] for r in shared.where(F.col("n") > least).select("anchor").collect()]  # at most 1 / HOT_SHARE numbers
    hot = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))
    few = shared.count() <= most_bit_keys
    bits = spark.sparkContext.broadcast(key_bits(shared.select("anchor"))) if few else None

    def cut(batches):
        for batch in batches:
            at, out = [], []
            for lo, w, row, gram, start, end, moved in passages(batch.column(2), counts.value, window, anchor, hot.value):
                if few:
                    keep = np.flatnonzero(moved | may_hold(bits.value, gram))
                else:  # rows come with their shared anchors
                    want = {i: set(batch.column(3)[i].as_py()) for i in set((lo + row).tolist())}
                    keep = [k for k, (r, g) in enumerate(zip((lo + row).tolist(), gram.view(np.int64).tolist(), strict=True)) if moved[k] or g in want[r]]
                raw = w.data.tobytes()
                for r, g, s, e in zip(*(x[keep].tolist() for x in (row, gram.view(np.int64), start, end)), strict=True):
                    at.append(lo + r)
                    # texts differ in what stands between words: passages are compared by words with single spaces
                    words = b" ".join(raw[w.start[s] : w.end[e - 1]].split())
                    out.append((g, hashlib.blake2b(words, digest_size=16).digest(), s - int(w.first[r]), e - s, words))
                if len(out) >= 5000:
                    yield batch_of(batch, at, out)
                    at, out = [], []
            yield batch_of(batch, at, out)

    def batch_of(batch, at, out):
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        rows = pa.array(at, pa.int64())
        own = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *own], ["id", "text_key", "anchor", "passage", "start", "n", "words"])

    places = docs
    if not few:
        wanted = pairs.join(shared.select("anchor"), "anchor", "left_semi").groupBy("id", "text_key").agg(F.collect_set("anchor").alias("wanted"))
        wanted = wanted.toDF("wid", "wkey", "wanted")
        places = docs.join(wanted, (F.col("id") == F.col("wid")) & (F.col("text_key") == F.col("wkey"))).select("id", "text_key", "text", "wanted")
    places = materialize(places.mapInArrow(cut, f"id {id_type}, text_key long, anchor long, passage binary, start long, n long, words binary"))
    distinct = places.groupBy("anchor", "passage", "words").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("n").alias("n"))
    distinct = distinct.select("anchor", "first", "passage", "n", (F.col("first") < F.col("last")).alias("several"), "words")
    distinct = distinct.repartition("anchor").sortWithinPartitions("anchor", "first", "passage")

    def stream(batches):
        held = automaton = None
        waiting: list[list[bytes]] = []  # passages of the current id, not yet put in
        for batch in batches:
            keep, own = [], []
            for i, (a, first, n, several, raw) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True)):
                if held is None or held[0] != a:
                    automaton, waiting = Automaton(), []
                elif held[1] != first:
                    for w in waiting:
                        automaton.add(w)
                    waiting = []
                held = (a, first)
                words = raw.split(b" ")
                spans = removed(automaton, words, window) if len(automaton.next) > 1 else []
                if spans != [(0, n)]:
                    waiting.append(words)
                if spans or several:
                    keep.append(i)
                    own.append([x for span in spans for x in span])
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), batch.column(1).take(rows), pa.array(own, pa.list_(pa.int64()))], ["found", "first", "own"])

    found = materialize(distinct.mapInArrow(stream, f"found binary, first {id_type}, own array<long>"))
    places = places.select("id", "text_key", "passage", "start", "n").join(bounded(found), F.col("passage") == F.col("found"))
    whole = F.array(F.col("start"), F.col("start") + F.col("n"))
    spans = F.when(F.col("id") == F.col("first"), F.transform("own", lambda x: x + F.col("start"))).otherwise(whole)
    spans = places.select("id", "text_key", spans.alias("spans")).where(F.size("spans") > 0)
    ends = F.transform(F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", i * 2).alias("a"), F.get("spans", i * 2 + 1).alias("b")))
    spans = spans.select("id", "text_key", F.explode(ends).alias("s")).groupBy("id", "text_key").agg(F.array_sort(F.collect_set("s")).alias("s"))
    merged = F.aggregate(
        "s",
        F.array().cast("array<struct<a: bigint, b: bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )
    flat = F.flatten(F.transform(merged, lambda x: F.array(x["a"], x["b"])))
    return materialize(spans.select("id", "text_key", flat.alias("spans")))


def keep_words(text: str | None, spans) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside the spans."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not spans:
        return len(words), words
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept += words[at:a]
        at = b
    return len(words), kept + words[at:]


def with_spans(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(row, id, text, spans) of every row of docs; spans is null where nothing repeats.

    Only rows that may have spans (by a set of bits of fixed size) are joined with them, by a shuffle at every size; no
    other text is shuffled."""
    spans = repeated_spans(docs, doc_id, text, window).toDF("span_id", "span_key", "spans")
    key = lambda i, k: F.xxhash64(i, k)
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(spans.select(key("span_id", "span_key"))))
    rows = packed(docs, id=F.col(f"`{doc_id}`"), text=F.col(f"`{text}`"))

    @F.pandas_udf("boolean")
    def may_have(keys):
        import pandas as pd

        return pd.Series(may_hold(bits.value, keys.to_numpy().view(np.uint64)))

    flagged = may_have(key(F.col("id"), F.xxhash64("text")))
    some = rows.where(flagged).join(spans.hint("merge"), (F.col("id") == F.col("span_id")) & (F.xxhash64("text") == F.col("span_key")), "left").drop("span_id", "span_key")
    return some.union(rows.where(~flagged).withColumn("spans", F.lit(None).cast("array<long>")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of text; what is kept is joined by single spaces where words went, and
    texts that lose nothing stay as they are."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None else b" ".join(keep_words(t, list(s))[1]).decode("utf-8", "surrogatepass") for t, s in zip(texts, spans, strict=True)])

    out = with_spans(docs, doc_id, text, window).withColumn("kept", cut(F.col("text"), F.col("spans")))
    return unpacked(out, docs.columns, **{text: F.col("kept")})


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def digest(batches):
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, kept = keep_words(t, s)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = with_spans(docs, doc_id, text, window).select(F.col("id").alias("doc_id"), "text", "spans")
    return out.mapInArrow(digest, f"doc_id {dict(out.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS k FROM w)),
m AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, k + j AS pos FROM x JOIN m USING (g), (SELECT unnest(range(0, {WINDOW})) AS j) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.pos = words.pos) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
