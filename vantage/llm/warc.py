"""WARC archives: write pages as records with revisits, and read archives back by boundary-chain verification.

Writing: equal payloads of at least MIN_BYTES bytes are stored once, in the record of the largest page id; the others
are `revisit` records that refer to it.  Records are lines of Spark's text writer, so any file system that Spark
reaches will do, and a lost task is written again.

Reading: an archive is split at the version line `WARC/1.0`, which may also stand inside a payload.  Tasks turn each
piece into a candidate: its offset and, from its Content-Length, the offset of its successor.  Offsets within a split
are summed to offsets in the file.  Per file, pointer jumping from the start (successor of successor, doubled until it
settles) keeps exactly the candidates that are reached; the rest are text inside payloads.  Payloads of reached
records that hold such text are put together from their pieces in a second pass over those pieces alone.

Edge cases: a null page is an empty payload; empty payloads are equal to each other; control characters in a url are
percent-encoded, a null url is empty; rows of a repeated page id and payload are all responses if that id is the
largest; a null page id never is the largest and is read back as null; an empty table gives no records.  Files are
those of the written partitions: per file, candidates (not payloads) are held in one task.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, scratch_dir, small_batches

MIN_BYTES = 0
MAGIC = b"WARC/1.0\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case Base32 of the SHA-1 of a string: 160 bits are 32 digits, from 4 groups of 10 hexadecimal digits."""
    hexes = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """One record for each row of pages, in uncompressed archives under path."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL")
    shared = bounded(materialize(shared.select(F.col("digest").alias("d"), "original")))
    rows = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") >= min_bytes), "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    # rows of a repeated page id have ids of their own, but for the response that revisits name: its id is the page's
    own = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.when(revisit, F.monotonically_increasing_id().cast("string")))
    uuid = lambda name: F.regexp_replace(F.md5(name), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    safe_url = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid(own), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:uuid:"), uuid(F.col("original").cast("string")), F.lit(">\r\nX-Refers-To-Page: "), F.col("original").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    text = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n"))
    rows.select(text.alias("value")).write.option("lineSep", "\r\n").text(path)  # the writer adds the last line end


def _pieces(spark, path: str) -> DataFrame:
    """(value, file, block): what stands between version lines, in order within a split."""
    small_batches(spark)
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def parse_header(piece: bytes) -> dict | None:
    """Fields of a record whose version line is taken off, with `header` (bytes up to the payload); None if it is none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(k.strip().lower().decode("latin-1"), v.strip().decode("utf-8", "replace"))
    if not fields.get("content-length", "").isdigit():
        return None
    return fields | {"header": end + 4}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


_SCAN = "file string, block long, seq long, rel long, size long, header long, length long, whole boolean, type string, page_id long, refers_to long, stated_digest string, stated_bytes long, digest string"


def _scan(batches):
    names = [x.split()[0] for x in _SCAN.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = [kinds[x.split()[1]] for x in _SCAN.split(", ")]
    at: dict[tuple, tuple[int, int]] = {}
    number = lambda s: int(s) if s and s.lstrip("-").isdigit() else None
    for batch in batches:
        rows = []
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seq, rel = at.get((file, block), (0, 0))
            at[file, block] = (seq + 1, rel + len(value) + len(MAGIC))
            h = parse_header(value) or {}
            start, length = h.get("header"), number(h.get("content-length"))
            whole = start is not None and start + length + 4 == len(value) and value.endswith(b"\r\n\r\n")
            rows.append((file, block, seq, rel, len(value) + len(MAGIC), start, length, whole, h.get("warc-type"), number(h.get("x-page-id")), number(h.get("x-refers-to-page")), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, number(h.get("x-payload-length")), digest_of(value[start : start + length]) if whole else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def reachable(start: np.ndarray, succ: np.ndarray, first: int) -> np.ndarray:
    """Which candidates the chain from `first` reaches. start is sorted; succ: offsets of successors (-1: none).

    Pointer jumping: the set reached within 2^k steps is extended by jumps of 2^k steps, k = 0, 1, ..."""
    n = len(start)
    at = np.searchsorted(start, succ)
    ok = (at < n) & (succ >= 0)
    ok[ok] = start[at[ok]] == succ[ok]
    jump = np.append(np.where(ok, at, n), n)  # n: outside
    reached = np.zeros(n + 1, bool)
    reached[:-1] = start == first
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        more[n] = False
        if (jump[:-1] == n).all():
            return more[:-1]
        reached, jump = more, jump[jump]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidates, those reached from the start."""
    pdf = pdf.sort_values("start", ignore_index=True)
    has = pdf["header"].notna() & pdf["length"].notna()
    step = pdf["header"].fillna(0) + pdf["length"].fillna(0) + 4 + len(MAGIC)
    succ = np.where(has, pdf["start"] + step, -1).astype(np.int64)
    return pdf[reachable(pdf["start"].to_numpy(np.int64), succ, len(MAGIC)) & has.to_numpy()]


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives under path.

    A record's payload digest and length are computed from its payload; a revisit has those of the response that it
    refers to, and it is an error if that is missing or if the revisit states others."""
    pieces = _pieces(spark, path)
    found = materialize(pieces.mapInArrow(_scan, _SCAN))
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(sizes.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
    base = bounded(base)
    placed = found.join(base, ["file", "block"]).withColumn("start", F.col("base") + F.col("rel"))
    kept = placed.select("file", "start", "header", "length", "whole", "type", "page_id", "refers_to", "stated_digest", "stated_bytes", "digest")
    kept = materialize(kept.groupBy("file").applyInPandas(_chain, kept.schema))
    torn = kept.where(~F.col("whole"))
    result = kept.where("whole").select("page_id", F.col("length").alias("bytes"), "digest", "type", "refers_to", "stated_bytes", "stated_digest")
    if torn.limit(1).count():
        result = result.unionByName(_mended(pieces, base, torn))
    result = materialize(result)
    stored = F.col("type") == "revisit"
    full = result.where(~stored).groupBy(F.col("page_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.max("bytes").alias("of_bytes"))
    full = materialize(full.join(result.where(stored).select(F.col("refers_to").alias("of"), F.col("stated_digest").alias("of_digest")).distinct(), ["of", "of_digest"]))
    again = result.where(stored).join(bounded(full), (F.col("refers_to") == F.col("of")) & (F.col("stated_digest") == F.col("of_digest")), "left")
    fault = F.raise_error(F.concat(F.lit("revisit without its response: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    size = F.when(F.col("of_bytes") == F.col("stated_bytes"), F.col("of_bytes")).otherwise(fault)
    again = again.select("page_id", size.alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    first = result.where(~stored).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)


def _mended(pieces: DataFrame, base: DataFrame, torn: DataFrame) -> DataFrame:
    """Digests of records whose payload holds version lines: their pieces in order, with the lines put back."""

    def number(batches):
        at: dict[tuple, int] = {}
        for batch in batches:
            rel = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rel.append(at.get((file, block), 0))
                at[file, block] = rel[-1] + len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())], ["value", "file", "block", "rel"])

    rows = pieces.mapInArrow(number, "value binary, file string, block long, rel long").join(base, ["file", "block"])
    rows = rows.select("file", (F.col("base") + F.col("rel")).alias("at"), "value")
    owner = torn.select(F.col("file").alias("f"), "start", "header", "length", "type", "page_id", "refers_to", "stated_digest", "stated_bytes")
    inside = (F.col("file") == F.col("f")) & (F.col("at") >= F.col("start")) & (F.col("at") - len(MAGIC) < F.col("start") + F.col("header") + F.col("length"))
    rows = rows.join(bounded(owner), inside).select("f", "start", "header", "length", "type", "page_id", "refers_to", "stated_digest", "stated_bytes", "at", "value")

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        first = pdf.iloc[0]
        whole = MAGIC.join(pdf["value"])
        payload = whole[int(first["header"]) : int(first["header"] + first["length"])]
        out = pdf.iloc[:1][["page_id", "type", "refers_to", "stated_bytes", "stated_digest"]].copy()
        return out.assign(bytes=len(payload), digest=digest_of(payload))

    return rows.groupBy("f", "start").applyInPandas(mend, "page_id long, bytes long, digest string, type string, refers_to long, stated_bytes long, stated_digest string")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch_dir(spark)
    write_archives(pages, path)
    return read_archives(spark, path)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
g AS (SELECT list_transform(range(0, 4), lambda i: ('0x' || substr(h, (1 + 10 * i)::INTEGER, 10))::BIGINT) AS g, * FROM d),
b AS (SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((g[i // 8 + 1] >> ((7 - i % 8) * 5)::INTEGER) & 31))::INTEGER, 1)), '') AS payload_digest FROM g),
m AS (SELECT payload_digest, max(page_id) AS original FROM b WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, b.payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM b LEFT JOIN m ON b.payload_digest = m.payload_digest AND payload_bytes >= {MIN_BYTES}
"""
