"""Counts of hashed n-grams over a whole corpus, in a table of fixed size.

Every task counts into CELLS cells and returns them compressed in PARTS parts; parts are summed by key.  The table is
what is sent to executors: 2 bytes a cell, 8 MB.  An n-gram's count is that of its cell, so never too low; counts are
kept as logarithms, so that they do not saturate.  Operators use the table only to order n-grams from rare to frequent;
any table gives right results.  One with many n-grams a cell no longer tells rare from frequent ones, so table_bits
gives a wider one for a large corpus: a byte a cell, 64 MB at most.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix

CELL_BITS, PARTS = 22, 64
CELLS = 1 << CELL_BITS
#: The widest table, and how many n-grams a cell should hold at most.
MOST_BITS, CELL_LOAD = 26, 20
#: Places of a set of keys (key_bits), as a power of two: 16 MB.
PLACE_BITS = 27


def cells(h: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def table_bits(grams: int) -> int:
    """Cells of a table for so many n-grams, as a power of two: at most CELL_LOAD n-grams a cell, up to the widest table."""
    return min(MOST_BITS, max(CELL_BITS, (max(1, grams) // CELL_LOAD).bit_length()))


def corpus_counts(texts: DataFrame, hashes, bits: int = CELL_BITS) -> np.ndarray:
    """Counts by cell as logarithms; texts has one string column; hashes(array of texts) yields arrays of hashes.

    Tables of CELL_BITS: uint16, 1024 a power of two.  Wider ones: uint8, 8 a power of two; a task counts to 255 there."""
    wide, size = bits > CELL_BITS, 1 << bits
    each = CELLS // PARTS  # cells of a part, whatever the table
    kind, step = (np.uint8, 8) if wide else (np.uint16, 1024)

    def put(table, found):
        at, n = np.unique(np.concatenate(found), return_counts=True)
        table[at] = np.minimum(table[at] + n, 255)

    def count(batches):
        table, found, held = np.zeros(size, np.uint8 if wide else np.uint32), [], 0
        for batch in batches:
            for h in hashes(batch.column(0)):
                if wide:
                    found.append(cells(h, bits))
                    held += len(h)
                    if held > CELLS // 8:
                        put(table, found)
                        found, held = [], 0
                elif len(h) * 8 > size:
                    table += np.bincount(cells(h, bits), minlength=size).astype(np.uint32)
                else:
                    np.add.at(table, cells(h, bits), 1)
        if found:
            put(table, found)
        for lo in range(0, size // each, PARTS):
            parts = [(lo + i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(table[lo * each : (lo + PARTS) * each].reshape(PARTS, -1)) if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["part", "counts"])

    def add(key, frames):
        total = np.zeros(each, np.uint64)
        for pdf in frames:
            for c in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(c), np.uint8 if wide else np.uint32)
        steps = np.minimum(np.log2(1.0 + total) * step, np.iinfo(kind).max).astype(kind)
        yield pd.DataFrame({"part": [int(key[0])], "counts": [zlib.compress(steps.tobytes(), 1)]})

    rows = texts.mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(lambda key, pdf: next(add(key, [pdf])), "part int, counts binary")
    out = np.zeros((size // each, each), kind)
    for r in rows.collect():  # as many rows of fixed size as the table has parts
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), kind)
    return out.reshape(-1)


def key_bits(keys: DataFrame) -> np.ndarray:
    """A set of keys (one long column) as 2 ** PLACE_BITS bits at hashed places, of a fixed size like the table of counts.

    may_hold says yes for every key of it, and for few others while the keys are fewer than a tenth of the places."""
    size = 1 << (PLACE_BITS - 3)

    def mark(batches):
        table = np.zeros(size, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy().view(np.uint64))
            np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(table.reshape(PARTS, -1)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["part", "bits"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(size // PARTS, np.uint8)
        for b in pdf["bits"]:
            table |= np.frombuffer(zlib.decompress(b), np.uint8)
        return pd.DataFrame({"part": [int(pdf["part"][0])], "bits": [zlib.compress(table.tobytes(), 1)]})

    out = np.zeros((PARTS, size // PARTS), np.uint8)
    for r in keys.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInPandas(unite, "part int, bits binary").collect():  # PARTS rows of fixed size
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out.reshape(-1)


def _places(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the set that bits were made of may hold each key (uint64)."""
    at = _places(keys)
    return (bits[at >> 3] >> (at & 7)) & 1 > 0
