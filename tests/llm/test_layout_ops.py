"""Vector codes, sharding and the filter audit, against brute force, with odd rows."""

import random
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import audit, quantize, sharding

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(vectors, parts, entries, rounds):
    """{row: (code, error)} and the codebooks, by comparing every part with every entry; vectors are integers."""
    dim = len(vectors[0])
    at = [j * dim // parts for j in range(parts + 1)]
    books = [[list(v[at[j] : at[j + 1]]) for v in vectors[:entries]] for j in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for j, book in enumerate(books):
            own = defaultdict(list)
            for v in vectors:
                own[nearest(v[at[j] : at[j + 1]], book)[1]].append(v[at[j] : at[j + 1]])
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(v[at[j] : at[j + 1]], book) for j, book in enumerate(books)] for v in vectors]
    return [("".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for x in found], books


@pytest.mark.parametrize(("dim", "entries", "rounds"), [(8, 16, 3), (11, 5, 2), (3, 4, 1)])
def test_codes_equal_a_full_search(spark, dim, entries, rounds):
    rng = np.random.default_rng(dim)
    raw = np.round(rng.normal(0, 0.02, (90, dim)), 3)
    raw[40:60] = raw[3]  # copies, and ties between entries
    raw[60:70] *= -1
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i % 3) if i % 7 else None) for i, v in enumerate(raw)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).repartition(5)
    got = {r["vec_id"]: r for r in quantize.compress(df, entries=entries, rounds=rounds).collect()}
    whole = [[int(np.floor(4096 * float(np.float32(x)))) for x in v] for v in raw]
    want, books = brute_codes(whole, 8, entries, rounds)
    assert [(got[i]["code"], got[i]["error"]) for i in range(90)] == want
    sums = defaultdict(int)
    for i, (_, e) in enumerate(want):
        sums[got[i]["label"]] += e
    assert all(got[i]["label_error"] == sums[got[i]["label"]] for i in range(90)) and None in sums
    assert {r["codebooks_sha256"] for r in got.values()} == {quantize.digest([np.array(b, np.int64) for b in books])}


def test_annulus_leaves_most_entries_out():
    rng = np.random.default_rng(5)
    book = quantize.Codebook(np.floor(rng.normal(0, 1, (256, 4)) * np.arange(1, 257)[:, None] * 10))
    x = np.floor(rng.normal(0, 1, (3000, 4)) * rng.integers(1, 257, (3000, 1)) * 10)
    entry, best, compared = book.nearest(x)
    d = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (best == d.min(1)).all() and compared < 0.5 * d.size


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [0.1] * 8, 1), (5, [0.1] * 8, 1), (None, [0.2] * 8, None), (2, [nan] + [0.0] * 7, 1), (3, [0.0, None] * 4, 1), (4, None, 1), (6, [], 1), (7, [inf] * 8, 1), (8, [0.1] * 3, 2), (1, [-0.1] * 8, 2)]
    got = sorted((str(r["vec_id"]), r["code"], r["error"]) for r in quantize.compress(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [("1", "00" * 8, 0), ("5", "01" * 8, 0), ("5", "01" * 8, 0), ("None", "03" * 8, 0)]
    none = quantize.compress(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="too large"):
        quantize.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS))


def plain_best_fit(sizes, capacity, shards):
    room, out = [capacity] * shards, []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if not fits:
            return None
        room[min(fits)[1]] -= s
        out.append(min(fits)[1])
    return out


def test_tree_and_runs_equal_placing_one_by_one():
    rng = random.Random(3)
    tree, keys = sharding.Tree(), set()
    for _ in range(3000):
        k = (rng.randrange(60), rng.randrange(5))
        if k in keys:
            keys.remove(k)
            tree.remove(k)
        else:
            keys.add(k)
            tree.insert(k)
        b = (rng.randrange(70), -1)
        assert tree.ceiling(b) == min((x for x in keys if x >= b), default=None)
    assert tree.root is None or tree.root[3] <= 12
    for _ in range(200):
        sizes = sorted((rng.choice([3, 5, 8, 8, 13, 40, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 60))), reverse=True)
        shards, capacity = rng.randrange(1, 8), rng.randrange(max(sizes), 200)
        runs = sharding.best_fit([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], capacity, shards)
        got = None if runs is None else [s for n, s in runs for _ in range(n)]
        assert got == plain_best_fit(sizes, capacity, shards)


def test_even_shards():
    rng = random.Random(8)
    sizes = [(s, rng.randrange(1, 9)) for s in sorted(rng.sample(range(16, 3000), 300), reverse=True)]
    runs = sharding.even(sizes, 40)
    flat = [s for s, n in sizes for _ in range(n)]
    assert sum(n for n, _ in runs) == len(flat)
    load = defaultdict(int)
    for s, i in zip(flat, [i for n, i in runs for _ in range(n)], strict=True):
        load[i] += s
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= 0.01 * max(load.values())
    big = sharding.even([(10_000, 1), (9_000, 1), (100, 30)], 5)  # the two large ones alone, the rest shared evenly
    assert big == [(1, 0), (1, 1), (10, 2), (10, 3), (10, 4)]
    assert sharding.best_fit([(50, 1), (30, 3), (10, 2)], 40) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 1), (1, 2)]


def test_pack(spark):
    rng = random.Random(1)
    texts = [f"text {i} " + "é" * rng.randrange(900) for i in range(300)] + ["copy " * 20] * 150 + [None, None, "", "", "z" * 200_000]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("n", F.lit(0)).repartition(6)
    got = sharding.pack(docs, shards=7).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        by[r["shard"]].append(r)
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(x) == 1 for k, x in shard_of.items() if k[0])  # null and empty texts are two groups
    for own in by.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert ids == sorted(ids)
    load = sorted(sum(r["size"] for r in own) for own in by.values())
    assert len(load) == 7 and load[-1] >= 200_000 and load[-2] - load[0] <= 0.02 * load[0]
    fixed = sharding.pack(docs, shards=None, capacity=20_000).collect()
    load = defaultdict(int)
    for r in fixed:
        load[r["shard"]] += r["size"]
    assert sorted(load.values())[-2] <= 20_000 and len(load) <= 2 + -(-(sum(load.values()) - 200_016) // 20_000)
    assert sharding.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_audit(docs, labels):
    """Every order replayed over every document."""
    def fails(i, t):
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        out = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "")
        out += ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else "") + ("D" if set(t) & set("#$%&*|") else "")
        return out + ("E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else "")

    rows = [(s or "", fails(i, t), any(j == i is not None and q == 1 for j, q, _ in labels), any(j == i is not None and x == 1 for j, _, x in labels)) for i, t, s in docs]
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                late = sum(f in r[1] and bool(set(r[1]) & set(order[:k])) for r in rows if r[0] == part)
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), late, sum(r[1] == f for r in rows if r[0] == part), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_a_replay_of_every_order(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "x#y", "delta", f"w{rng.randrange(300)}"])
    texts = [" ".join(word() for _ in range(rng.choice([3, 48, 50, 70, 200]))) for _ in range(50)] + [None, "", " \t", "A", "é" * 30, "long word " * 3000, "a b " * 60]
    docs = [(i, rng.choice(texts), rng.choice(["web", "code", None, ""])) for i in range(120)]
    docs += [docs[7], docs[7], (None, texts[0], "web"), (None, texts[0], "web"), (500, texts[0], "solo")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n", F.lit("clash")).withColumn("part", F.lit(3)).repartition(5)
    found = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    assert got == brute_audit(docs, labels) and len(got) == 4 * 600
    empty = audit.audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0
