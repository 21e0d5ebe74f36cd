"""Language identification with a blended-spectrum presence kernel, Nystroem landmarks and kernel ridge regression.

Two texts compare by the character n-grams, n = 1 to 4, that occur in both: for each n the number of shared n-grams
over the root of the product of the two numbers of n-grams, blended over n with fixed weights.  n-grams are hashed
into a table per n, so a text is a 0/1 vector and a batch of kernel values is one matrix product.  Landmarks from the
labelled sample give Nystroem features; one-versus-rest ridge regression on them gives a value per language.

Edge cases: null texts and texts without a letter are `und` with score 0; texts of any length are read whole, in
segments of at most SEGMENT letters whose values are averaged by length; languages are those of the labelled sample
(some hundreds at most: the model has SAMPLE_PER_LANG texts of each);
without labelled rows all texts are `und`; repeated rows are classified each; of the labelled rows that share an id and a
language one is learned from, and rows without an id are not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, one_text, packed, small_batches, unpacked

#: At most so many labelled rows a language are learned from: a bounded sample, in order of a hash of the id.
SAMPLE_PER_LANG = 300
#: Longer texts are not learned from, so that the sample is bounded in bytes too; all texts are classified.
SAMPLE_BYTES = 1 << 18
LANDMARKS_PER_LANG = 24
ORDERS, BITS, WEIGHTS = (1, 2, 3, 4), 12, (0.1, 0.3, 0.3, 0.3)
RIDGE = 1e-2
#: Letters in a segment: a longer text fills the table of n-grams and is compared in segments.
SEGMENT = 2000
UNKNOWN = "und"

_MUL = np.uint32(0x9E3779B1)


def codes(text: str | None) -> np.ndarray:
    """Lower-case letters as numbers, all else a single gap; empty if there is no letter."""
    t = (text or "").lower()
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return c
    ascii_letter = (c >= 97) & (c <= 122)
    letter = ascii_letter.copy()
    other = np.flatnonzero(c > 127)
    if len(other):
        kinds, at = np.unique(c[other], return_inverse=True)
        letter[other] = np.array([chr(k).isalpha() for k in kinds])[at]
    if not letter.any():
        return c[:0]
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return c[keep]


def presence(c: np.ndarray) -> np.ndarray:
    """0/1 over the tables of the orders, side by side."""
    out = np.zeros(len(ORDERS) << BITS, np.float32)
    h = np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for i, n in enumerate(ORDERS):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x85EBCA6B) + c[n - 1 :] + np.uint32(n)
            out[(i << BITS) + ((h * _MUL) >> np.uint32(32 - BITS))] = 1
    return out


def scaled(X: np.ndarray) -> np.ndarray:
    """Rows scaled so that their products are kernel values."""
    X = X.reshape(len(X), len(ORDERS), 1 << BITS)
    size = X.sum(2, keepdims=True)
    X = X * (np.sqrt(np.array(WEIGHTS, np.float32))[None, :, None] / np.sqrt(np.maximum(size, 1)))
    return X.reshape(len(X), -1)


class Model:
    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, langs: list[str]):
        self.landmarks, self.weights, self.langs = landmarks.astype(np.float32), weights.astype(np.float32), langs

    def values(self, texts, batch: int = 256) -> np.ndarray:
        """Value per text and language; NaN rows for texts without a letter."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        rows, owner, length = [], [], []

        def flush():
            if rows:
                v = (scaled(np.stack(rows)) @ self.landmarks.T) @ self.weights
                np.add.at(total, owner, v * np.array(length)[:, None])
                rows.clear(), owner.clear(), length.clear()

        for i, t in enumerate(texts):
            c = codes(t)
            size[i] = len(c)
            for part in segments(c):
                rows.append(presence(part))
                owner.append(i)
                length.append(len(part))
                if len(rows) == batch:
                    flush()
        flush()
        with np.errstate(invalid="ignore", divide="ignore"):
            return total / size[:, None]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        v = self.values(texts)
        none = np.isnan(v).any(1)
        e = np.exp(4 * (np.nan_to_num(v) - np.nan_to_num(v).max(1, keepdims=True)))
        best = e.argmax(1)
        score = np.where(none, 0.0, e.max(1) / e.sum(1))
        return [UNKNOWN if u else self.langs[b] for b, u in zip(best, none, strict=True)], score


def segments(c: np.ndarray) -> list[np.ndarray]:
    """Equal parts of at most SEGMENT letters; none of an empty text."""
    parts = -(-len(c) // SEGMENT)
    return [c[len(c) * k // parts : len(c) * (k + 1) // parts] for k in range(parts)]


def fit(texts, langs) -> Model:
    """Landmarks: a segment of each of the first LANDMARKS_PER_LANG texts of each language. Fitted on all segments."""
    names = sorted(set(langs))
    parts, y, first = [], [], []
    for t, lang in zip(texts, langs, strict=True):
        own = segments(codes(t))
        first += [i == len(own) // 2 for i in range(len(own))]
        parts += own
        y += [names.index(lang)] * len(own)
    if not parts:
        return Model(np.zeros((0, len(ORDERS) << BITS)), np.zeros((0, 0)), [])
    y, first = np.array(y), np.array(first)
    names, y = [n for k, n in enumerate(names) if k in set(y)], np.unique(y, return_inverse=True)[1]
    marks = np.concatenate([np.flatnonzero(first & (y == k))[:LANDMARKS_PER_LANG] for k in range(len(names))])
    L = scaled(np.stack([presence(parts[i]) for i in marks]))
    values, vectors = np.linalg.eigh((L @ L.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    K = np.concatenate([scaled(np.stack([presence(c) for c in parts[i : i + 128]])) @ L.T for i in range(0, len(parts), 128)])
    phi = K.astype(np.float64) @ whiten
    share = np.bincount(y, minlength=len(names)).astype(float)
    weight = (len(y) / len(names) / share)[y]  # languages count alike
    Y = np.where(y[:, None] == np.arange(len(names)), 1.0, 0.0)
    P = phi * weight[:, None]
    W = np.linalg.solve(phi.T @ P + RIDGE * len(y) / len(names) * np.eye(phi.shape[1]), P.T @ Y)
    return Model(L, whiten @ W, names)


def train(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of the rows for which `learn` holds."""
    rows = docs.where(F.octet_length(f"`{text}`") <= SAMPLE_BYTES).where(learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    rows = rows.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("y"), F.col(f"`{text}`").alias("text"))
    chosen = F.broadcast(hash_sample(rows, SAMPLE_PER_LANG))  # SAMPLE_PER_LANG ids a language
    sample = one_text(rows.join(chosen, ["id", "y"]), "id", "y", "r").collect()
    sample.sort(key=lambda r: (r["r"], r["y"], r["text"]))
    return fit([r["text"] for r in sample], [r["y"] for r in sample])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with columns lang_pred and lang_score (replacing columns of these names)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<lang: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = model.predict(list(texts))
        return pd.DataFrame({"lang": lang, "score": score})

    return unpacked(packed(docs, p=predict(F.col(f"`{text}`"))), docs.columns, lang_pred=F.col("p.lang"), lang_score=F.col("p.score"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
