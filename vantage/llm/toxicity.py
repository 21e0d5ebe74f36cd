"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to classes: insults (learned from labelled rows, as words or as stems with any
ending), threats, targets, negations and words of reported speech (fixed lists).  Three further transducers read
the classes of a clause: one weakens insults and threats after a negation, one those after a word of reported
speech, and one adds weights for an insult, an insult with a target, a weakened insult, and a threat with a target.  They are composed into a single
machine that counts these four matches over a document's clauses, so what counts is the matched clause, not the word
alone.  A colon ends a clause for negations but not for reported speech, whose words follow it; a comma ends a negation
and parts a threat from a target, but not an insult from its target.  Evidence is the weighted sum of the counts, each
up to a cap, so that what is said often weighs no more than what is said some times, and a threat once; the weights are learned from the labelled sample, drawn to PRIOR
where it says little (a kind of match that it lacks keeps its prior weight).  A logistic curve, fitted on the same
sample and a few harmless threats, turns evidence into a score.

Edge cases: null and empty texts have no evidence and get the score of it; texts of any length are read whole; null
labels and labels of unknown documents are ignored; of several labels of a document the highest counts; with
labelled rows of one class or none, or without evidence in any, the lexicon is empty and all scores are 0, though
evidence is still read; with a lexicon or without, the fixed lists of the grammar are at work; repeated rows are
scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, one_text, packed, small_batches, unpacked

#: At most so many labelled rows of each class are learned from: a bounded sample, in order of a hash of the id.
SAMPLE_PER_CLASS = 4000
#: An insult is a word or stem in at least so many toxic sample rows and in this share of them, and so many times
#: likelier in toxic rows.  For a stem with FORMS different words in toxic rows, half the share is enough: what varies
#: its endings is no passage that copies repeat.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO, FORMS = 4, 0.012, 25.0, 3
#: Stem lengths tried, shortest first.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Kinds of matches, and their weights before any label is seen.
MATCHES = ("insult", "insult_with_target", "weakened_insult", "threat")
PRIOR = (1.0, 0.5, 0.5, 0.25)
#: Threats alone that the calibration sees as harmless before any label: verbs of harm have everyday uses.
HARMLESS = 3
#: So many matches of a kind count in a document.
CAPS = (5, 5, 5, 1)

# Fixed word lists of the grammar.
THREAT = frozenset("kill hurt destroy beat burn attack stab shoot töten schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGET = frozenset("you your yours yourself they them he she him her people du dich dir dein ihr euch tu toi te ton vous votre ti tú usted ustedes vosotros".split())
NEGATION = frozenset("not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTED = frozenset("said says wrote writes called quoted reported claimed told sagte schrieb nannte berichtete dit écrit appelé dijo escribió llamó".split())

#: Clause ends, and words.
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n]")

OTHER, INSULT, THREATS, TARGETS, NOT, SAID, END, WEAK_INSULT, WEAK_THREAT, COLON, COMMA = range(11)
_MARKS = {":": COLON, ",": COMMA}


class Transducer:
    """Deterministic transducer: arcs[state, symbol] = (next state, output, matches); other symbols are copied."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, ()))

    def compose(self, after: Transducer, symbols=range(11)) -> Transducer:
        """The machine that feeds this one's output to the other: the reachable part of the product."""
        arcs, todo, done = {}, [(self.start, after.start)], set()
        while todo:
            pair = todo.pop()
            if pair in done:
                continue
            done.add(pair)
            for s in symbols:
                a, out, m1 = self.step(pair[0], s)
                b, out, m2 = after.step(pair[1], out)
                if ((a, b), out, m1 + m2) != (pair, s, ()):
                    arcs[pair, s] = ((a, b), out, m1 + m2)
                todo.append((a, b))
        return Transducer(arcs, (self.start, after.start))


def machines() -> tuple[Transducer, Transducer, Transducer]:
    """Negation, reported speech, and the one that counts matches (numbers of MATCHES)."""
    weaken = {(1, INSULT): (1, WEAK_INSULT, ()), (1, THREATS): (1, WEAK_THREAT, ()), (1, END): (0, END, ())}
    negation = Transducer({(0, NOT): (1, NOT, ()), (1, COLON): (0, COLON, ()), (1, COMMA): (0, COMMA, ()), **weaken})
    reported = Transducer({(0, SAID): (1, SAID, ()), **weaken})
    # States of the counting machine: what the clause holds so far: (insult, threat since a comma, target, target since a comma).
    arcs = {}
    for insult, threat, target, here in product((0, 1), repeat=4):
        s = (insult, threat, target, here)
        arcs[s, INSULT] = ((1, threat, target, here), INSULT, (0, 1) if target else (0,))
        arcs[s, WEAK_INSULT] = (s, WEAK_INSULT, (2,))
        arcs[s, THREATS] = ((insult, 1, target, here), THREATS, (3,) if here else ())
        arcs[s, WEAK_THREAT] = (s, WEAK_THREAT, ())
        arcs[s, TARGETS] = ((insult, threat, 1, 1), TARGETS, (1,) * (insult and not target) + (3,) * (threat and not here))
        arcs[s, COMMA] = ((insult, 0, target, 0), COMMA, ())
        arcs[s, END] = arcs[s, COLON] = ((0, 0, 0, 0), END, ())
    return negation, reported, Transducer(arcs, (0, 0, 0, 0))


def grammar() -> Transducer:
    negation, reported, count = machines()
    return negation.compose(reported).compose(count)


class Model:
    """Lexicon, grammar, weights and calibration."""

    def __init__(self, words: frozenset[str] = frozenset(), stems: frozenset[str] = frozenset(), a: float = -40.0, b: float = 0.0, weights: tuple = PRIOR):
        self.words, self.stems, self.a, self.b, self.weights = words, stems, a, b, weights
        machine = grammar()
        self.arcs, self.start = machine.arcs, machine.start
        self.keys = sorted(words | stems | THREAT)  # a text with none of these has no match
        self.known: dict[str, int] = {}

    def classify(self, word: str) -> int:
        if (c := self.known.get(word)) is None:
            if word in self.words or any(word[:k] in self.stems for k in STEMS):
                c = INSULT
            else:
                c = THREATS if word in THREAT else TARGETS if word in TARGET else NOT if word in NEGATION else SAID if word in REPORTED else OTHER
            if len(self.known) < 200_000:
                self.known[word] = c
        return c

    def matches(self, text: str | None) -> list[int]:
        """How often each kind of match occurs in the clauses."""
        low, counts = (text or "").lower(), [0] * len(MATCHES)
        if not any(k in low for k in self.keys):
            return counts
        state = self.start
        for m in _TOKEN.finditer(low):
            w = m[0]
            s = self.classify(w) if w[0].isalpha() else _MARKS.get(w, END)
            if s and (arc := self.arcs.get((state, s))):
                state, _, found = arc
                for k in found:
                    counts[k] += 1
        return counts

    def evidence(self, text: str | None) -> float:
        """Weighted sum of the matches, of each kind up to its cap."""
        return float(sum(w * min(n, most) for w, n, most in zip(self.weights, self.matches(text), CAPS, strict=True)))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.a + self.b * math.log1p(self.evidence(text))))))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, y) of a bounded sample of labelled rows: one of each id; equal texts count once, with their highest label."""
    y = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y"))
    y = hash_sample(y, most).select("id", "y")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(y), "id")
    return one_text(rows, "id", "y").groupBy("text").agg(F.max("y").alias("y"))


def features(word: str):
    yield f"={word}"
    for k in STEMS:
        if len(word) >= k:
            yield word[:k]


def _counts(batches):
    """(f, n1, n0, words): rows of either class with the feature, and its words in toxic rows."""
    for pdf in batches:
        counts, words = {0: Counter(), 1: Counter()}, {}
        for t, y in zip(pdf["text"], pdf["y"], strict=True):
            found = [(f, w) for w in set(_TOKEN.findall((t or "").lower())) if w[0].isalpha() for f in features(w)]
            counts[int(y > 0)].update({f for f, _ in found})
            if y > 0:
                for f, w in found:
                    words.setdefault(f, set()).add(w)
        names = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"f": names, "n1": [counts[1][f] for f in names], "n0": [counts[0][f] for f in names], "words": [sorted(words.get(f, ()))[:FORMS] for f in names]}).astype({"n1": "int64", "n0": "int64"})


def lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems that mark toxic rows; a stem replaces the longer ones and the words that it covers."""
    size = {r["t"]: r["n"] for r in sample.groupBy((F.col("y") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(True) or not size.get(False):
        return frozenset(), frozenset()
    n1, n0 = size[True], size[False]
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * n1))
    counts = sample.mapInPandas(_counts, "f string, n1 long, n0 long, words array<string>").groupBy("f")
    counts = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("forms"))
    ratio = (F.col("n1") + 0.5) / (n1 + 1.0) / ((F.col("n0") + 0.5) / (n0 + 1.0))
    enough = F.when(F.col("forms") >= FORMS, F.lit(max(LEAST_ROWS, math.ceil(LEAST_SHARE * n1 / 2)))).otherwise(F.lit(least))
    kept = counts.where((F.col("n1") >= enough) & (ratio >= LEAST_RATIO)).select("f").collect()  # bounded by the sample
    words, stems = set(), set()
    for f in sorted((r["f"] for r in kept), key=lambda f: (f[0] == "=", len(f), f)):
        if f[0] != "=":
            if not any(f[:k] in stems for k in STEMS if k < len(f)):
                stems.add(f)
        elif not any(f[1:][:k] in stems for k in STEMS):
            words.add(f[1:])
    return frozenset(words), frozenset(stems)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression of y on x by Newton steps."""
    X, w, penalty = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([0.01, 0.01])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -40, 40)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + penalty, X.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn_weights(x: np.ndarray, y: np.ndarray) -> tuple:
    """Weights of the kinds of matches (counts x, labels y): logistic regression drawn to twice PRIOR, not below 0, and
    scaled so that a plain insult weighs 1 (PRIOR if it would weigh nothing)."""
    X = np.concatenate([np.ones((len(x), 1)), np.minimum(x, CAPS)], 1)
    prior = np.array([0.0, *(2 * p for p in PRIOR)])
    pull = np.diag([0.01] + [1.0] * len(PRIOR))
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -40, 40)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + pull, X.T @ (y - p) - pull @ (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    kinds = np.maximum(w[1:], 0)
    return tuple((kinds / kinds[0]).tolist()) if kinds[0] > 0 else PRIOR


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the given labels only."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, doc_id, text, label)
    words, stems = lexicon(sample)
    model = Model(words, stems)
    count = F.pandas_udf(lambda t: pd.Series([model.matches(x) for x in t]), "array<long>")
    rows = sample.select(count("text").alias("x"), (F.col("y") > 0).cast("double").alias("y")).toPandas()  # at most 2 * SAMPLE_PER_CLASS rows
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(MATCHES))
    y = rows["y"].to_numpy()
    if rows["y"].nunique() < 2 or not x.any():
        return Model()
    weights = learn_weights(x, y)
    e = np.concatenate([np.minimum(x, CAPS) @ np.array(weights), np.full(HARMLESS, weights[MATCHES.index("threat")])])
    a, b = calibrate(np.log1p(e), np.concatenate([y, np.zeros(HARMLESS)]))
    return Model(words, stems, a, b, weights)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with columns tox_evidence and tox_score (replacing columns of these names)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<e: double, s: double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        e = np.array([model.evidence(t) for t in texts], float)
        return pd.DataFrame({"e": e, "s": 1 / (1 + np.exp(-np.clip(model.a + model.b * np.log1p(e), -40, 40)))})

    return unpacked(packed(docs, p=score(F.col(f"`{text}`"))), docs.columns, tox_evidence=F.col("p.e"), tox_score=F.col("p.s"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~held_out))
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
