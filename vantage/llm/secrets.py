"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two order-2 Markov models over characters are trained from labelled samples.  Random strings are drawn from the alphabets
that keys are written in, letters alone among them.  Ordinary ones are words and numbers of the documents as they stand,
and identifiers composed of them as people do: joined by `_`, `-`, `/` or capitals, in upper case, with numbers, dates,
times and versions between; with them rulers of one sign and runs of the alphabet.  A candidate token is a secret if its
log-likelihood ratio per character is at least a threshold, set from held-out samples; there is no other rule.  Base patterns always stay; the
models add spans that do not overlap them.

Edge cases: a null text is empty; empty texts have no spans; offsets are code points, end exclusive; repeated rows
are scanned each; an empty table gives an empty table, and without words in the documents a few of the program's own
stand in.  Columns of the input are carried along by `scan_documents`.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, unpacked

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}", re.ASCII)
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge: long runs of the characters that keys are written in.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", re.ASCII)
#: One labelled string in so many is held out of the models and sets the threshold: between the score that all but TAKEN of
#: the ordinary tokens stay under and the one that all but MISSED of the random ones reach, this far from the first, as
#: people's identifiers vary more than the composed ones.
HELD_OUT, MISSED, TAKEN, BETWEEN = 5, 0.02, 0.005, 0.75
#: Labelled samples: so many random strings are drawn, at most so many words taken from documents, and so many identifiers
#: composed of them.
RANDOM_SAMPLES, ORDINARY_SAMPLES, IDENTIFIERS, SEED = 8000, 20000, 20000, 9
#: Pseudo-counts that draw order 2 to order 1, and order 1 to single characters.
PULL = (4.0, 8.0)

_ALPHABET = string.ascii_letters + string.digits + "+/_=-"


def fit_markov(samples) -> np.ndarray:
    """Log-probabilities [last but one, last, next] over the alphabet; the last place of the first two is the start.

    Counts of order 2 are drawn to those of order 1, and these to the characters' shares, by PULL pseudo-counts."""
    n = len(_ALPHABET)
    at = {c: i for i, c in enumerate(_ALPHABET)}
    one, two, three = np.ones(n), np.zeros((n + 1, n)), np.zeros((n + 1, n + 1, n))
    for s in samples:
        a = b = n
        for c in s:
            if (i := at.get(c)) is None:
                a = b = n
                continue
            one[i] += 1
            two[b, i] += 1
            three[a, b, i] += 1
            a, b = b, i
    two = (two + PULL[1] * one / one.sum()) / (two.sum(1, keepdims=True) + PULL[1])
    return np.log((three + PULL[0] * two[None]) / (three.sum(2, keepdims=True) + PULL[0]))


#: Alphabets of keys: hexadecimal, Base32-like, Base62, Base64 and its file-name form, and letters alone.
_KEYS = tuple(
    "".join(x)
    for x in (
        (string.digits, "abcdef"), (string.digits, "ABCDEF"), (string.ascii_letters, string.digits), (string.ascii_letters, string.digits, "-_"), (string.ascii_letters, string.digits, "+/"),
        (string.ascii_uppercase, string.digits), (string.ascii_lowercase, string.digits), (string.ascii_letters,), (string.ascii_lowercase,), (string.ascii_uppercase,),
    )
)


#: Words that identifiers are often made of, in any corpus.
COMMON = (
    "access account address agent api app archive artifact backup batch branch buffer build bundle cache call channel check "
    "class client cloud cluster code common component config connection container content context control core count create "
    "customer data database date default delete dev disk document east enable engine env error eu event "
    "export feature field file filter final flag format function group handler hash header host id image import index "
    "info input instance internal item key label layer level library limit link list loader local log main manager map memory "
    "message method metric mode model module monitor name network node number object option order output package page param "
    "path payload pipeline point policy pool prod production profile project protocol public query queue rate read region "
    "release remote report request resource response result role root route run runtime sample schema script search server "
    "service session set setting size source spec stage start state status storage store stream string "
    "system table target task template test text time timeout train type unit update "
    "upload url user util value vector version view web west window worker workflow write zone"
).split()


def random_samples(n: int = RANDOM_SAMPLES, seed: int = SEED) -> list[str]:
    """Labelled random strings of 20 to 64 characters, from a seeded generator, of each alphabet in turn."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(_KEYS[i % len(_KEYS)]), int(rng.integers(20, 65)))) for i in range(n)]


def ordinary_words(docs: DataFrame, text: str = "text", most: int = ORDINARY_SAMPLES) -> list[str]:
    """A word or number of each of at most `most` different texts, in order of a hash of the text; its place in the text
    is a hash too.  Words of 20 characters and more may be keys and are left out."""
    t = F.col(f"`{text}`")
    rows = docs.where(t.isNotNull() & (t != "")).select(t.alias("t"), F.xxhash64(t).alias("k"))
    n = max(1, docs.count())
    rows = rows.where((F.col("k") / F.lit(2.0**64) + 0.5) * F.lit(float(n)) <= 2.0 * most + 50)  # few texts a task
    words = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z0-9]{2,19}(?![A-Za-z0-9])"), F.lit(0))
    rows = rows.withColumn("w", words).where(F.size("w") > 0)
    rows = rows.select(F.element_at("w", (F.pmod(F.xxhash64(F.lit("word"), "k"), F.size("w")) + 1).cast("int")).alias("w"), "k").distinct()
    return [r["w"] for r in rows.orderBy("k", "w").limit(most).collect()] or ["value", "name", "index", "parser"]


def identifiers(words: list[str], n: int = IDENTIFIERS, seed: int = SEED) -> list[str]:
    """Labelled ordinary identifiers: one to six words (given or COMMON ones), numbers, dates, times and versions, joined in
    one of six styles."""
    rng = np.random.default_rng(seed)
    plain = [w for w in words if w.isalpha()] or ["value", "name", "index", "parser"]
    number = lambda most: str(int(rng.integers(0, most)))

    def piece() -> str:
        from_ = COMMON if rng.random() < 0.4 else plain
        word = from_[int(rng.integers(len(from_)))]
        day = (f"{rng.integers(1990, 2040)}", f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}")
        time = f"{rng.integers(0, 24):02d}{rng.integers(0, 60):02d}{rng.integers(0, 60):02d}"
        forms = (number(10 ** int(rng.integers(1, 5))), "-".join(day), "".join(day), f"T{time}Z", f"v{number(30)}", f"{word[:1]}{number(100)}{word[-1:]}", word + number(1000), word[: int(rng.integers(2, 5))])
        return forms[int(rng.integers(len(forms)))] if rng.random() < 0.45 else word

    out = []
    for i in range(n):
        parts = [piece() for _ in range(int(rng.integers(1, 7)))]
        style = ("_".join, "-".join, "_".join, "/".join)[i // 6 % 4] if i % 2 else "".join
        if i % 2 == 0:
            parts = [p if j == 0 and i % 4 else p[:1].upper() + p[1:] for j, p in enumerate(parts)]
        s = style(parts)
        out.append(s.upper() if i % 3 == 1 else s)
    return out


def rulers() -> list[str]:
    """Labelled ordinary strings without words: one sign over and over, and runs of letters and digits in order."""
    rows = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "abcdefghij0123456789")
    return [c * k for c in _ALPHABET for k in (24, 40)] + [(r * 3)[i : i + 40] for r in rows for i in range(0, 26, 5)]


class Scanner:
    """Spans of secrets in one text."""

    def __init__(self, random_model: np.ndarray, ordinary_model: np.ndarray, threshold: float = 1.0):
        self.ratio, self.threshold = random_model - ordinary_model, threshold
        self.at = {c: i for i, c in enumerate(_ALPHABET)}

    def score(self, token: str) -> float:
        """Log-likelihood ratio per character."""
        start = len(_ALPHABET)
        code = [start, start, *(self.at[c] for c in token)]
        return float(self.ratio[code[:-2], code[1:-1], code[2:]].sum()) / len(token)

    def looks_random(self, token: str) -> bool:
        """Whether the models favour the random one."""
        return self.score(token) >= self.threshold

    @staticmethod
    def base(text: str) -> list[tuple[str, int, int]]:
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        return out + [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]

    def spans(self, text: str | None) -> tuple[list, list]:
        """Base spans, and all spans, each by start, then kind as listed."""
        text = text or ""
        by = lambda x: (x[1], KINDS.index(x[0]))
        base = sorted(self.base(text), key=by)
        more = [("random", m.start(), m.end()) for m in TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in base) and self.looks_random(m[0])]
        return base, sorted(base + more, key=by)


def train(docs: DataFrame, text: str = "text") -> Scanner:
    words = ordinary_words(docs, text)
    keys, plain = random_samples(), words + identifiers(words) + rulers()
    learn = lambda x: [s for i, s in enumerate(x) if i % HELD_OUT]
    scanner = Scanner(fit_markov(learn(keys)), fit_markov(learn(plain)))
    tokens = [m[0] for s in plain[::HELD_OUT] for m in TOKEN.finditer(s)]
    missed = np.quantile([scanner.score(s) for s in keys[::HELD_OUT]], MISSED)
    taken = np.quantile([scanner.score(s) for s in tokens], 1 - TAKEN) if tokens else missed
    scanner.threshold = float(taken + BETWEEN * (missed - taken))
    return scanner


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """text with each run of overlapping spans replaced by [SECRET]."""
    out, end = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[end:a], "[SECRET]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def scan_documents(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """docs with columns secret_base, secret_spans (array of kind, start, end) and secret_redacted (the text without them).

    These three replace columns of the same names."""
    small_batches(docs.sparkSession)
    kind = "struct<base: array<struct<kind: string, start: long, end: long>>, spans: array<struct<kind: string, start: long, end: long>>, redacted: string>"

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = scanner.spans(t)
            rows.append((base, every, redact(t, every) if t and every else t))
        return pd.DataFrame(rows, columns=["base", "spans", "redacted"])

    s = F.col("s")
    return unpacked(packed(docs, s=scan(F.col(f"`{text}`"))), docs.columns, secret_base=s["base"], secret_spans=s["spans"], secret_redacted=s["redacted"])


def digests(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    found = scan_documents(docs, scanner, text)
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(f"`{doc_id}`").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(line(F.col("secret_base")), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, train(docs))


def brute_base(text: str | None) -> list[tuple[str, int, int]]:
    """The base rules read literally, for tests."""
    text = text or ""
    out = []
    for kind, pattern, ok in (("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", ACCESS, lambda m: len(m[0]) >= 20), ("hex", HEX, lambda m: len(m[0]) >= 24)):
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text) if ok(m)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


