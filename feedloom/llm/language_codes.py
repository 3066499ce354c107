"""Language of a text by error-correcting output codes.

Each language has a binary codeword; one logistic classifier over hashed character n-grams predicts each bit.
A text gets the language whose codeword loses least against the predicted bits, each bit weighted by how
well its classifier does; a close second marks the text as ambiguous.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size

UNKNOWN = "und"
#: Hashed n-gram features.
FEATURES = 4096
ORDERS = (1, 2, 3)
#: Labelled rows per language the classifiers are fitted on, at most, and languages at most.
ROWS_PER_LANGUAGE = 400
MOST_LANGUAGES = 128
#: Margin between best and second score below which a text is ambiguous.
AMBIGUOUS = 0.1
STEPS = 300


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def codewords(languages: int) -> np.ndarray:
    """Rows of a Hadamard matrix without its constant first column: any two differ in half of the bits."""
    size = 2
    while size < max(languages, 4):
        size *= 2
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[:languages, 1:].astype(np.float64)


def features(text: str) -> np.ndarray | None:
    """Relative frequencies of hashed n-grams of the lower-cased text; what is no letter counts as one blank.

    None if the text has no letter.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    gram = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # runs of blanks shrink to one
    gram, total, hashed = gram[keep], np.zeros(FEATURES), np.uint64(0)
    for order in ORDERS:
        if len(gram) < order:
            break
        tail = gram[order - 1 :]
        hashed = tail * np.uint64(0x9E3779B97F4A7C15) if order == 1 else (hashed[:-1] ^ tail) * np.uint64(0xBF58476D1CE4E5B9)
        counts = np.bincount((hashed >> np.uint64(40)) % np.uint64(FEATURES), minlength=FEATURES)
        total += counts / counts.sum()
    return np.sqrt(total / len(ORDERS))


@dataclass
class Codes:
    """Languages, codewords (language x bit), weights (feature x bit), bias and trust per bit."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score (0 to 1) and the margin to the next, per row."""
        if not self.languages:
            none = np.zeros(len(x))
            return np.full(len(x), -1), none, none
        m = self.margins(x)
        loss = np.logaddexp(0, -m[:, None, :] * self.words[None]) @ self.trust
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        order = np.sort(share, axis=1)
        second = order[:, -2] if order.shape[1] > 1 else np.zeros(len(x))
        return best, order[:, -1], order[:, -1] - second


def fit(x: np.ndarray, labels: list[str]) -> Codes:
    """Logistic classifiers for the bits, by accelerated gradient steps; every fourth row measures the bits' trust."""
    languages = sorted(set(labels))
    if not languages:
        return Codes([], np.zeros((0, 1)), np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
    words = codewords(len(languages))
    y = words[np.searchsorted(languages, labels)]
    held = np.arange(len(x)) % 4 == 3
    own = ~held if (~held).any() and len(set(np.array(labels)[~held])) == len(languages) else np.ones(len(x), bool)
    a, b = x[own], y[own]
    # languages weigh the same, however many rows each has
    size = np.unique(np.array(labels)[own], return_inverse=True)[1]
    share = (1 / np.bincount(size))[size][:, None] / len(languages)
    w, c = np.zeros((x.shape[1], words.shape[1])), np.zeros(words.shape[1])
    vw, vc, rate, decay = np.zeros_like(w), np.zeros_like(c), 4.0, 1e-5
    for step in range(STEPS):
        slope = -b * share / (1 + np.exp(np.clip(b * (a @ w + c), -30, 30)))
        vw, vc = 0.9 * vw - rate * (a.T @ slope + decay * w), 0.9 * vc - rate * slope.sum(axis=0)
        w, c = w + vw, c + vc
    check = held if held.any() else own
    right = ((x[check] @ w + c) * y[check] > 0).mean(axis=0)
    odds = np.clip(right, 0.5, 0.999)
    trust = np.maximum(np.log(odds / (1 - odds)), 1e-3)
    return Codes(languages, words, w, c, trust / trust.sum() * words.shape[1])


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the key as text leaves 2 by 4. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, key: str, text: str, label: str) -> Codes:
    """Fit on a bounded sample: per language the ROWS_PER_LANGUAGE labelled rows with the smallest key hash.

    The rows are chosen by key and label alone, over all rows; n-grams are counted where the texts are, and
    only fixed-width frequencies come to the driver. Rows that are held out, have no key, label, text or
    letter are not learned from.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("k"), "k")
    named = docs.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(text).alias("t")).filter(
        F.col("k").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("k"))
    )
    chosen = (
        named.select("k", "label").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ROWS_PER_LANGUAGE)
        .select("k", "label").distinct().orderBy("label", F.xxhash64("k")).limit(ROWS_PER_LANGUAGE * MOST_LANGUAGES)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, name, features(t)) for k, name, t in zip(*(c.to_pylist() for c in batch.columns)) if t]
            rows = [(k, name, x.astype("<f4").tobytes()) for k, name, x in rows if x is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema[0].type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())],
                names=["k", "label", "x"],
            )

    kind = docs.schema[key].dataType.simpleString()
    # at most ROWS_PER_LANGUAGE x MOST_LANGUAGES keys are broadcast
    rows = (
        named.join(F.broadcast(chosen), ["k", "label"]).mapInArrow(run, f"k {kind}, label string, x binary")
        .orderBy("label", F.xxhash64("k"), "x").limit(ROWS_PER_LANGUAGE * MOST_LANGUAGES).toArrow()
    )
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype="<f4").reshape(-1, FEATURES)
    return fit(x, rows.column("label").to_pylist())


def predict(docs: DataFrame, codes: Codes, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Per row: ``key``, ``lang_pred``, ``score``, ``ambiguous``; with ``keep`` the input's own columns too.

    One row out per row in, no shuffle; the text alone decides. Null, empty and letterless texts get ``und``
    with score 0, and so does every text when nothing was learned. Repeated rows and null keys stay. Long
    texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codes)  # FEATURES x bits: bounded by MOST_LANGUAGES
    own = list(docs.columns) if keep else [key]
    at = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_size(batches, at, 8 << 20):
            found = [features(t) if t else None for t in batch.column(at).to_pylist()]
            known = [i for i, x in enumerate(found) if x is not None]
            names, scores, close = [UNKNOWN] * len(found), [0.0] * len(found), [False] * len(found)
            if known:
                for start in range(0, len(known), 512):
                    part = known[start : start + 512]
                    best, score, margin = model.decode(np.array([found[i] for i in part]))
                    for i, b, s, m in zip(part, best.tolist(), score.tolist(), margin.tolist()):
                        if b >= 0:
                            names[i], scores[i], close[i] = model.languages[b], s, m < AMBIGUOUS
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(names), pa.array(scores), pa.array(close)],
                names=[*(f"c{i}" for i in range(at)), "p", "s", "a"],
            )

    cells = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], F.col(text).alias("t"))
    out = inner.mapInArrow(run, f"{cells}, p string, s double, a boolean")
    extra = ["__lang_pred", "__score", "__ambiguous"] if keep else ["lang_pred", "score", "ambiguous"]
    return out.toDF(*own, *extra)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict every row: ``key``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``."""
    codes = learn(docs, key, text, label)
    return predict(docs, codes, key, text).select(
        key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
