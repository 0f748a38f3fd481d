"""Text quality by naive Bayes support vectors.

Features are indicators of n-grams, all hashed into one table: which byte n-grams a whole text has, which words and
pairs of words, and which n-grams over its words' shapes. A shape says how a word is written (upper case, capitalised,
small, or none of them), whether it ends in a symbol, and whether it repeats the word before it, so that stretches of
shouting, of symbols and of repetition are n-grams like others. Indicators are scaled by the classes' smoothed
log-count ratio, and a linear hinge-loss model is fitted to the scaled ones by dual coordinate descent;
its weights are drawn towards the naive Bayes solution. The fit uses a bounded sample (``per_class``
documents of a class, and so many characters). Scoring is one pass.

Results: null and empty texts have no features and get the score of the bias alone. Without labelled
rows of both classes every score is 1. Null labels and labels other than 0 and 1 are none; of different
labels of one id the greatest counts. Repeated rows score alike.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import ngrams
from skein.llm.common import labelled_sample, remainder, rows_that
from skein.llm.linear import Rows, calibrated, hinge, joined_rows, probability
from skein.llm.toxicity import _scored

BITS, LENGTHS = 17, (1, 2, 3, 4)
SIZE = 1 << BITS
#: Lengths of n-grams of words and of their shapes.
WORDS, SHAPES = (1, 2), (1, 2, 3, 4)
PER_CLASS, THRESHOLD = 1500, 0.3
#: Smoothing of counts; weight of the model's own weights against their mean magnitude; cost.
ALPHA, MIX, COST = 1.0, 0.75, 1.0
#: Where in the gap between rejected and accepted training margins the threshold lies.
LEAN = 0.3


_MIX, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> int:
    """How a word is written: by its case, and 8 more if it ends in a symbol."""
    return (4 if word.isupper() else 3 if word[0].isupper() else 2 if word[0].islower() else 1) + 8 * (not word[-1].isalnum())


def _runs(codes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The bucket of each n-gram of codes."""
    h = np.full(max(len(codes) - n + 1, 0), salt + n, np.uint64)
    for k in range(n if len(h) else 0):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * _MIX
        h ^= h >> np.uint64(32)
    return ((h * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(texts: list[str]) -> Rows:
    """The sorted distinct features of each text."""
    flat, starts = ngrams.joined(texts, lower=False, words=False)
    hashes = [(n, ngrams.hashed(flat, n, BITS)) for n in LENGTHS]
    mark, found = np.zeros(SIZE, bool), []
    for i, t in enumerate(texts):
        for n, h in hashes:
            mark[h[starts[i] : max(starts[i], starts[i + 1] - n + 1)]] = True
        words = t.split()
        each = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
        shapes = np.fromiter(map(shape, words), np.uint64, len(words))
        shapes[1:] += np.uint64(16) * (each[1:] == each[:-1]).astype(np.uint64)
        for codes, lengths, salt in ((each, WORDS, 0), (shapes, SHAPES, 100)):
            for n in lengths:
                mark[_runs(codes, n, salt)] = True
        index = np.flatnonzero(mark)
        mark[index] = False
        found.append(index.astype(np.int32))
    return Rows(np.concatenate(found), np.ones(sum(map(len, found)), np.float32), np.cumsum([0, *map(len, found)]))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.slope:
            return np.ones(len(texts))
        return probability(margins(self.weights, self.bias, indicators(texts)), self.slope, self.shift)


def margins(weights: np.ndarray, bias: float, x: Rows) -> np.ndarray:
    """Margins per square root of the number of features, so that long texts are no surer."""
    return (x.dot(weights) + bias) / np.sqrt(np.maximum(np.diff(x.start), 1))


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SIZE), 0.0, 0.0, 0.0)
    x = joined_rows(indicators(p) for p in ngrams.slices(texts))
    sizes = np.diff(x.start)
    good, bad = (ALPHA + np.bincount(x.index[np.repeat(y == k, sizes)], minlength=SIZE) for k in (1, 0))
    ratio = np.log((good / ((y == 1).sum() + 2 * ALPHA)) / (bad / ((y == 0).sum() + 2 * ALPHA)))
    length = np.sqrt(np.maximum(sizes, 1))
    scaled = Rows(x.index, (ratio.astype(np.float32)[x.index] / np.repeat(length.astype(np.float32), sizes)), x.start)
    w, bias = hinge(scaled, np.where(y == 1, 1, -1), SIZE, COST)
    w = MIX * w + (1 - MIX) * np.abs(w).mean()
    weights = w * ratio
    return Model(weights, bias, *calibrated(x.dot(weights) / length + bias / length, y, THRESHOLD, LEAN))


def score_documents(docs: DataFrame, model: Model, held_out_of: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on). Only the
    two named columns are read."""
    return _scored(docs, model, id_col, text_col).select("doc_id", (remainder(F.col("doc_id"), held_out_of) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fit on the labelled documents that are not held out, then score all."""
    return score_documents(docs, fit_documents(docs, labels, per_class))


def fit_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0, per_class, "quality"))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts 1 for."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels, per_class))
    return rows_that(docs, lambda texts: sent.value.score(texts) >= THRESHOLD)
