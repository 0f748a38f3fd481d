"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the average of its character n-grams' vectors, a document the average over its words'
n-grams; both lie in the same space, under the same two-class softmax, and vectors and softmax are
trained jointly. Training starts on whole documents' averages. As a few toxic words in a long text
hardly move its average, it goes on with each document's most toxic word, found anew in each round. A
text's score is the softmax of its most toxic word's average, so it does not fade with length, and
misspellings share n-grams with what was learned. (Scored by whole documents' averages the same vectors
do much worse; the README has both figures.)

The fit uses a bounded sample (``per_class`` documents of a class, and so many characters); the model is
a table of 2 ** BITS numbers, which is what goes to the workers. Scoring is one pass without a shuffle.

Results: null and empty texts have no words and score 0 plus what the calibration gives an empty
text, below the threshold. Without labelled rows of both classes every score is 0. Null labels and
labels other than 0 and 1 are none; of different labels of one id the greatest counts. Repeated rows
score alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import ngrams
from skein.llm.common import labelled_sample, parts, remainder
from skein.llm.linear import calibrated, probability

BITS, LENGTHS, DIMENSIONS = 18, (3, 4, 5, 6), 8
#: Averages are small; this brings them to the softmax's range.
SCALE = 30.0
BAG_ROUNDS, WORD_ROUNDS, BATCH, RATE = 4, 6, 64, 0.1
PER_CLASS, THRESHOLD = 1500, 0.3
#: Where in the gap between clean and toxic training scores the threshold lies.
LEAN = 0.25


def _grams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(buckets, words, word_start): for each length the n-grams' buckets and the number of the word
    that each is in, ends of words included; word_start[t] is text t's first word."""
    flat, starts = ngrams.joined(texts, lower=True, words=True)
    space = flat == 32
    head = ~space & np.concatenate(([True], space[:-1]))
    word = np.cumsum(head, dtype=np.int32) - 1
    inner = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    grams, of = [], []
    for n in LENGTHS:
        ok = np.flatnonzero(inner[n - 1 : len(flat)] == inner[1 : len(flat) - n + 2]) if len(flat) >= n else np.zeros(0, int)  # spaces at the ends only
        grams.append(ngrams.hashed(flat, n, BITS)[ok])
        of.append(word[ok + 1])
    return grams, of, np.searchsorted(np.flatnonzero(head), starts)


class Bags:
    """Texts as words and the n-gram buckets in each word, in text order.

    word_start[t]: first word of text t. gram, gram_start[w]: buckets of word w."""

    def __init__(self, texts: list[str]):
        grams, of, self.word_start = _grams(texts)
        order = np.argsort(np.concatenate(of), kind="stable")
        self.gram = np.concatenate(grams).astype(np.int32)[order]
        self.gram_start = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(of), minlength=self.word_start[-1]))))

    def word_means(self, values: np.ndarray) -> np.ndarray:
        return ngrams.sums(values[self.gram], self.gram_start) / np.maximum(np.diff(self.gram_start), 1)


def word_means(values: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a number per bucket over each word's n-grams, and each text's first word."""
    grams, of, word_start = _grams(texts)
    total, count = np.zeros(word_start[-1]), np.zeros(word_start[-1], int)
    for g, w in zip(grams, of, strict=True):
        total += np.bincount(w, values[g], word_start[-1])
        count += np.bincount(w, minlength=word_start[-1])
    return total / np.maximum(count, 1), word_start


def greatest(means: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's greatest word mean, and that word's number; -inf and -1 without words."""
    best, which = np.full(len(word_start) - 1, -np.inf), np.full(len(word_start) - 1, -1)
    has = np.flatnonzero(np.diff(word_start) > 0)
    if len(has):
        best[has] = np.maximum.reduceat(means, word_start[:-1][has])
        text_of = np.repeat(np.arange(len(best)), np.diff(word_start))
        at = np.flatnonzero(means == best[text_of])
        which[text_of[at][::-1]] = at[::-1]
    return best, which


class Model:
    def __init__(self, values: np.ndarray, slope: float, shift: float):
        self.values, self.slope, self.shift = values, slope, shift

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.slope:
            return np.zeros(len(texts))
        return probability(greatest(*word_means(self.values, texts))[0], self.slope, self.shift)


class _Softmax:
    """Bucket vectors and the softmax's weights, with their Adagrad sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.se, self.sw, self.sb = np.full(1 << BITS, 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)

    def step(self, index: np.ndarray, weight: np.ndarray, size: np.ndarray, y: np.ndarray) -> None:
        """One step on examples, each ``size`` buckets with weights."""
        weight, y, size = weight.astype(np.float32), y[size > 0], size[size > 0]
        if not len(y):
            return
        v = np.add.reduceat(self.e[index] * weight[:, None], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0)
        z = v @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        used, place = np.unique(index, return_inverse=True)
        back = np.repeat(p @ self.w.T, size, axis=0) * weight[:, None]
        de = np.stack([np.bincount(place, back[:, k], len(used)) for k in range(DIMENSIONS)], 1)
        dw, db = v.T @ p, p.sum(0)
        self.se[used] += (de**2).mean(1)
        self.e[used] -= RATE * de / np.sqrt(self.se[used])[:, None]
        self.sw += dw**2
        self.w -= 0.1 * RATE * dw / np.sqrt(self.sw)
        self.sb += db**2
        self.b -= 0.1 * RATE * db / np.sqrt(self.sb)

    def values(self) -> np.ndarray:
        """What a bucket adds to the difference of the two logits."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(float)


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), 0.0, 0.0)
    rng, net = np.random.default_rng(seed), _Softmax(seed)
    parts = [Bags(p) for p in ngrams.slices(texts)]
    spans = [(k, i) for k, b in enumerate(parts) for i in range(len(b.word_start) - 1)]

    def document(k: int, i: int) -> np.ndarray:
        b = parts[k]
        return b.gram[b.gram_start[b.word_start[i]] : b.gram_start[b.word_start[i + 1]]]

    for _ in range(BAG_ROUNDS):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            chosen = order[s : s + BATCH]
            bags = [np.unique(document(*spans[i]), return_counts=True) for i in chosen]
            weight = [c * (SCALE / max(c.sum(), 1)) for _, c in bags]
            net.step(np.concatenate([u for u, _ in bags]), np.concatenate(weight), np.array([len(u) for u, _ in bags]), y[chosen])
    for _ in range(WORD_ROUNDS):
        values = net.values()
        words = [b.gram[b.gram_start[w] : b.gram_start[w + 1]] if w >= 0 else np.zeros(0, np.int64) for b in parts for w in greatest(b.word_means(values), b.word_start)[1]]
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            chosen = order[s : s + BATCH]
            size = np.array([len(words[i]) for i in chosen])
            net.step(np.concatenate([words[i] for i in chosen]), np.repeat(1.0 / np.maximum(size, 1), size), size, y[chosen])
    values = net.values()
    margin = np.concatenate([greatest(b.word_means(values), b.word_start)[0] for b in parts])
    has = np.isfinite(margin)
    return Model(values.astype(np.float32), *calibrated(margin[has], y[has], THRESHOLD, LEAN))


def score_documents(docs: DataFrame, model: Model, held_out_of: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on). Only the
    two named columns are read."""
    return _scored(docs, model, id_col, text_col).select("doc_id", (remainder(F.col("doc_id"), held_out_of) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scored(docs: DataFrame, model, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ``model.score`` of each whole text; the model has a fixed size and is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in parts(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(sent.value.score(texts), pa.float64())})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def detect(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fit on the labelled documents that are not held out, then score all."""
    learn = remainder(F.col("doc_id"), 4) != 2
    return score_documents(docs, fit(*labelled_sample(docs, labels, "toxic", learn, per_class, "toxic")))
