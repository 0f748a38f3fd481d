"""Language identification in two steps: the family first, then the language within it.

A text is the relative frequencies of its hashed byte n-grams, in lower case. Families are told apart
by one linear support vector machine each, against the other families' texts (two families by one
machine), and the languages inside a family by one-versus-one machines, whose bounded margins are
summed. All machines are columns of one table, so a text's n-grams are looked up once. Every language
that occurs is learned: the table's width is halved until it holds WEIGHTS numbers at most (2 ** 16
buckets for up to 512 machines). The fit uses a bounded sample: ``per_language`` documents of each
language, TEXTS of all, and CHARS characters in all, chosen by a hash of the id that knows nothing of
a text's length. Scoring is one pass without a shuffle.

Results: a null text, or one without a letter, is ``und`` with score 0; so is everything when no
language was learned. With a single language learned every other text is that language. Rows with a
null language are not learned from. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import ngrams
from skein.llm.common import parts, remainder, rows_that, sampled, share_of_class
from skein.llm.linear import Rows, hinge

#: Language families by ISO 639-1 code. Other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv su mg",
}
BITS, LENGTHS, WEIGHTS = 16, (1, 2, 3, 4), 1 << 25
PER_LANGUAGE, TEXTS, CHARS = 700, 70_000, 32_000_000
#: Texts of other families that a family's machine is fitted against, for each of its own.
OTHERS = 4
#: Frequencies are brought to this scale for the machines; what a margin counts for in the score.
SCALE, COST, SHARPNESS = 20.0, 0.1, 2.0
UNKNOWN = "und"
#: Score under which the pipeline rejects a document: no language stands out.
LEAST_SCORE = 0.25
_letter = regex.compile(r"\p{L}").search


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((k for k, v in FAMILIES.items() if code in v.split()), code)


def frequencies(texts: list[str], bits: int = BITS) -> Rows:
    """Relative n-gram frequencies, which add up to SCALE."""
    index, value, sizes = [], [], []
    for t in texts:
        flat, _ = ngrams.joined([t], lower=True, words=True)
        k, c = np.unique(np.concatenate([ngrams.hashed(flat, n, bits) for n in LENGTHS]), return_counts=True)
        index.append(k.astype(np.int32))
        value.append((c / max(c.sum(), 1) * SCALE).astype(np.float32))
        sizes.append(len(k))
    return Rows(np.concatenate(index), np.concatenate(value), np.concatenate(([0], np.cumsum(sizes))))


class Model:
    """Languages, their families, and a column of weights and a bias for each family (for the first of
    two) and each pair of languages of one family, of which the first is the positive side."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.own: dict[str, list[str]] = {}
        for x in self.langs:
            self.own.setdefault(family(x), []).append(x)
        self.families = sorted(self.own)
        self.judged = self.families if len(self.families) > 2 else self.families[: len(self.families) - 1]
        self.pairs = [p for f in self.families for p in combinations(self.own[f], 2)]
        machines = len(self.judged) + len(self.pairs)
        self.bits = next(b for b in range(BITS, 0, -1) if b == 1 or machines << b <= WEIGHTS)
        self.weights = np.zeros((machines, 1 << self.bits), np.float32)
        self.bias = np.zeros(machines)

    def margins(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per machine."""
        flat, starts = ngrams.joined(texts, lower=True, words=True)
        out, n = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts))
        for k in LENGTHS:
            h = ngrams.hashed(flat, k, self.bits)
            stop = np.minimum(np.maximum(starts[1:] - k + 1, starts[:-1]), len(h))
            first = np.minimum(starts[:-1], len(h))
            n += stop - first
            for c, w in enumerate(self.weights):
                total = np.concatenate(([0.0], np.cumsum(w[h], dtype=float)))
                out[:, c] += total[stop] - total[first]
        return out * SCALE / np.maximum(n, 1)[:, None] + self.bias

    def _of_family(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's family, and the probability that half its lead over the next one stands for."""
        m = np.concatenate((margins, -margins), 1) if len(self.families) == 2 else margins if len(self.families) > 2 else np.zeros((len(margins), 1))
        lead = np.sort(m, 1)[:, -2:] @ [-0.5, 0.5] if m.shape[1] > 1 else np.full(len(m), 30.0)
        return m.argmax(1), _sureness(lead)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        known = np.array([_letter(t) is not None for t in texts])
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        m = self.margins(texts)
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        best, sure = self._of_family(m[:, : len(self.judged)])
        first = len(self.judged)
        for i, f in enumerate(self.families):
            at, own = np.flatnonzero(known & (best == i)), self.own[f]
            cols = slice(first, first + len(own) * (len(own) - 1) // 2)
            first = cols.stop
            which, within = self._vote(m[at, cols], own, self.pairs[cols.start - len(self.judged) : cols.stop - len(self.judged)])
            names[at] = np.array(own, object)[which]
            score[at] = sure[at] * within
        return names.tolist(), score

    @staticmethod
    def _vote(margins: np.ndarray, names: list[str], pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """The name with the greatest sum of bounded margins for each row, and its least pair's
        probability."""
        total, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), 30.0)
        for k, pair in enumerate(pairs):
            for name, m in zip(pair, (margins[:, k], -margins[:, k]), strict=True):
                i = names.index(name)
                total[:, i] += np.clip(m, -1, 1)
                least[:, i] = np.minimum(least[:, i], m)
        best = total.argmax(1)
        return best, _sureness(least[np.arange(len(best)), best])


def _sureness(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-SHARPNESS * np.clip(margin, -30, 30)))


def fit(texts: list[str], langs: list[str]) -> Model:
    model, lang = Model(sorted(set(langs))), np.array(langs, object)
    if len(model.langs) < 2:
        return model
    x = frequencies(texts, model.bits)
    kin = np.array([family(v) for v in langs], object)

    def learn(k: int, good: np.ndarray, bad: np.ndarray) -> None:
        rows = np.sort(np.concatenate((good, bad)))
        w, model.bias[k] = hinge(x.take(rows), np.where(np.isin(rows, good), 1, -1), 1 << model.bits, COST, seed=k)
        model.weights[k] = w

    for k, f in enumerate(model.judged):
        good, bad = np.flatnonzero(kin == f), np.flatnonzero(kin != f)
        if len(bad) > OTHERS * max(len(good), len(model.families)) and len(model.families) > 2:
            bad = np.sort(np.random.default_rng(k).permutation(bad)[: OTHERS * max(len(good), len(model.families))])
        learn(k, good, bad)
    for k, (a, b) in enumerate(model.pairs, len(model.judged)):
        learn(k, np.flatnonzero(lang == a), np.flatnonzero(lang == b))
    return model


def fit_documents(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the sampled documents that are not held out."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).select("doc_id", "text", F.col("lang").alias("skein_class"))
    known = max(1, learn.select("skein_class").distinct().count())
    chosen = share_of_class(learn, max(1, min(per_language, TEXTS // known)), "lang")
    return fit(*sampled(chosen, "lang", max(1, CHARS // known)))


def predict_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score. Only the two named columns are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in parts(batches):
            names, score = sent.value.predict(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return made.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the documents that are not held out, then predict all."""
    return predict_documents(docs, fit_documents(docs, per_language))


def recognised(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` in a language that stands out: neither ``und`` nor under LEAST_SCORE."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, per_language))

    def judge(texts: list[str]) -> np.ndarray:
        names, score = sent.value.predict(texts)
        return (np.array(names, object) != UNKNOWN) & (score >= LEAST_SCORE)

    return rows_that(docs, judge)
