"""Text quality by weak supervision, in DataFrame functions only.

Hard base rules fail a document outright. Beside them labelling rules vote good or bad or abstain; they
look at other things than the base rules, and each alone is wrong at times. A document starts as good to
the share of its votes that say so; expectation-maximisation over the counts of vote patterns then
estimates how common good documents are and how often each rule is right on good and on bad ones. A
document is kept if its posterior probability of being good is at least one half and no base rule fails
it, so a single bad vote may be outweighed.

The patterns are counted over all documents; there are 3 ** number of rules at most, whatever the
input's size, and only they go to the driver, which iterates over them. Estimates are smoothed by one
vote of either kind and kept from 0 and 1 for the logarithms' sake alone (EDGE).

Results: null and empty texts have no words, fail the base rules and are not kept. Without any
documents the result is empty. Repeated rows are judged alike; ties at one half are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words with a letter; words that end in another character than a letter or number; ends of sentences.
LETTER_WORD, PUNCT_WORD = r"\p{L}[^\x20\x09-\x0D]*", r"[^\p{L}\p{N}\x20\x09-\x0D](?=[\x20\x09-\x0D]|\z)"
LINE_END = r"[.!?:…。！？][\"'”»)]*[\x20\x09-\x0D]*\z"
WINDOW = 5
#: Distance of a probability from 0 and 1 at least; rounds at most, and the change that ends them.
EDGE, ROUNDS, SETTLED = 1e-6, 200, 1e-7


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a window of WINDOW words which the text has twice or more. ``hashes``: the
    words' 64-bit hashes in order. Windows are compared by 64-bit hashes of those."""
    windows = F.when(F.size(hashes) < WINDOW, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    )

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ordered, lambda z: F.filter(F.transform(z, lambda s, i: F.when((F.get(z, i + 1)["x"] == s["x"]) | ((i > 0) & (F.get(z, i - 1)["x"] == s["x"])), s["i"])), lambda i: i.isNotNull()))
        return let(F.array_sort(twice), lambda p: F.aggregate(F.transform(p, lambda q, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - q, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and what the rules look at; one pass over the texts, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(repeated_words(h).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct_words"))).alias("of_hashes"),
        ),
    )
    of_lines = let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(F.filter(x, lambda y: y.rlike(LINE_END))).cast("long").alias("n_ended_lines"))
    )
    counted = {"n_symbols": SYMBOLS, "n_upper": r"\p{Lu}", "n_letter_words": LETTER_WORD, "n_punct_words": PUNCT_WORD}
    made = docs.select(F.col(id_col).alias("doc_id"), of_words.alias("w"), of_lines.alias("l"), *(F.regexp_count(text, F.lit(v)).cast("long").alias(k) for k, v in counted.items()))
    return made.select("doc_id", "w.n_words", "w.word_chars", "w.of_hashes.*", "l.*", *counted)


def rules() -> dict[str, tuple[Column, Column]]:
    """Rule -> (when it votes bad, when it votes good); it abstains otherwise."""
    n, per, lines = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("n_lines"), F.lit(1))
    length, symbols, upper = F.col("word_chars") / per, F.col("n_symbols") / per, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    dup, ended, several = F.col("n_dup_lines") / lines, F.col("n_ended_lines") / lines, F.col("n_lines") >= 3
    letters, punct, distinct = F.col("n_letter_words") / per, F.col("n_punct_words") / per, F.col("n_distinct_words") / per
    return {
        "word_length": ((length < 3) | (length > 10), (length >= 4) & (length <= 8)),
        "symbols": (symbols > 0.1, symbols <= 0.02),
        "dup_lines": (several & (dup > 0.3), several & (dup <= 0.1)),
        "upper_case": (upper > 0.4, upper <= 0.15),
        "letters": (letters < 0.8, letters >= 0.95),
        "line_ends": (ended < 0.5, ended >= 0.9),
        "variety": ((n >= 50) & (distinct < 0.3), (n >= 50) & (distinct >= 0.45)),
        "punctuation": (punct > 0.4, (punct >= 0.02) & (punct <= 0.25)),
    }


Rates = dict[str, tuple[float, float]]


def estimate(votes: list[tuple[tuple[int, ...], int]], names: list[str]) -> tuple[float, Rates]:
    """The share of good documents, and each rule's accuracies: how often its vote is right on good
    documents and on bad ones. ``votes``: patterns (1 good, 0 bad, -1 abstains, in the order of
    ``names``) with their number of documents."""
    good = [(pattern.count(1) + 1) / (len(pattern) - pattern.count(-1) + 2) for pattern, _ in votes]
    prior, right = _rates(votes, good, names)
    for _ in range(ROUNDS):
        before = (prior, right)
        prior, right = _rates(votes, [_good(pattern, prior, right) for pattern, _ in votes], names)
        if max(abs(prior - before[0]), *(abs(x - y) for k in names for x, y in zip(right[k], before[1][k], strict=True))) < SETTLED:
            break
    return prior, right


def _rates(votes: list[tuple[tuple[int, ...], int]], good: list[float], names: list[str]) -> tuple[float, Rates]:
    """The estimates that follow if a pattern's documents are good with the given probability."""
    inside = lambda x: min(max(x, EDGE), 1 - EDGE)
    total = sum(n for _, n in votes)
    right = {}
    for i, k in enumerate(names):
        sums = [[0.0, 0.0], [0.0, 0.0]]  # by vote, of good and of bad documents
        for (pattern, n), p in zip(votes, good, strict=True):
            if pattern[i] >= 0:
                sums[pattern[i]][0] += n * p
                sums[pattern[i]][1] += n * (1 - p)
        right[k] = (inside((sums[1][0] + 1) / (sums[0][0] + sums[1][0] + 2)), inside((sums[0][1] + 1) / (sums[0][1] + sums[1][1] + 2)))
    return inside(sum(n * p for (_, n), p in zip(votes, good, strict=True)) / total if total else 0.5), right


def _good(pattern: tuple[int, ...], prior: float, right: Rates) -> float:
    odds = math.log(prior / (1 - prior))
    for vote, (on_good, on_bad) in zip(pattern, right.values(), strict=True):
        odds += math.log(on_good / (1 - on_bad)) if vote == 1 else math.log((1 - on_good) / on_bad) if vote == 0 else 0.0
    return 1 / (1 + math.exp(-min(max(odds, -500.0), 500.0)))


def posterior(prior: float, right: Rates) -> Column:
    """The probability that a document is good, given its votes."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, (on_good, on_bad) in right.items():
        odds = odds + F.when(F.col(k) == 1, math.log(on_good / (1 - on_bad))).when(F.col(k) == 0, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), quality_probability (double). Only the two named columns are read."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ruled, shown = rules(), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    votes = (F.when(bad, 0).when(good, 1).otherwise(-1).alias(k) for k, (bad, good) in ruled.items())
    seen = written(features(docs, id_col, text_col).select(*shown, base_failed.alias("base_failed"), *votes), "rules")
    names = list(ruled)
    patterns = sorted((tuple(r[k] for k in names), r["count"]) for r in seen.groupBy(*names).count().collect())  # at most 3 ** rules
    known = seen.withColumn("quality_probability", posterior(*estimate(patterns, names)))
    return known.select(*shown, "base_failed", (~F.col("base_failed") & (F.col("quality_probability") >= 0.5)).alias("kept"), "quality_probability")
