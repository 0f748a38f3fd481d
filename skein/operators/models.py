"""Seams for encoders and rerank scorers: batching, pooling, token windows, staging. Models are plugged in
as picklable objects; they are loaded once in each Python worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one model call; texts of more than LONG tokens go alone.
BATCH, LONG = 4, 128
#: Prefix of a query text for encoding; tokens of a rerank pair, of its query at most, of
#: its document at least.
QUERY_PREFIX = "query: "
PAIR_TOKENS, QUERY_TOKENS, DOCUMENT_TOKENS = 384, 96, 128
_WORD = re.compile(r"\w+|[^\w\s]")


class Encoder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashingEncoder:
    """A deterministic stand-in for a model: signed counts of hashed words, of length one."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts, strict=True):
            for w in _WORD.findall(t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        out[:, 0] += ~out.any(1)
        return out / np.sqrt((out * out).sum(1, keepdims=True))


class OverlapScorer:
    """A deterministic stand-in for a reranker: shared words over the query's words."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(_WORD.findall(t.lower()))
        return [len(words(q) & words(d)) / max(1, len(words(q))) for q, d in pairs]


def query_input(text: Column) -> Column:
    """What an encoder gets of a query's text."""
    return F.concat(F.lit(QUERY_PREFIX), F.coalesce(text, F.lit("")))


def pooled(states: np.ndarray, mask: np.ndarray, kind: str) -> np.ndarray:
    """Token states (tokens, dimension) to one vector: cls, mean, or last."""
    inside = np.flatnonzero(mask)
    return {"cls": lambda: states[inside[0]], "mean": lambda: states[inside].mean(0), "last": lambda: states[inside[-1]]}[kind]()


def fitted(text: str, most: int) -> str:
    """The longest prefix that ends with a token and has at most ``most`` tokens."""
    end = 0
    for n, m in enumerate(_WORD.finditer(text)):
        if n == most:
            return text[:end]
        end = m.end()
    return text


def pair_texts(query: str, document: str) -> tuple[str, str]:
    """A rerank pair within PAIR_TOKENS: the query first, the document gets what is left."""
    q = fitted(query, QUERY_TOKENS)
    left = max(DOCUMENT_TOKENS, PAIR_TOKENS - len(_WORD.findall(q)))
    return q, fitted(document, left)


def batches_by_length(texts: list[str]) -> Iterator[list[int]]:
    """Rows in calls of similar length: short ones BATCH at a time, long ones alone."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    short = [i for i in order if len(_WORD.findall(texts[i])) <= LONG]
    yield from (short[k : k + BATCH] for k in range(0, len(short), BATCH))
    held = set(short)
    yield from ([i] for i in order if i not in held)


_loaded: dict[bytes, object] = {}


def _plugged(raw: bytes):
    """The plugged-in object, unpickled once in each Python worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded[key] = cloudpickle.loads(raw)
    return _loaded[key]


def _encoded(model: Encoder, texts: list[str], strict: bool) -> list:
    """The texts' vectors; if not strict, None for each that fails."""
    try:
        out = np.asarray(model.encode(texts), float)
        if not np.isfinite(out).all():
            raise ValueError("encoder gave a vector that is not finite")
        return list(out)
    except Exception:
        if strict:
            raise
        return [None] if len(texts) == 1 else [v for t in texts for v in _encoded(model, [t], strict)]


def embedded(rows: DataFrame, encoder: Encoder, text: str, keep: list[str], prefix: str = "", strict: bool = True) -> DataFrame:
    """``keep`` columns and ``vector``: array<double> of length one. Not ``strict``: a text that the encoder
    fails on has a null vector, for queries that can do without."""
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(encoder))
    source = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("skein_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", vector array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _plugged(sent.value)
        for b in batches:
            texts = [prefix + t for t in b.column("skein_text").to_pylist()]
            out: list = [None] * len(texts)
            for part in batches_by_length(texts):
                for i, v in zip(part, _encoded(model, [texts[i] for i in part], strict), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.list_(pa.float64()))], names=[*keep, "vector"])

    return source.mapInArrow(run, schema)


def scored_pairs(pairs: DataFrame, scorer: Scorer, query: str, document: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of each (query, document) pair."""
    sent = pairs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorer))
    source = pairs.select(*keep, F.coalesce(F.col(query), F.lit("")).alias("skein_q"), F.coalesce(F.col(document), F.lit("")).alias("skein_d"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]) + ", score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _plugged(sent.value)
        for b in batches:
            both = [pair_texts(q, d) for q, d in zip(b.column("skein_q").to_pylist(), b.column("skein_d").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(model.score(both), pa.float64())], names=[*keep, "score"])

    return source.mapInArrow(run, schema)


def staged(chunks: DataFrame, done: DataFrame, encoder: Encoder) -> DataFrame:
    """Embedding rows for the chunks (chunk_id, context_hash, body) that ``done`` lacks; to be appended to
    the generation, so an interrupted run goes on where it was."""
    missing = chunks.join(done.select("chunk_id", "context_hash"), ["chunk_id", "context_hash"], "left_anti")
    return embedded(missing, encoder, "body", ["chunk_id", "context_hash"])


def complete(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """One row: total, completed, extra; a generation may be published if completed = total, extra = 0."""
    keys = ["chunk_id", "context_hash"]
    lacking = chunks.join(done.select(*keys), keys, "left_anti").agg(F.count("*").alias("lacking"))
    extra = done.join(chunks.select(*keys), keys, "left_anti").agg(F.count("*").alias("extra"))
    return chunks.agg(F.count("*").alias("total")).crossJoin(lacking).crossJoin(extra).select("total", (F.col("total") - F.col("lacking")).alias("completed"), "extra")


def activated(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """``done``, to be published: an error unless it holds each chunk once, no other, and all vectors have
    one dimension."""
    state = complete(chunks, done).first()
    shape = done.agg(F.count_distinct("chunk_id").alias("ids"), F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if state["completed"] != state["total"] or state["extra"] or shape["ids"] != shape["n"] or shape["low"] != shape["high"]:
        raise RuntimeError(f"embedding.generation_incomplete: {state['completed']} of {state['total']} chunks, {state['extra']} others, {shape['n'] - shape['ids']} repeated, dimensions {shape['low']} to {shape['high']}")
    return done
