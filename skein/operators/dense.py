"""Exact nearest neighbours of a table of query vectors, filtered before distances are computed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.lexical import ranked
from skein.plans.storage import written

#: Query vectors that go to every task at once; more are taken in blocks of so many, one after another.
QUERY_BLOCK = 4096
#: Vectors that a task compares with a block at once; candidates that it gathers before it cuts them; components of pairs
#: that are compared anew at once, and of distances by a product. They bound a task's memory, whatever the number of queries.
STRIP, GATHERED, ANEW, TILE = 512, 1 << 19, 1 << 20, 1 << 19
DIGITS = 6


def _matrix(vectors: pa.Array, dimension: int, first: int | None) -> np.ndarray:
    """Rows of doubles; vectors of another dimension than the queries' are an error."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes != dimension).any():
        raise ValueError(f"vector is not of dimension {dimension}")
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), dimension)[:, :first]


class Scorer:
    """Distances of strips of vectors to a block of queries; less is nearer."""

    def __init__(self, queries: np.ndarray, metric: str):
        self.metric = metric
        self.queries = self.prepared(queries)
        self.squares = (self.queries * self.queries).sum(1)

    def of(self, queries: np.ndarray) -> Scorer:
        """The scorer of some of its queries, by number."""
        part = copy(self)
        part.queries, part.squares = self.queries[queries], self.squares[queries]
        return part

    def prepared(self, v: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return v
        length = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, length, out=np.full_like(v, np.nan), where=length > 0)

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x queries, by a product), squared under l2, and what rounding may have added to each row."""
        product = v @ self.queries.T
        if self.metric == "cosine":
            return -product, np.full(len(v), 1e-9)
        squares = (v * v).sum(1)
        return squares[:, None] + self.squares[None, :] - 2 * product, 1e-12 * (squares + np.fmax.reduce(self.squares, initial=0.0))

    def value(self, v: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """What counts: computed anew for each pair, rounded. Pairs go by pieces: each holds as many components as its vectors."""
        out, step = np.empty(len(rows)), max(1, ANEW // max(1, v.shape[1]))
        for i in range(0, len(rows), step):
            a, b = v[rows[i : i + step]], self.queries[queries[i : i + step]]
            out[i : i + step] = -(a * b).sum(1) if self.metric == "cosine" else np.sqrt(((a - b) ** 2).sum(1))
        return np.round(out, DIGITS)

    def bound(self, worst: np.ndarray) -> np.ndarray:
        """The greatest product distance that may round to ``worst`` or less."""
        reach = worst + 10.0**-DIGITS
        return reach if self.metric == "cosine" else reach * np.abs(reach)


class Best:
    """The nearest sources of each query among what one task has seen so far, as arrays: a source with
    its best vector, ties by id."""

    def __init__(self, ids: np.ndarray, scorer: Scorer, limit: int, exclude_same: bool):
        self.ids, self.scorer, self.limit, self.exclude_same = ids, scorer, limit, exclude_same
        self.worst = np.full(len(ids), np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, live: np.ndarray | None = None) -> None:
        """Sources' vectors; where it is known that they can only be near to some queries, ``live`` numbers those."""
        v = self.scorer.prepared(vectors)
        live = np.arange(len(self.ids)) if live is None else live
        single = 0 < self.limit < len(ids) - 1 and len(np.unique(ids)) == len(ids)  # else a source's vectors count once
        step = max(1, TILE // max(1, len(v)))
        for i in range(0, len(live), step):
            self._tile(ids, v, live[i : i + step], single)

    def _tile(self, ids: np.ndarray, v: np.ndarray, live: np.ndarray, single: bool) -> None:
        near, slack = self.scorer.of(live).near(v)
        worst = self.scorer.bound(self.worst[live])
        if single and np.isinf(worst).any():
            worst = np.minimum(worst, self._within(ids, near, slack, live))
        rows, queries = np.nonzero(near <= worst[None, :] + slack[:, None])
        queries = live[queries]
        value = self.scorer.value(v, rows, queries)
        good = value <= self.worst[queries]
        if self.exclude_same:
            good &= ids[rows] != self.ids[queries]
        self.kept.append((queries[good], value[good], ids[rows[good]]))
        self.size += int(good.sum())
        if self.size > max(GATHERED, 2 * self.limit * len(self.ids)):
            self.cut()

    def _within(self, ids: np.ndarray, near: np.ndarray, slack: np.ndarray, live: np.ndarray) -> np.ndarray:
        """For each query a product distance within which ``limit`` of these sources lie: what is beyond it need not be
        compared anew, also while nothing is known of other sources."""
        far = near + slack[:, None]
        if self.exclude_same:
            far[ids[:, None] == self.ids[live][None, :]] = np.inf
        far[np.isnan(far)] = np.inf
        least = np.partition(far, self.limit - 1, axis=0)[self.limit - 1]
        # what is as near after rounding counts too, so the bound is that of a rounded value
        value = least if self.scorer.metric == "cosine" else np.sqrt(np.maximum(least, 0))
        return np.where(np.isfinite(least), self.scorer.bound(value + 10.0**-DIGITS), np.inf)

    def offer(self, queries: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        """Values that were computed elsewhere: of queries, by number, and sources."""
        self.kept.append((queries, value, ids))
        self.size += len(queries)
        if self.size > max(GATHERED, 2 * self.limit * len(self.ids)):
            self.cut()

    def cut(self) -> None:
        q, value, ids = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((value, ids, q))
        q, value, ids = q[order], value[order], ids[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])  # a source's best vector
        q, value, ids = q[first], value[first], ids[first]
        order = np.lexsort((ids, value, q))
        q, value, ids = q[order], value[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.limit
        last = place == self.limit - 1
        self.worst[q[last]] = value[last]
        self.kept, self.size = [(q[top], value[top], ids[top])], int(top.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.kept:
            self.cut()
            return self.kept[0]
        return np.zeros(0, int), np.zeros(0), self.ids[:0]


def _sortable(column: pa.Array) -> np.ndarray:
    """Ids as a numpy array that sorts as Spark does: texts as UTF-8 bytes."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array([x.encode() for x in column.to_pylist()], "S") if len(column) else np.zeros(0, "S1")
    return column.to_numpy(zero_copy_only=False)


def _back(ids: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([x.decode() for x in ids.tolist()], kind) if ids.dtype.kind == "S" else pa.array(ids, kind)


def _over_blocks(queries: DataFrame, run: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """``run`` over each block of the queries (qid, query_vector), given as a broadcast of their ids, a list,
    and vectors. With several blocks each one's result is written before the next, so only one block at a
    time is held by the executors."""
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    out = []
    for k in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        rows = sorted((r["qid"], r["query_vector"]) for r in block.collect())
        sizes = {len(v) for _, v in rows}
        if len(sizes) > 1:
            raise ValueError(f"query vectors are of dimensions {sorted(sizes)}")
        sent = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), max(sizes, default=0))))
        made = run(sent)
        if blocks > 1:
            made = written(made, "near")
            sent.unpersist()
        out.append(made)
    return reduce(DataFrame.unionByName, out)


def _strips(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, STRIP):
            yield b.slice(i, STRIP)


def nearest(queries: DataFrame, chunks: DataFrame, limit: int = 80, metric: str = "l2", allowed: DataFrame | None = None, exclude_same: bool = False, dimension: int | None = None) -> DataFrame:
    """queries (qid, query_vector), chunks (source_id, vector): for each query the ``limit`` nearest
    sources by ``metric`` (l2, or cosine with the greatest first) over the first ``dimension`` components:
    qid, source_id, value, rank. A source counts with its best chunk; ties go by source_id. ``allowed``
    (source_id) filters before distances; ``exclude_same`` leaves a query's own id out.

    A stated query set meets all chunks in blocks of a bounded size. Every task keeps only its best
    sources per query, in arrays, so neither its memory nor what is shuffled grows with the number of
    pairs. Null vectors, and vectors of zero length under cosine, are never near; vectors of different
    lengths are an error."""
    chunks = chunks.select("source_id", "vector").filter("vector is not null")
    queries = queries.select("qid", "query_vector").filter("query_vector is not null")
    if allowed is not None:
        chunks = chunks.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, source_id {chunks.schema['source_id'].dataType.simpleString()}, value double"

    def over(sent: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            best, kind = None, None
            for b in _strips(batches) if ids else ():
                kind = b.schema.field("source_id").type
                best = best or Best(_sortable(pa.array(ids)), Scorer(vectors[:, :dimension], metric), limit, exclude_same)
                best.add(_sortable(b.column("source_id")), _matrix(b.column("vector"), vectors.shape[1], dimension))
            if best:
                q, value, found = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), _back(found, kind), pa.array(value if metric == "l2" else -value)], names=["qid", "source_id", "value"])

        return chunks.mapInArrow(run, schema)

    descending = metric == "cosine"
    pooled = _over_blocks(queries, over).groupBy("qid", "source_id").agg((F.max if descending else F.min)("value").alias("value"))
    return ranked(pooled, limit, "value", descending, DIGITS)


def best_in_groups(queries: DataFrame, chunks: DataFrame, group: str, metric: str = "cosine", exclude_same: bool = False) -> DataFrame:
    """For each query and each value of the column ``group`` of the chunks (source_id, vector, group) the
    nearest source: qid, group, source_id, value. Tasks pool what they see; no pairs are made."""
    chunks = chunks.select("source_id", "vector", group).filter("vector is not null")
    queries = queries.select("qid", "query_vector").filter("query_vector is not null")
    of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"qid {of(queries, 'qid')}, `{group}` {of(chunks, group)}, source_id {of(chunks, 'source_id')}, value double"

    def over(sent: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            seen: dict = {}
            scorer, own, kinds = Scorer(vectors, metric) if ids else None, _sortable(pa.array(ids)) if ids else None, None
            for b in _strips(batches) if ids else ():
                kinds = (b.schema.field(group).type, b.schema.field("source_id").type)
                groups = b.column(group).dictionary_encode()
                codes = groups.indices.to_numpy(zero_copy_only=False)
                sources, v = _sortable(b.column("source_id")), _matrix(b.column("vector"), vectors.shape[1], None)
                for code, name in enumerate(groups.dictionary.to_pylist()):
                    rows = codes == code
                    if name not in seen:
                        seen[name] = Best(own, scorer, 1, exclude_same)
                    seen[name].add(sources[rows], v[rows])
                    seen[name].cut()
            for name, best in seen.items():
                q, value, found = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array([name] * len(q), kinds[0]), _back(found, kinds[1]), pa.array(value if metric == "l2" else -value)], names=["qid", group, "source_id", "value"])

        return chunks.mapInArrow(run, schema)

    pooled = _over_blocks(queries, over)
    order = F.col("value") if metric == "l2" else -F.col("value")
    best = F.min(F.struct(order.alias("o"), "source_id", "value")).alias("b")
    return pooled.groupBy("qid", group).agg(best).select("qid", group, "b.source_id", "b.value")


def max_pooled(scored: DataFrame, by: list[str], score: str, keep: list[str]) -> DataFrame:
    """The best scored row of each group, ties by the kept columns in ascending order."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *(F.col(k).asc() for k in keep))
    return scored.withColumn("skein_best", F.row_number().over(w)).filter("skein_best = 1").drop("skein_best")
