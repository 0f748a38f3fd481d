"""Exact nearest neighbours over vectors laid out by centres: blocks that cannot hold a neighbour are not read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.dense import DIGITS, Best, Scorer, _back, _matrix, _over_blocks, _sortable, _strips
from skein.operators.lexical import few, ranked
from skein.plans.storage import dropped, written

#: Rows of a block, about; cells at most; rows that the centres are fitted on; rounds of that.
BLOCK, CELLS, SAMPLE, ROUNDS = 65_536, 1024, 16_384, 8
#: Rings that each query looks into first; block numbers that a scan names, beyond which it joins with them.
FIRST, MOST_NAMED = 4, 100_000


def _centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Means of a bounded sample's cells, in the order of their main direction, so that neighbours share blocks."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.random.default_rng(1).permutation(len(sample))[: min(most, max(1, isqrt(len(sample))))]]
    for _ in range(ROUNDS):
        cell = _cells(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        count = np.bincount(cell, minlength=len(centres))
        centres = sums[count > 0] / count[count > 0, None]
    middle = centres - centres.mean(0)
    return centres[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def _cells(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * v @ centres.T).argmin(1)


def _plain(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the layout measures them: under cosine of length one."""
    return Scorer(np.zeros((0, vectors.shape[1])), metric).prepared(vectors)


@dataclass
class Layout:
    """``chunks`` (source_id, vector, cell, distance to the cell's centre, block: a folder), sorted by cell and distance
    within a block; ``rings``, a row for each block and cell in it: (block, cell, low, high, size), the distances'
    range. By the triangle inequality a vector of a ring is at least as far from a query as the ring is."""

    chunks: DataFrame
    rings: DataFrame
    centres: np.ndarray
    metric: str

    @staticmethod
    def build(chunks: DataFrame, path: str, metric: str = "l2", block: int = BLOCK, cells: int = CELLS) -> Layout:
        """Write the layout of chunks (source_id, vector) under ``path``. Centres come from a sample of SAMPLE rows at most;
        all rows are laid out, in ranges of (cell, distance, source_id), so a cell of any size spreads over blocks. Null vectors,
        vectors with a component that is not finite, and vectors of zero length under cosine are left out, as they are near nothing;
        vectors of different lengths are an error."""
        spark = chunks.sparkSession
        chunks = chunks.select("source_id", "vector").filter("vector is not null")
        rows = chunks.orderBy(F.xxhash64("source_id")).limit(SAMPLE).toArrow()
        vectors = rows.column("vector").combine_chunks()
        dimension = len(vectors[0]) if len(vectors) else 0
        sample = _plain(_matrix(vectors, dimension, None), metric) if dimension else np.zeros((0, 0))
        sample = sample[np.isfinite(sample).all(1)]
        centres = _centres(sample, cells) if len(sample) else np.zeros((1, dimension))
        sent = spark.sparkContext.broadcast(centres)
        kept = f"source_id {chunks.schema['source_id'].dataType.simpleString()}, vector {chunks.schema['vector'].dataType.simpleString()}, cell int, distance double"

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _strips(batches):
                v = _plain(_matrix(b.column("vector"), dimension, None), metric)
                good = np.isfinite(v).all(1)
                cell = _cells(v[good], sent.value)
                distance = np.sqrt(((v[good] - sent.value[cell]) ** 2).sum(1))
                b = b.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(distance)], names=["source_id", "vector", "cell", "distance"])

        assigned = written(chunks.mapInArrow(assign, kept), "cells")
        blocks = max(1, -(-assigned.count() // block))
        dealt = assigned.repartitionByRange(blocks, "cell", "distance", "source_id").withColumn("block", F.spark_partition_id())
        dealt.sortWithinPartitions("block", "cell", "distance", "source_id").write.partitionBy("block").parquet(f"{path}/chunks")
        dropped(assigned)
        laid = spark.read.schema(f"{kept}, block int").parquet(f"{path}/chunks")
        laid.groupBy("block", "cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("size")).write.parquet(f"{path}/rings")
        numbered = [(i, c.tolist(), metric) for i, c in enumerate(centres)]
        spark.createDataFrame(numbered, "cell int, centre array<double>, metric string").coalesce(1).write.parquet(f"{path}/centres")
        return Layout(laid, spark.read.parquet(f"{path}/rings"), centres, metric)

    @staticmethod
    def open(spark: SparkSession, path: str, kept: str = "source_id long, vector array<float>") -> Layout:
        """A layout that was written; ``kept``: the columns that it was built from. CELLS centres at most are read."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        laid = spark.read.schema(f"{kept}, cell int, distance double, block int").parquet(f"{path}/chunks")
        return Layout(laid, spark.read.parquet(f"{path}/rings"), np.array([r["centre"] for r in rows]), rows[0]["metric"])


class Reach:
    """How far rings are from queries, at least, with room for rounding."""

    def __init__(self, queries: np.ndarray, centres: np.ndarray, metric: str):
        q = _plain(queries, metric)
        squares = (q * q).sum(1)[:, None] + (centres * centres).sum(1)[None, :]
        between = squares - 2 * q @ centres.T
        self.near, self.far = np.sqrt(np.maximum(between - 1e-12 * squares, 0)), np.sqrt(np.maximum(between, 0) + 1e-12 * squares)
        self.metric = metric

    def least(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(queries x rings)."""
        return np.maximum(0, np.maximum(self.near[:, cells] - high * (1 + 1e-12), low * (1 - 1e-12) - self.far[:, cells]))

    def within(self, worst: np.ndarray) -> np.ndarray:
        """The greatest distance at which a vector may still be as good as ``worst``, which is rounded."""
        reach = worst + 10.0**-DIGITS
        return reach if self.metric == "l2" else np.sqrt(np.maximum(2 + 2 * reach, 0)) + 1e-9


def nearest(queries: DataFrame, layout: Layout, limit: int = 80, allowed: DataFrame | None = None, exclude_same: bool = False, report: dict | None = None) -> DataFrame:
    """What ``dense.nearest`` gives over the layout's chunks: qid, source_id, value, rank. Each query first looks
    into its nearest rings, which sets how far it must look; then only blocks with a ring within that are read, and of those
    each strip is compared only with the queries that it may serve. ``allowed`` (source_id) filters before distances; where it
    leaves a query's first rings short of ``limit`` sources, all blocks are read. Query vectors without a length
    under cosine are near nothing. A ``report`` gets the numbers of blocks: all, read first, read after that."""
    queries = queries.select("qid", "query_vector").filter("query_vector is not null")
    metric, spark = layout.metric, queries.sparkSession
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (layout.chunks, "source_id"))]
    centres = spark.sparkContext.broadcast(layout.centres)
    if report is not None:
        report.update(blocks=layout.rings.select("block").distinct().count(), first=0, second=0)

    def read(blocks: DataFrame) -> tuple[DataFrame, int]:
        """The chunks of ``blocks``, by folders' names, so that no other folder is opened."""
        rows = blocks.limit(MOST_NAMED + 1).collect()
        named = len(rows) <= MOST_NAMED
        found = layout.chunks.filter(F.col("block").isin([r["block"] for r in rows])) if named else layout.chunks.join(blocks, "block", "left_semi")
        if allowed is not None:
            found = found.join(few(allowed.select("source_id").distinct()), "source_id", "left_semi")
        return found, len(rows) if named or report is None else blocks.count()

    def over(sent: Broadcast) -> DataFrame:
        ids, vectors = sent.value
        if not ids:
            return spark.createDataFrame([], f"qid {kinds[0]}, source_id {kinds[1]}, value double")
        if vectors.shape[1] != layout.centres.shape[1]:
            raise ValueError(f"query vectors are not of dimension {layout.centres.shape[1]}")

        def reach() -> Reach:
            return Reach(sent.value[1], centres.value, metric)

        def looked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = reach()
            for b in _strips(batches):
                block, cell, low, high, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                least = at.least(cell, low, high)
                order = np.argsort(least, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                q, place = np.nonzero((before < limit) | (np.arange(len(size)) < FIRST)[None, :])
                ring = order[q, place]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(block[ring]), pa.array(cell[ring]), pa.array(least[q, ring]), pa.array(size[ring])], names=["q", "block", "cell", "least", "size"])

        def scan(chunks: DataFrame, worst: Broadcast) -> DataFrame:
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, vectors = sent.value
                best, at, kind = None, None, None
                for b in _strips(batches):
                    if best is None:
                        kind, at = b.schema.field("source_id").type, reach()
                        best = Best(_sortable(pa.array(ids)), Scorer(vectors, metric), limit, exclude_same)
                        best.worst = worst.value.copy()
                    cells, place = np.unique(b.column("cell").to_numpy(), return_inverse=True)
                    distance = b.column("distance").to_numpy()
                    low, high = np.full(len(cells), np.inf), np.zeros(len(cells))
                    np.minimum.at(low, place, distance)
                    np.maximum.at(high, place, distance)
                    live = np.nonzero((at.least(cells, low, high) <= at.within(best.worst)[:, None]).any(1))[0]
                    if len(live):
                        best.add(_sortable(b.column("source_id")), _matrix(b.column("vector"), vectors.shape[1], None), live)
                if best:
                    q, value, found = best.rows()
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), _back(found, kind), pa.array(value)], names=["q", "source_id", "value"])

            found = chunks.select("source_id", "vector", "cell", "distance").mapInArrow(run, f"q int, source_id {kinds[1]}, value double")
            return found.groupBy("q", "source_id").agg(F.min("value").alias("value"))

        nothing = spark.sparkContext.broadcast(np.full(len(ids), np.inf))
        rings = layout.rings.select("block", "cell", "low", "high", "size")
        w = Window.partitionBy("q").orderBy("least", "block", "cell")
        seen = rings.mapInArrow(looked, "q int, block int, cell int, least double, size long")
        chosen = seen.withColumn("place", F.row_number().over(w)).withColumn("before", F.sum("size").over(w) - F.col("size")).filter((F.col("place") <= FIRST) | (F.col("before") < limit))
        first = written(chosen.select("block").distinct(), "first")
        chunks, n_first = read(first)
        order = Window.partitionBy("q").orderBy("value", "source_id")
        held = written(scan(chunks, nothing).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit), "near")
        worst = np.full(len(ids), np.inf)
        for r in held.filter(F.col("place") == limit).select("q", "value").collect():  # a row for each query of the block at most
            worst[r["q"]] = r["value"]
        told = spark.sparkContext.broadcast(worst)

        def needed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = reach()
            for b in _strips(batches):
                block, cell, low, high, _ = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                near = (at.least(cell, low, high) <= at.within(told.value)[:, None]).any(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(block[near]), pa.int32())], names=["block"])

        rest = rings.join(few(first), "block", "left_anti").select(rings.columns).mapInArrow(needed, "block int").distinct()
        chunks, n_second = read(written(rest, "second"))
        if report is not None:
            report.update(first=report["first"] + n_first, second=report["second"] + n_second)
        both = held.select("q", "source_id", "value").unionByName(scan(chunks, told))
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, qid {kinds[0]}")
        return both.join(F.broadcast(names), "q").select("qid", "source_id", (F.col("value") if metric == "l2" else -F.col("value")).alias("value"))  # names: QUERY_BLOCK rows at most

    return ranked(_over_blocks(queries, over), limit, "value", metric == "cosine", DIGITS)
