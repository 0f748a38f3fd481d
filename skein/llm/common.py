"""Helpers that the operators of this subpackage share: inputs, bounded samples, row filters."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.ngrams import slices
from skein.plans import storage
from skein.plans.storage import dropped, new_folder, temporary

__all__ = ["column", "dropped", "labelled_sample", "let", "new_folder", "parts", "remainder", "rows_that", "sampled", "share", "small_batches", "table", "temporary", "worker_threads", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def share(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def worker_threads() -> None:
    """One native thread for each Python worker: Spark runs a worker on every core already."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambdas that refer to a column otherwise get its
    whole expression put in, and compute it for each element."""
    return F.transform(F.array(value), body)[0]


# -- batches ------------------------------------------------------------------------------------
#: Rows and bytes of a batch that goes to a Python worker, while a table is written here.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, batches for Python workers hold BATCH_ROWS rows and about BATCH_BYTES bytes at most;
    afterwards the session's settings are as before. A table that a caller evaluates later comes in
    batches of the caller's settings (64 MB if there are none), of which ``parts`` takes a little at a time."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        before[key] = spark.conf.get(key, None)
        m = re.fullmatch(r"(-?\d+)([a-z]*)", (before[key] or "-1").strip().lower())
        now = int(m[1]) * _UNITS[m[2]] if m else -1
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder, with small batches, and read again."""
    with small_batches(df.sparkSession):
        return storage.written(df, label)


def parts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of the batches, of about a million characters together (or one longer text), with
    their texts; nulls are empty."""
    for b in batches:
        first = 0
        for texts in slices(b.column(b.schema.get_field_index(column))):
            yield b.slice(first, len(texts)), texts
            first += len(texts)


def rows_that(docs: DataFrame, judge, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``judge`` accepts, all columns as they are; no shuffle.
    ``judge``: called on a worker with a list of whole texts (null: ''), gives a boolean for each."""

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots do not go to workers
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in parts(batches, text):
            yield b.filter(pa.array(np.asarray(judge(texts), bool)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


# -- samples ------------------------------------------------------------------------------------
#: Characters of a class's sampled texts, at most (but for the last one, which is taken whole).
CLASS_CHARS = 8_000_000
#: Classes whose sizes may be broadcast (a name and a number each).
MOST_CLASSES = 100_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, seed: str, most_chars: int = CLASS_CHARS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts for fitting, among the documents that ``learn`` admits: see
    ``sampled``. Labels other than 0 and 1 are none; of different labels of one id the greatest counts."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("string").alias("skein_class"))
    chosen = F.broadcast(share_of_class(known, per_class, seed))  # about 2 * per_class ids
    texts, classes = sampled(docs.select("doc_id", "text").join(chosen, "doc_id"), seed, most_chars)
    return texts, [int(k) for k in classes]


def share_of_class(rows: DataFrame, per_class: int, seed: str) -> DataFrame:
    """Of ``rows`` (doc_id, skein_class, ...) about ``per_class`` of each class, by a hash of the id. The
    classes' sizes, a row each, are broadcast if a count says that there are few, so rows do not move."""
    sizes = written(rows.groupBy("skein_class").agg(F.count("*").alias("skein_size")), "class-sizes")
    known = rows.join(F.broadcast(sizes) if sizes.count() <= MOST_CLASSES else sizes, "skein_class")
    return known.filter(share(F.col("doc_id"), seed) * F.col("skein_size") < per_class).select(*rows.columns)


def sampled(chosen: DataFrame, seed: str, most_chars: int) -> tuple[list[str], list[str]]:
    """Texts and classes of ``chosen`` (doc_id, text, skein_class), a bounded number of rows, in order of id:
    of each class, in the order of a hash of the id, rows up to ``most_chars`` characters together. The
    order knows nothing of a text's length, and texts are whole, so texts of any length can be among
    them. Of rows that repeat an id and class one counts."""
    one = written(chosen.groupBy("doc_id", "skein_class").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "sample")
    w = Window.partitionBy("skein_class").orderBy(share(F.col("doc_id"), seed), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = one.select("doc_id", "skein_class", F.length("text").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).filter(F.col("before") < most_chars)
    rows = sorted((r["doc_id"], r["text"], r["skein_class"]) for r in one.join(F.broadcast(sizes.select("doc_id", "skein_class")), ["doc_id", "skein_class"]).select("doc_id", "text", "skein_class").collect())
    dropped(one)
    return [r[1] for r in rows], [r[2] for r in rows]
