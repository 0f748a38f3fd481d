"""BM25's best sources without all postings: spans of sources that cannot reach a query's threshold are not summed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators import lexical
from skein.operators.lexical import Index, few, held, named, query_terms, ranked, term_score, weights
from skein.plans.storage import dropped, written

#: Sources of a span, about; spans that each query sums first.
SPAN, FIRST = 1024, 4
#: What rounding may add to a sum, as a share and beside the six digits that count.
SHARE, DIGIT = 1e-9, 1e-6


def _spanned(names: list[str], averages: dict[str, float], span: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of source_id and a list of words for each field, in order, to blocks: so many sources at a time are a span."""
    counted = lexical._counted(names, False)

    def of(name: str, number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        coded = pa.concat_arrays(rows["term"].chunks).dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        bounds = np.append(first, len(order))
        weight = term_score(rows["tf"].to_numpy(), rows["length"].to_numpy(), averages[name])[order]
        ids = pa.concat_arrays(rows["source_id"].chunks).take(pa.array(order)) if rows.num_rows else pa.array([], rows.schema.field("source_id").type)
        top = np.maximum.reduceat(weight, first) if len(first) else weight
        both = pa.StructArray.from_arrays([ids, pa.array(weight, pa.float64())], names=["source_id", "weight"])
        columns = [pa.array([name] * len(first), pa.string()), coded.dictionary.take(coded.indices.take(pa.array(order[first]))), pa.array([number] * len(first), pa.int64()), pa.array(top, pa.float64()), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), both)]
        return pa.RecordBatch.from_arrays(columns, names=["field", "term", "span", "top", "size", "postings"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(0, b.num_rows, span):
                made = list(counted([b.slice(i, span)]))
                for k, name in enumerate(names):
                    yield of(name, number, made[k :: len(names)])
                number += 1

    return run


def _gathered(postings: DataFrame, stats: DataFrame, top: Callable[[str], Column] = F.max) -> DataFrame:
    """Postings with the ``span`` of their source to blocks. Where a source may have several postings of a term, its weights add
    up, so ``top`` is their sum."""
    weighed = postings.join(F.broadcast(stats.select("field", "average")), "field").withColumn("weight", term_score(F.col("tf"), F.col("length"), F.col("average")))  # stats: a row per field
    return weighed.groupBy("field", "term", "span").agg(top("weight").alias("top"), F.count("*").alias("size"), F.collect_list(F.struct("source_id", "weight")).alias("postings"))


@dataclass
class Blocks:
    """A generation's postings by spans of sources of like length: a row for each field, term and span with the
    greatest weight of a posting there (``top``), their number, and the postings as a list of SPAN or so at most. A
    term that most sources have spreads over all spans, and a source lies in one. ``index`` has the statistics."""

    blocks: DataFrame
    index: Index

    @staticmethod
    def build(index: Index, path: str, span: int = SPAN) -> Blocks:
        """Spans are ranges of sources by length, as weights fall with it, and id; they are made once for a generation. Postings are
        moved by source, by term and span, and by range: ``of`` moves none. One row per source id is expected."""
        spark = index.postings.sparkSession
        ids = written(index.lengths.groupBy("source_id").agg(F.sum("length").alias("size")), "ids")
        spans = max(1, -(-ids.count() // span))
        dealt = written(ids.repartitionByRange(spans, "size", "source_id").select("source_id", F.spark_partition_id().alias("span")), "spans")
        rows = _gathered(index.postings.join(few(dealt), "source_id"), index.stats)
        rows.repartitionByRange("term", "field", "span").sortWithinPartitions("term", "field", "span").write.parquet(f"{path}/blocks")
        dropped(ids, dealt)
        return Blocks.open(spark, path, index)

    @staticmethod
    def of(sources: DataFrame, fields: dict[str, Column], path: str, key: str = "source_id", span: int = SPAN) -> Blocks:
        """The same from the sources themselves, without an index's postings: sources are dealt by length and id, and a task makes its
        spans' blocks, so that texts are moved once and postings never. Blocks are sorted by term in each file. Only ids that
        several rows have are put together first; their spans are made by a hash. ``index`` has no postings then."""
        spark, kind = sources.sparkSession, sources.schema[key].dataType.simpleString()
        lexical.lengths(sources, fields, key).write.parquet(f"{path}/lengths")
        lengths = spark.read.parquet(f"{path}/lengths")
        lexical.statistics(lengths).coalesce(1).write.parquet(f"{path}/stats")
        stats = spark.read.parquet(f"{path}/stats")
        averages = {r["field"]: r["average"] for r in stats.collect()}  # a row per field
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in fields.values()), F.lit(0))
        again = lexical.repeated(sources, key)
        same = lambda how: sources.join(again, F.col(key).eqNullSafe(F.col("skein_again")), how)
        once = sources if again is None else same("left_anti")
        dealt = once.repartitionByRange(size, F.col(key)).sortWithinPartitions(size, F.col(key))
        words = dealt.select(F.col(key).alias("source_id"), *(tokens(c).alias(f"skein_{k}") for k, c in enumerate(fields.values())))
        rows = words.mapInArrow(_spanned(list(fields), averages, span), f"field string, term string, span long, top double, size long, postings array<struct<source_id:{kind},weight:double>>")
        if again is not None:
            spans = -(-again.count() // span)
            several = lexical.postings(same("left_semi"), fields, key, positions=False).withColumn("span", -1 - F.pmod(F.xxhash64("source_id"), F.lit(spans)))
            rows = rows.unionByName(_gathered(several, stats, F.sum))
        rows.sortWithinPartitions("term", "field", "span").write.parquet(f"{path}/blocks")
        spark.read.parquet(f"{path}/blocks").groupBy("field", "term").agg(F.sum("size").alias("df")).write.parquet(f"{path}/terms")
        return Blocks.open(spark, path, Index(None, lengths, stats, spark.read.parquet(f"{path}/terms")))

    @staticmethod
    def open(spark: SparkSession, path: str, index: Index) -> Blocks:
        return Blocks(spark.read.parquet(f"{path}/blocks"), index)


def search(blocks: Blocks, queries: DataFrame, text: Column, limit: int = 10, profile: str = "production_v1", allowed: DataFrame | None = None, qid: str = "qid", fields: list[str] | None = None, report: dict | None = None) -> DataFrame:
    """What ``lexical.search`` gives: qid, source_id, score, rank. A span's bound for a query is the sum of its terms'
    tops. Each query sums its FIRST best spans; its score of rank ``limit`` there is a threshold, and only spans with a bound
    that reaches it are summed after that. A query with fewer hits so far has no threshold and sums all. ``allowed`` (source_id)
    goes before the sums. A ``report`` gets the postings that the queries' terms have, and those summed first and after that."""
    terms, small = held(query_terms(queries, text, qid))
    index, own = blocks.index, blocks.blocks
    if small:
        index, own = Index(index.postings, index.lengths, index.stats, named(index.terms, terms)), named(own, terms)
    factors = few(weights(index, terms, profile, fields).select("field", "term", "factor"))
    asked = written(few(terms).join(factors, "term").select("qid", "field", "term", (F.col("qtf") * F.col("factor")).alias("times")), "asked")
    bounds = written(own.select("field", "term", "span", "top", "size").join(few(asked), ["field", "term"]).groupBy("qid", "span").agg(F.sum(F.col("times") * F.col("top")).alias("bound"), F.sum("size").alias("size")), "bounds")

    def scored(spans: DataFrame) -> DataFrame:
        """Blocks of the queries' terms are dealt by span, once; as a source lies in one span, what a query collects from it is
        summed there, and the many hits do not move."""
        wanted = spans.groupBy("span").agg(F.collect_set("qid").alias("qids"))
        dealt = own.select("field", "term", "span", "postings").join(few(asked.select("field", "term").distinct()), ["field", "term"], "left_semi").join(few(spans.select("span").distinct()), "span", "left_semi").repartition("span").join(wanted, "span")
        hit = dealt.join(few(asked), ["field", "term"]).filter(F.array_contains("qids", F.col("qid"))).select("span", "qid", "times", F.explode("postings").alias("p")).select("span", "qid", "p.source_id", (F.col("times") * F.col("p.weight")).alias("part"))
        if allowed is not None:
            hit = hit.join(few(allowed.select("source_id").distinct()), "source_id", "left_semi")
        return hit.groupBy("span", "qid", "source_id").agg(F.sum("part").alias("score")).drop("span")

    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("bound").desc(), "span"))
    first = written(bounds.withColumn("place", place).filter(F.col("place") <= FIRST).drop("place"), "first")
    best = written(ranked(scored(first), limit), "best")
    threshold = best.filter(F.col("rank") == limit).select("qid", F.col("score").alias("least"))
    open_spans = bounds.join(first.select("qid", "span"), ["qid", "span"], "left_anti").join(few(threshold), "qid", "left")
    rest = written(open_spans.filter(F.col("least").isNull() | (F.col("bound") * (1 + SHARE) + DIGIT >= F.col("least"))).select("qid", "span", "size"), "rest")
    if report is not None:
        report.update({n: df.agg(F.sum("size")).first()[0] or 0 for n, df in (("postings", bounds), ("first", first), ("second", rest))})
    return ranked(best.select("qid", "source_id", "score").unionByName(scored(rest)), limit)
