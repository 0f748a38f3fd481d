"""BM25 over a prebuilt inverted index, for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.plans.storage import written

#: Fixed values of the score; boosts by ranking profile.
K1, B = 1.2, 0.75
#: Rows of a table of terms that may be broadcast. Up to so many rows of query terms are fetched at once, and looked up
#: by name; so many of their postings are summed where they are, without being dealt by source first.
MOST_BROADCAST, FEW_TERMS, FEW_POSTINGS = 200_000, 500, 500_000
#: Sources whose words a task counts at once.
AT_ONCE = 256
PROFILES = {"production_v1": {}, "metadata_boost_v1": {"title": 2.0, "parent_title": 2.0, "cjk_ngrams": 0.25}}


def _counted(names: list[str], positions: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of source_id and a list of words for each field to their postings, a few sources at a time."""

    def of(name: str, ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
        lengths = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(ids)), lengths)
        key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")  # a word's places stay in order
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        bounds = np.append(first, len(order))
        place = (np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row])[order]
        own = row[order[first]]
        columns = [pa.array([name] * len(first), pa.string()), ids.take(pa.array(own)), coded.dictionary.take(coded.indices.take(pa.array(order[first]))), pa.array(lengths[own], pa.int64()), pa.array(np.diff(bounds), pa.int64())]
        if positions:
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=["field", "source_id", "term", "length", "tf", "positions"][: len(columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                part = b.slice(i, AT_ONCE)
                for k, name in enumerate(names):
                    yield of(name, part.column(0), part.column(k + 1))

    return run


def repeated(sources: DataFrame, key: str) -> DataFrame | None:
    """The ids (skein_again) that several rows have, if there are any."""
    again = written(sources.groupBy(F.col(key).alias("skein_again")).count().filter("count > 1").select("skein_again"), "repeated")
    return None if again.isEmpty() else again


def postings(sources: DataFrame, fields: dict[str, Column], key: str = "source_id", positions: bool = True) -> DataFrame:
    """(field, source_id, term, length, tf, and the positions, from 0, if asked for). A source's postings are made where it is read, without a
    shuffle; only those of ids that several rows have are put together. A search without phrases does not read the positions."""
    words = sources.select(F.col(key).alias("source_id"), *(tokens(c).alias(f"skein_{k}") for k, c in enumerate(fields.values())))
    kind = sources.schema[key].dataType.simpleString()
    schema = f"field string, source_id {kind}, term string, length long, tf long" + ", positions array<int>" * positions
    made = lambda df: df.mapInArrow(_counted(list(fields), positions), schema)
    again = repeated(sources, key)
    if again is None:
        return made(words)
    same = F.col("source_id").eqNullSafe(F.col("skein_again"))
    places = [F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")] * positions
    merged = made(words.join(again, same, "left_semi")).groupBy("field", "source_id", "term", "length").agg(F.sum("tf").alias("tf"), *places)
    return made(words.join(again, same, "left_anti")).unionByName(merged)


def lengths(sources: DataFrame, fields: dict[str, Column], key: str = "source_id") -> DataFrame:
    """(field, source_id, length)."""
    parts = F.array(*(F.struct(F.lit(n).alias("field"), F.size(tokens(c)).cast("long").alias("length")) for n, c in fields.items()))
    return sources.select(F.col(key).alias("source_id"), F.explode(parts).alias("part")).select("part.field", "source_id", "part.length")


def statistics(lengths: DataFrame) -> DataFrame:
    """A row per field: sources, average length."""
    return lengths.groupBy("field").agg(F.count("*").alias("sources"), F.avg("length").alias("average"))


@dataclass
class Index:
    """A generation's lexical tables. ``stats`` has a row per field: sources, average length; ``terms``
    has the number of sources of each field's terms."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame

    @staticmethod
    def build(sources: DataFrame, fields: dict[str, Column], path: str, key: str = "source_id", phrases: bool = True) -> Index:
        """Write the tables under ``path``. Postings are dealt by range and sorted by term, so that a lookup
        of terms reads few row groups; a term that most sources have spreads over several files. Only an index that
        phrases are looked for in (``phrases``) needs positions, which are most of what would be moved."""
        spark = sources.sparkSession
        found = postings(sources, fields, key, phrases)
        found.repartitionByRange("term", "field", "source_id").sortWithinPartitions("term", "field", "source_id").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/postings")
        lengths(sources, fields, key).write.parquet(f"{path}/lengths")
        statistics(spark.read.parquet(f"{path}/lengths")).coalesce(1).write.parquet(f"{path}/stats")
        counted = spark.read.parquet(f"{path}/postings").groupBy("field", "term").agg(F.count("*").alias("df"))
        counted.repartitionByRange("term", "field").sortWithinPartitions("term", "field").write.parquet(f"{path}/terms")
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "stats", "terms")))


def query_terms(queries: DataFrame, text: Column, qid: str = "qid") -> DataFrame:
    """(qid, term, qtf); a repeated term counts as often as it stands in the query."""
    return queries.select(F.col(qid).alias("qid"), F.explode(tokens(text)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def document_frequencies(index: Index) -> DataFrame:
    return index.terms.select("field", "term", "df")


def idf(sources: Column, df: Column) -> Column:
    return F.log(1 + (sources - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count says that it is small; else Spark decides."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def held(df: DataFrame, most: int = FEW_TERMS) -> tuple[DataFrame, bool]:
    """``df`` as a table of its own rows, if it has ``most`` at most (and whether it has)."""
    rows = df.limit(most + 1).toArrow()
    return (df.sparkSession.createDataFrame(rows, df.schema), True) if rows.num_rows <= most else (df, False)


def named(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``table`` whose term is one of the held ``terms``, by names that reach the files' statistics."""
    return table.filter(F.col("term").isin(sorted({r["term"] for r in terms.select("term").collect()})))


def weights(index: Index, terms: DataFrame, profile: str = "production_v1", fields: list[str] | None = None) -> DataFrame:
    """(field, term, average, factor, df) of the asked ``terms`` (term): what a posting's score is made of.
    The frequencies are the index's own; postings are not counted."""
    boost = F.lit(1.0)
    for field, value in PROFILES[profile].items():
        boost = F.when(F.col("field") == field, value).otherwise(boost)
    known = index.terms if fields is None else index.terms.filter(F.col("field").isin(fields))
    asked = known.join(few(terms.select("term").distinct()), "term", "left_semi") if terms is not None else known
    return asked.join(F.broadcast(index.stats), "field").select("field", "term", "average", (boost * idf(F.col("sources"), F.col("df"))).alias("factor"), "df")  # stats: a row per field


def looked_up(index: Index, terms: DataFrame, profile: str = "production_v1", fields: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(terms, postings, dealt): the asked terms, held if they are few, and their postings with average and factor.
    Few terms cost two small jobs, of which the second fetches their frequencies; postings are then read by name. More
    than a few postings are dealt by source, once: what is grouped by source after that stays where it is."""
    terms, small = held(terms)
    if small:
        weight, _ = held(weights(Index(index.postings, index.lengths, index.stats, named(index.terms, terms)), None, profile, fields), FEW_TERMS * 16)
        dealt = (weight.agg(F.sum("df")).first()[0] or 0) > FEW_POSTINGS
        own = named(index.postings, terms).join(F.broadcast(weight.drop("df")), ["field", "term"])  # FEW_TERMS terms of each field at most
        return F.broadcast(terms), own.repartition("source_id") if dealt else own, dealt
    own = index.postings.join(few(weights(index, terms, profile, fields).drop("df")), ["field", "term"])
    return few(terms), own.repartition("source_id"), True


def scores(index: Index, terms: DataFrame, profile: str = "production_v1", allowed: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """(qid, source_id, score). Statistics are those of the whole index; ``allowed`` (qid, source_id or
    source_id alone) restricts what is scored. The query's terms meet the postings first, so only their
    postings are shuffled, once, by source: what a query collects from a source's postings is then summed
    where they are, and the many (query, source) hits do not move."""
    terms, own, _ = looked_up(index, terms, profile, fields)
    if allowed is not None and "qid" not in allowed.columns:
        own = own.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
    hit = own.join(terms, "term")
    if allowed is not None and "qid" in allowed.columns:
        hit = hit.join(allowed, ["qid", "source_id"], "left_semi")
    w = F.col("factor") * term_score(F.col("tf"), F.col("length"), F.col("average"))
    return hit.groupBy("qid", "source_id").agg(F.sum(w * F.col("qtf")).alias("score"))


def ranked(scored: DataFrame, limit: int | None = None, order: str = "score", descending: bool = True, digits: int = 6) -> DataFrame:
    """Ranks from 1 per query by the rounded score, then source_id; Spark keeps ``limit`` rows per query
    before the shuffle already."""
    value = F.round(order, digits)
    w = Window.partitionBy("qid").orderBy(value.desc() if descending else value.asc(), F.col("source_id").asc())
    out = scored.withColumn(order, value).withColumn("rank", F.row_number().over(w).cast("long"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def search(index: Index, queries: DataFrame, text: Column, limit: int = 10, profile: str = "production_v1", allowed: DataFrame | None = None, qid: str = "qid", fields: list[str] | None = None) -> DataFrame:
    """Top ``limit`` sources of each query: qid, source_id, score, rank. No rows for a limit of 0."""
    return ranked(scores(index, query_terms(queries, text, qid), profile, allowed, fields), limit)
