"""Registration of queries, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.lexical import Index, query_terms, ranked, scores
from skein.plans.storage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple[str, str, bool], str] = {}


def fields() -> dict[str, Column]:
    """Fields of ``documents``: title (first line) and body."""
    text = F.coalesce("text", F.lit(""))
    return {"title": F.substring_index(text, "\n", 1), "body": text}


def index_of(spark: SparkSession, sf_dir: str, phrases: bool = False) -> Index:
    """The lexical index of ``documents``, built once per application, with positions if ``phrases`` are looked for."""
    key = (spark.sparkContext.applicationId, sf_dir, phrases)
    if key not in _indexes:
        path = new_folder(spark, "index")
        Index.build(t(spark, sf_dir, "documents"), fields(), path, "doc_id", phrases)
        _indexes[key] = path
    return Index.open(spark, _indexes[key])


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_terms(t(spark, sf_dir, "benchmark"), F.col("text"), "item_id")


def lexical_hits(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """BM25 over the bodies: qid, source_id, score, rank."""
    return ranked(scores(index_of(spark, sf_dir), benchmark_terms(spark, sf_dir), fields=["body"]), limit)


TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' and strlen(x) < 40)"


def bm25_sql(where: str = "true", boosts: str = "1.0::double", fields: tuple[str, ...] = ("body",)) -> str:
    """WITH clauses up to ``scored`` (qid, source_id, score): ``where`` restricts the scored documents d."""
    exprs = {"title": "split_part(coalesce(text, ''), chr(10), 1)", "body": "text"}
    each = " union all ".join(f"select '{f}' as field, doc_id, {TOKENS.format(exprs[f])} as toks from documents" for f in fields)
    return f"""with docs as ({each}),
    stats as (select field, count(*)::double as n, avg(len(toks))::double as average from docs group by field),
    terms as (select field, doc_id, len(toks)::double as length, unnest(toks) as term from docs),
    post as (select field, doc_id, term, length, count(*)::double as tf from terms group by all),
    freq as (select field, term, count(*)::double as df from post group by all),
    qt as (select item_id as qid, term, count(*) as qtf from (select item_id, unnest({TOKENS.format("text")}) as term from benchmark) group by all),
    scored as (select qt.qid, p.doc_id as source_id,
        sum(qt.qtf * ({boosts}) * ln(1 + (s.n - f.df + 0.5::double) / (f.df + 0.5::double)) * p.tf * 2.2::double / (p.tf + 1.2::double * (0.25::double + 0.75::double * p.length / s.average))) as score
        from qt join post p on p.term = qt.term join freq f on f.field = p.field and f.term = p.term join stats s on s.field = p.field
        where p.doc_id in (select doc_id from documents d where {where}) group by all)"""


def top_sql(limit: int, name: str = "scored") -> str:
    return f"""(select qid, source_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, source_id) as rank from {name} qualify rank <= {limit})"""
