"""The query lifecycle over a table of queries: one plan from route to result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import cjk_ngrams, expanded_query
from skein.operators import dense, fusion, grammar, lexical, resolve
from skein.operators.filters import Filters, allowed, predicate
from skein.plans.storage import written

#: Fields of an indexed source, and those a query goes over by default.
FIELDS = {"title": "title", "body": "body", "labels": "labels", "repo": "repo", "issue_number": "issue_number", "parent_title": "parent_issue_title"}
SEARCHED = [*FIELDS, "cjk_ngrams"]


def index_fields() -> dict[str, Column]:
    out = {k: F.array_join(v, " ") if k == "labels" else F.coalesce(F.col(v).cast("string"), F.lit("")) for k, v in FIELDS.items()}
    whole = F.concat_ws(" ", "title", "body", "parent_issue_title")
    return out | {"cjk_ngrams": F.array_join(cjk_ngrams(whole), " ")}


@dataclass
class Corpus:
    """A publication's tables. ``chunks`` (source_id, vector) may be missing or not be ready: then search is
    lexical. ``fingerprint`` and ``dimension`` are those that the vectors were made with; ``evidence``
    holds chunks (source_id, version, chunk_index, body)."""

    sources: DataFrame
    tombstones: DataFrame
    index: lexical.Index
    chunks: DataFrame | None = None
    evidence: DataFrame | None = None
    ready: bool = True
    fingerprint: str | None = None
    dimension: int | None = None

    def dense_error(self, fingerprint: str | None) -> str | None:
        """Why no vector search takes place at all, if there are vectors."""
        if self.chunks is not None and not self.ready:
            return "embedding.not_ready"
        return "embedding.fingerprint_mismatch" if self.chunks is not None and self.fingerprint != fingerprint else None


def query_errors(queries: DataFrame) -> DataFrame:
    """(qid, error) of the queries that cannot be parsed; they have no results. Exact ones are not parsed."""
    return queries.select("qid", grammar.query_error(F.col("query"), SEARCHED).alias("error")).filter("error is not null")


def warnings(corpus: Corpus, queries: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """(qid, warning): why a query gets lexical results only, where the corpus has vectors."""
    whole = corpus.dense_error(fingerprint)
    if corpus.chunks is None:
        return queries.select("qid", F.lit("").alias("warning")).limit(0)
    if whole:
        return queries.select("qid", F.lit(whole).alias("warning"))
    said = F.when(F.col("query_vector").isNull(), "embedding.query_encoding_failed").when(~_fits(corpus), "embedding.query_dimension_mismatch")
    return queries.select("qid", said.alias("warning")).filter("warning is not null")


def _fits(corpus: Corpus) -> Column:
    return F.lit(True) if corpus.dimension is None else F.size("query_vector") == corpus.dimension


def search(corpus: Corpus, queries: DataFrame, f: Filters | None = None, limit: int = 10, origin: str = "https://example.org", rerank_scores: DataFrame | None = None, fingerprint: str | None = None) -> DataFrame:
    """queries (qid, query, query_vector nullable): qid, rank, source_id, route, kind, scores, version.
    Ranked queries know the operators of ``grammar``; those that cannot be parsed have no rows
    (``query_errors``). Filters go before scoring on both branches; limits are cut before rows that fail
    the check against the authoritative table are dropped, and ranks are then closed up. Whatever keeps
    a query's vector from being used costs it the dense branch only (``warnings``)."""
    f = f or Filters()
    live = resolve.active(corpus.sources, corpus.tombstones)
    routes = resolve.routed(queries, origin)
    found = resolve.exact(routes, live.filter(F.col("entity_type") == "issue").filter(predicate(f))).filter(F.col("source_id").isNotNull())
    exact = found.select("qid", "source_id", F.lit("exact").alias("kind"), F.lit(None).cast("long").alias("lexical_rank"), F.lit(None).cast("long").alias("dense_rank"), F.lit(None).cast("double").alias("fusion_score"), F.lit(1).cast("long").alias("rank"))
    ranked = routes.filter("route = 'ranked'").filter(grammar.query_error(F.col("query"), SEARCHED).isNull())
    may = allowed(live, f)
    hybrid = corpus.chunks is not None and corpus.dense_error(fingerprint) is None
    window = max(4 * limit, fusion.WINDOW, limit) if hybrid else limit
    parsed = written(grammar.nodes(ranked.select("qid", expanded_query(F.col("query")).alias("query")), F.col("query"), SEARCHED), "parsed")
    lex = grammar.best(corpus.index, parsed, window, allowed=may, fields=SEARCHED)
    if hybrid:
        near = dense.nearest(ranked.filter(F.col("query_vector").isNotNull() & _fits(corpus)).select("qid", "query_vector"), corpus.chunks, fusion.WINDOW, allowed=may)
    else:
        near = lex.limit(0)
    fused = fusion.fuse(lex, near, limit).withColumn("kind", fusion.ranking_kind(F.col("dense_rank"))).select(*exact.columns)
    shown = ("version", "body", *(c for c in ("entity_type", "state", "labels", "repo", "author", "issue_number") if c in live.columns))
    hits = exact.union(fused).join(live.select("source_id", *shown), "source_id")
    checked = hits.filter(predicate(f))
    if rerank_scores is not None:
        checked = fusion.rerank(checked, rerank_scores)
    closed = Window.partitionBy("qid").orderBy("rank", "source_id")
    out = checked.withColumn("rank", F.row_number().over(closed).cast("long"))
    out = out.withColumn("final_score", F.when(F.col("kind") == "hybrid", 1 / F.col("rank")))
    if corpus.evidence is not None:
        best = resolve.evidence(out.join(queries.select("qid", "query"), "qid").select("qid", "query", "source_id", "body", "version"), corpus.evidence).select("qid", "source_id", "chunk_index", "matched", "snippet")
        out = out.join(best, ["qid", "source_id"], "left")
    return out.drop("body")


def envelope(results: DataFrame, warnings: Column | None = None, version: str = "skein.v1") -> DataFrame:
    """A JSON text per query: schema_version, ok, data, warnings, meta."""
    row = F.struct(*(c for c in results.columns if c != "qid"))
    data = F.array_sort(F.collect_list(row), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))
    said = F.array().cast("array<string>") if warnings is None else warnings
    whole = F.struct(F.lit(version).alias("schema_version"), F.lit(True).alias("ok"), data.alias("data"), said.alias("warnings"), F.struct(F.count("*").alias("results")).alias("meta"))
    return results.groupBy("qid").agg(F.to_json(whole).alias("json"))


def query_log(results: DataFrame, queries: DataFrame) -> DataFrame:
    """What may be kept of queries: digests, ids, ranks; never their text."""
    return results.join(queries.select("qid", F.sha2("query", 256).alias("query_hash")), "qid").select("query_hash", "source_id", "rank", "kind")
