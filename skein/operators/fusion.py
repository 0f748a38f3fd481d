"""Rank fusion of a lexical and a dense branch, and reranking of a bounded head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fusion constant, lexical and dense weights, protected head, dense window, rerank head.
K, LEXICAL_WEIGHT, DENSE_WEIGHT, HEAD, WINDOW, RERANK_HEAD = 60, 2.0, 1.0, 5, 80, 10


def candidate_window(limit: Column) -> Column:
    return F.greatest(4 * limit, F.lit(WINDOW), limit)


def branch(hits: DataFrame, rank: str) -> DataFrame:
    """(qid, source_id, rank): a repeated source keeps its best rank; ranks are not closed up."""
    return hits.groupBy("qid", "source_id").agg(F.min("rank").alias(rank))


def joined(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    return branch(lexical, "lexical_rank").join(branch(dense, "dense_rank"), ["qid", "source_id"], "full")


def rrf(lexical_rank: Column, dense_rank: Column, k: Column | float = K, lexical: Column | float = LEXICAL_WEIGHT, dense: Column | float = DENSE_WEIGHT) -> Column:
    """Weighted reciprocal ranks; a missing branch adds nothing."""
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))
    return part(lexical, lexical_rank) + part(dense, dense_rank)


def fuse(lexical: DataFrame, dense: DataFrame, limit: int, k: float = K, weights: tuple[float, float] = (LEXICAL_WEIGHT, DENSE_WEIGHT), protect: int = HEAD, window: int = WINDOW) -> DataFrame:
    """qid, source_id, lexical_rank, dense_rank, fusion_score, rank, final_score. The first ``protect``
    lexical ranks keep their order at the head; the rest go by score, best branch rank, source_id.
    Dense ranks beyond ``window`` do not count. A limit of 0 gives no rows."""
    dense = dense.filter(F.col("rank") <= window)
    score = F.round(rrf(F.col("lexical_rank"), F.col("dense_rank"), k, *weights), 9)
    head = F.when(F.col("lexical_rank") <= protect, F.col("lexical_rank")).otherwise(protect + 1)
    best = F.least("lexical_rank", "dense_rank")
    w = Window.partitionBy("qid").orderBy(head, F.col("fusion_score").desc(), best, "source_id")
    out = joined(lexical, dense).withColumn("fusion_score", score).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    return out.withColumn("final_score", 1 / F.col("rank"))


def grid(lexical: DataFrame, dense: DataFrame, cells: DataFrame) -> DataFrame:
    """Equal or weighted fusion for every cell (k, window, dense_weight) of a small parameter table:
    cell columns, qid, source_id, fusion_score, rank."""
    both = joined(lexical, dense).join(F.broadcast(cells), (F.col("lexical_rank") <= F.col("window")) | (F.col("dense_rank") <= F.col("window")))
    inside = lambda r: F.when(F.col(r) <= F.col("window"), F.col(r))
    score = F.round(rrf(inside("lexical_rank"), inside("dense_rank"), F.col("k"), 1.0, F.col("dense_weight")), 9)
    w = Window.partitionBy("k", "window", "dense_weight", "qid").orderBy(F.col("fusion_score").desc(), F.least(inside("lexical_rank"), inside("dense_rank")), "source_id")
    return both.withColumn("fusion_score", score).withColumn("rank", F.row_number().over(w).cast("long"))


def screened(lexical: DataFrame, dense: DataFrame, depth: int = 20, k: float = K) -> DataFrame:
    """Equal fusion of the two heads of ``depth`` rows; ties go to what was seen first, lexical rows before
    dense ones: qid, source_id, rank, ``depth`` at most."""
    both = joined(lexical, dense).filter((F.col("lexical_rank") <= depth) | (F.col("dense_rank") <= depth))
    score = F.round(rrf(F.col("lexical_rank"), F.col("dense_rank"), k, 1.0, 1.0), 9)
    w = Window.partitionBy("qid").orderBy(score.desc(), F.col("lexical_rank").isNull(), F.coalesce("lexical_rank", "dense_rank"), "source_id")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= depth).select("qid", "source_id", "rank")


def ranking_kind(dense_rank: Column) -> Column:
    """Fused rows that no vector contributed to are lexical ones."""
    return F.when(dense_rank.isNull(), "bm25").otherwise("hybrid")


def rerank(ranked: DataFrame, scores: DataFrame, head: int = RERANK_HEAD) -> DataFrame:
    """Reorder each query's first ``head`` rows by ``rerank_score`` of ``scores`` (qid, source_id,
    rerank_score), old rank breaking ties; the tail stays. If a head row has no finite score the whole
    query stays as it was. Adds rerank_score, pre_rerank_rank."""
    joined_ = ranked.join(scores, ["qid", "source_id"], "left")
    q = Window.partitionBy("qid")
    in_head = F.col("rank") <= head
    value = F.col("rerank_score")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    whole = F.min(F.when(in_head, usable.cast("int"))).over(q) == 1
    order = q.orderBy(F.when(in_head, 0).otherwise(1), F.when(in_head & F.col("skein_whole"), -value).otherwise(F.col("rank")), "rank")
    out = joined_.withColumn("skein_whole", whole).withColumn("pre_rerank_rank", F.col("rank"))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).drop("skein_whole")


def pool_reranked(pools: DataFrame, chunk_scores: DataFrame) -> DataFrame:
    """Reorder each branch of a rerank pool (branch, qid, source_id, rank) by the best chunk score of a
    source (qid, source_id, score)."""
    best = chunk_scores.groupBy("qid", "source_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("branch", "qid").orderBy(F.col("score").desc_nulls_last(), "rank", "source_id")
    return pools.join(best, ["qid", "source_id"], "left").withColumn("pool_rank", F.row_number().over(w).cast("long"))
