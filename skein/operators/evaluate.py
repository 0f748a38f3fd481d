"""Retrieval quality: per-query metrics, their aggregates, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.storage import written

#: Class weights of the combined score.
CLASS_WEIGHTS = {"english_semantic": 0.5, "korean_semantic": 0.2, "ko_query_en_source": 0.15, "en_query_ko_source": 0.1, "comment_only": 0.025, "long_context": 0.025}


def query_metrics(rankings: DataFrame, gold: DataFrame, recalls: tuple[int, ...] = (5, 10, 20), depth: int = 10, relevant: DataFrame | None = None) -> DataFrame:
    """rankings (qid, source_id, rank), gold (qid, source_id, grade): for each query with gold
    ndcg, mrr (to ``depth``) and recall_k. Gain 2^grade - 1, discount log2(rank + 1). ``gold`` may hold
    only what is ranked or among the first ``depth`` by grade if ``relevant`` (qid, n) counts all of it."""
    hit = gold.join(rankings, ["qid", "source_id"], "left")
    if relevant is not None:
        hit = hit.join(relevant.select("qid", F.col("n").alias("skein_n")), "qid")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    place = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "source_id")
    hit = hit.withColumn("ideal_rank", F.row_number().over(place))
    dcg = F.sum(F.when(F.col("rank") <= depth, gain / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.sum(F.when(F.col("ideal_rank") <= depth, gain / F.log2(F.col("ideal_rank") + 1)).otherwise(0.0))
    first = F.min(F.when(F.col("rank") <= depth, F.col("rank")))
    all_gold = F.count("*") if relevant is None else F.max("skein_n")
    cuts = [(F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))) / all_gold).alias(f"recall_{k}") for k in recalls]
    return hit.groupBy("qid").agg(F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"), *cuts)


def by_class(metrics: DataFrame, classes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return metrics.join(classes, "qid").groupBy("class").agg(*(F.avg(n).alias(n) for n in names))


def class_weighted(means: DataFrame, weights: DataFrame, metric: str) -> DataFrame:
    """One row: the class means' weighted sum. weights (class, weight)."""
    return means.join(F.broadcast(weights), "class").agg(F.sum(F.col(metric) * F.col("weight")).alias(metric))


def rescue_harm(base: DataFrame, other: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: rescued and harmed queries, those that gain or lose all gold among the first k."""
    hits = lambda r, name: gold.filter("grade > 0").join(r.filter(F.col("rank") <= k), ["qid", "source_id"], "left").groupBy("qid").agg(F.bool_or(F.col("rank").isNotNull()).alias(name))
    both = hits(base, "before").join(hits(other, "after"), "qid")
    return both.agg(F.count_if(~F.col("before") & F.col("after")).alias("rescued"), F.count_if(F.col("before") & ~F.col("after")).alias("harmed"))


def exact_top1(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    top = rankings.filter("rank = 1").join(gold.select("qid", "source_id", F.lit(1.0).alias("hit")), ["qid", "source_id"], "left")
    queries = gold.select("qid").distinct().join(top.select("qid", "hit"), "qid", "left")
    return queries.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("exact_top1"))


def gold_hit(rankings: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: the share of queries with gold of a positive grade that have some of it among the first k;
    0 without any."""
    wanted = gold.filter("grade > 0").select("qid", "source_id").distinct()
    hit = wanted.join(rankings.filter(F.col("rank") <= k).select("qid", "source_id", F.lit(1.0).alias("hit")), ["qid", "source_id"], "left").groupBy("qid").agg(F.coalesce(F.max("hit"), F.lit(0.0)).alias("hit"))
    return hit.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias(f"hit_{k}"))


def nearest_rank(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Percentiles that are values of the data: sorted[ceil(p n) - 1]. Distinct values are counted and
    dealt by range; running counts are taken inside the ranges and start from the ranges' totals, so no
    task goes over all values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "counts")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # a row per range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(value))
    seen = ranged.join(before, "part").withColumn("upto", upto)
    return seen.agg(*(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1.0), F.ceil(F.col("all") * p)), F.col(value))).alias(f"p{round(100 * p)}") for p in shares))


def duplicate_crowding(rankings: DataFrame, key: Column, depth: int = 10) -> DataFrame:
    """qid, repeated: rows among the first ``depth`` that repeat another's key."""
    return rankings.filter(F.col("rank") <= depth).groupBy("qid").agg((F.count("*") - F.count_distinct(key)).alias("repeated"))


def failed_gates(row: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``failed``: the names of the gates whose condition does not hold (or is null), in their order."""
    return row.withColumn("failed", F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()))))


def select_weight(cells: DataFrame) -> DataFrame:
    """The best cell: net rescues, fewer harms, cross-language recall, weighted gain, smaller weight."""
    return cells.withColumn("net", F.col("rescued") - F.col("harmed")).orderBy(F.desc("net"), F.asc("harmed"), F.desc("cross_recall"), F.desc("ndcg"), F.asc("dense_weight")).limit(1)


def select_model(models: DataFrame) -> DataFrame:
    """Among models that rescue more than they harm: net, rescues, fewer harms, smaller snapshot, name."""
    return models.filter("rescued > harmed").withColumn("net", F.col("rescued") - F.col("harmed")).orderBy(F.desc("net"), F.desc("rescued"), F.asc("harmed"), "snapshot_bytes", "name").limit(1)


def select_cell(cells: DataFrame) -> DataFrame:
    """The best cell of a grid of dimensions and weights: as ``select_weight``, but a smaller dimension goes
    before a smaller weight."""
    return cells.withColumn("net", F.col("rescued") - F.col("harmed")).orderBy(F.desc("net"), F.asc("harmed"), F.desc("cross_recall"), F.desc("ndcg"), F.asc("dimension"), F.asc("dense_weight")).limit(1)


def profile_blockers(base: Column, other: Column) -> Column:
    """Why another lexical profile (struct ndcg, exact_top1, violations, round_trip, stale, comment: array of
    metrics, failures: array of names) does not take the base's place; empty if it does. It must do
    better, and nothing may be worse or below its mark."""
    worse = F.exists(F.arrays_zip(base["comment"].alias("b"), other["comment"].alias("o")), lambda m: m["o"] < m["b"])
    rules = {
        "ndcg_not_better": other["ndcg"] <= base["ndcg"],
        "exact_worse": (other["exact_top1"] < base["exact_top1"]) | (other["exact_top1"] < 0.95),
        "filter_violations": (other["violations"] > base["violations"]) | (other["violations"] != 0),
        "round_trip_worse": (other["round_trip"] < base["round_trip"]) | (other["round_trip"] < 1.0),
        "stale_results": (other["stale"] > base["stale"]) | (other["stale"] != 0),
        "comments_worse": worse,
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return F.concat(named, F.transform(other["failures"], lambda f: F.concat(F.lit("gate:"), f)))


def quality_gates() -> dict[str, Column]:
    """Gate -> condition over exact_top1, comment_hit_5, recall_5 (map of class), violations, round_trip."""
    least = {"english_semantic": 0.75, "korean_semantic": 0.65, "ko_query_en_source": 0.60, "en_query_ko_source": 0.60}
    recall = {f"recall_{k}": F.coalesce(F.element_at("recall_5", F.lit(k)), F.lit(0.0)) >= v for k, v in least.items()}
    return {"exact_top1": F.col("exact_top1") >= 0.95} | recall | {"violations": F.col("violations") == 0, "round_trip": F.col("round_trip") >= 1.0}


def select_tier(models: DataFrame, slack: float, smallest: bool) -> DataFrame:
    """Of models without failed gates, within ``slack`` of the best gain: the smallest snapshot, or the
    best reciprocal rank and then the smallest."""
    clear = models.filter(F.size("failed") == 0)
    near = clear.crossJoin(clear.agg(F.max("ndcg").alias("best"))).filter(F.col("ndcg") >= F.col("best") - slack).drop("best")
    order = [F.asc("snapshot_bytes")] if smallest else [F.desc("mrr"), F.asc("snapshot_bytes")]
    return near.orderBy(*order, "name").limit(1)


def leaked_threads(first: DataFrame, second: DataFrame) -> DataFrame:
    """Threads (thread_id) whose sources are gold in both splits: none may be."""
    return first.select("thread_id").distinct().join(second.select("thread_id").distinct(), "thread_id", "left_semi")


def check_qrels(qrels: DataFrame) -> DataFrame:
    """(problem, n): broken rules of relevance judgments (query_id, query, class, adjudicators array,
    relevant array<struct<source_id, grade>>)."""
    negative = F.col("class") == "negative"
    rules = {
        "blank_query": F.trim("query") == "",
        "too_few_adjudicators": F.size(F.array_distinct("adjudicators")) < 2,
        "bad_grade": F.exists("relevant", lambda r: ~r["grade"].between(1, 3)),
        "negative_with_gold": negative & (F.size("relevant") > 0),
        "no_gold": ~negative & (F.size("relevant") == 0),
    }
    marked = qrels.withColumn("repeated", F.count("*").over(Window.partitionBy("query_id")) > 1)
    names = F.array(*(F.when(c, F.lit(n)) for n, c in ({"repeated_id": F.col("repeated")} | rules).items()))
    return marked.select(F.explode(F.array_compact(names)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
