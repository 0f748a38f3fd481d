"""Retrieval quality. Relevance: a vector's neighbours with its own label; base and other rankings are
the two branches of the fusion queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import decisions, evaluate, fusion
from skein.suite.base import query, t
from skein.suite.retrieval import _BRANCHES, EVERY, _branches, _first

_GOLD = f"""gold as (select q.vec_id as qid, c.vec_id as source_id, 1 + c.vec_id % 3 as grade from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0)"""
_METRICS = f"""{_BRANCHES}, {_GOLD},
    h as (select g.*, lr as rank, row_number() over (partition by g.qid order by grade desc, g.source_id) as ideal_rank from gold g left join lex using (qid, source_id)),
    metrics as (select qid, case when sum(case when ideal_rank <= 10 then (2 ** grade - 1) / log2(ideal_rank + 1) else 0 end) > 0 then sum(case when rank <= 10 then (2 ** grade - 1) / log2(rank + 1) else 0 end) / sum(case when ideal_rank <= 10 then (2 ** grade - 1) / log2(ideal_rank + 1) else 0 end) else 0 end as ndcg,
        coalesce(1::double / min(case when rank <= 10 then rank end), 0::double) as mrr, count(*) filter (rank <= 5)::double / count(*) as recall_5, count(*) filter (rank <= 10)::double / count(*) as recall_10, count(*) filter (rank <= 20)::double / count(*) as recall_20 from h group by qid),
    classes as (select vec_id as qid, 'class' || (label % 4) as class from embeddings where vec_id % {EVERY} = 0)"""


def _gold(spark: SparkSession, sf_dir: str, *rankings: DataFrame, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """All vectors of a query's label are gold, but their pairs are not made: the gold that is ranked or
    among the first ``depth`` by grade, and (qid, n), how much there is in all."""
    e = t(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "label")
    c = e.select(F.col("vec_id").alias("source_id"), "label", (1 + F.col("vec_id") % 3).alias("grade"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.col("grade").desc(), "source_id"))
    first = c.withColumn("place", place).filter(F.col("place") <= depth + 1).drop("place")  # one may be the query
    ranked = reduce(DataFrame.union, (r.select("qid", "source_id") for r in rankings)).join(q, "qid").join(c, ["source_id", "label"])
    columns = ("qid", "source_id", "grade")
    gold = q.join(first, "label").select(*columns).union(ranked.select(*columns)).filter("qid != source_id").distinct()
    return gold, q.join(c.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").select("qid", "n")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = _first(spark, sf_dir)
    gold, relevant = _gold(spark, sf_dir, ranking)
    return evaluate.query_metrics(ranking, gold, relevant=relevant)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.concat(F.lit("class"), (F.col("label") % 4).cast("string")).alias("class"))


_NAMES = ("ndcg", "mrr", "recall_5", "recall_10", "recall_20")
_ROUND = ", ".join(f"round({n}, 6) as {n}" for n in _NAMES)


@query(f"{_METRICS} select qid, {_ROUND} from metrics")
def ndcg_mrr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("qid", *(F.round(n, 6).alias(n) for n in _NAMES))


@query(f"{_METRICS} select class, {', '.join(f'round(avg({n}), 6) as {n}' for n in _NAMES)} from metrics join classes using (qid) group by class")
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluate.by_class(_metrics(spark, sf_dir), _classes(spark, sf_dir), _NAMES)
    return means.select("class", *(F.round(n, 6).alias(n) for n in _NAMES))


@query(f"{_METRICS}, m as (select class, avg(ndcg) as ndcg from metrics join classes using (qid) group by class) select round(sum(ndcg * (case class when 'class0' then 0.5::double when 'class1' then 0.2::double when 'class2' then 0.15::double else 0.15::double end)), 6) as ndcg from m")
def class_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluate.by_class(_metrics(spark, sf_dir), _classes(spark, sf_dir), ("ndcg",))
    weights = spark.createDataFrame([("class0", 0.5), ("class1", 0.2), ("class2", 0.15), ("class3", 0.15)], "class string, weight double")
    return evaluate.class_weighted(means, weights, "ndcg").select(F.round("ndcg", 6).alias("ndcg"))


@query(f"{_METRICS} select round(avg(recall_10), 6) as macro_recall, count(*) as queries from metrics")
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).agg(F.round(F.avg("recall_10"), 6).alias("macro_recall"), F.count("*").alias("queries"))


@query(f"""{_BRANCHES}, {_GOLD}, b as (select g.qid, bool_or(lr <= 5 and lr is not null) as before_ from gold g left join lex using (qid, source_id) group by g.qid), a as (select g.qid, bool_or(dr <= 5 and dr is not null) as after_ from gold g left join den using (qid, source_id) group by g.qid)
    select count(*) filter (not coalesce(before_, false) and coalesce(after_, false)) as rescued, count(*) filter (coalesce(before_, false) and not coalesce(after_, false)) as harmed from a join b using (qid)""")
def rescue_harm(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, other = _branches(spark, sf_dir)
    return evaluate.rescue_harm(base, other, _gold(spark, sf_dir, base, other)[0], 5)


@query(f"{_BRANCHES}, {_GOLD} select round(avg(case when h.qid is not null then 1::double else 0::double end), 6) as exact_top1 from (select distinct qid from gold) q left join (select distinct l.qid from lex l join gold g using (qid, source_id) where lr = 1) h on h.qid = q.qid")
def exact_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = _first(spark, sf_dir)
    return evaluate.exact_top1(ranking, _gold(spark, sf_dir, ranking)[0]).select(F.round("exact_top1", 6).alias("exact_top1"))


@query(f"{_BRANCHES}, {_GOLD} select round(avg(hit), 6) as hit_5 from (select g.qid, max(case when lr <= 5 then 1::double else 0::double end) as hit from gold g left join lex using (qid, source_id) where grade > 1 group by g.qid)")
def gold_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that have some of their better gold among the first five."""
    ranking = _first(spark, sf_dir)
    return evaluate.gold_hit(ranking, _gold(spark, sf_dir, ranking)[0].withColumn("grade", F.col("grade") - 1)).select(F.round("hit_5", 6).alias("hit_5"))


@query(f"{_BRANCHES} select q.vec_id as qid, count(l.source_id) as results, count(l.source_id) = 0 as empty from (select vec_id from embeddings where vec_id % {EVERY} = 0 and label % 4 = 3) q left join lex l on l.qid = q.vec_id and l.lr <= 10 group by q.vec_id")
def negative_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = t(spark, sf_dir, "embeddings").filter((F.col("vec_id") % EVERY == 0) & (F.col("label") % 4 == 3)).select(F.col("vec_id").alias("qid"))
    hits = _first(spark, sf_dir).filter("rank <= 10")
    return q.join(hits, "qid", "left").groupBy("qid").agg(F.count("source_id").alias("results")).withColumn("empty", F.col("results") == 0)


@query("""with o as (select n_chars, row_number() over (order by n_chars) as i, count(*) over () as n from documents) select min(n_chars) filter (i >= greatest(1, ceil(n * 0.5::double))) as p50, min(n_chars) filter (i >= greatest(1, ceil(n * 0.95::double))) as p95, min(n_chars) filter (i >= greatest(1, ceil(n * 0.99::double))) as p99 from o""")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(t(spark, sf_dir, "documents"), "n_chars", [0.5, 0.95, 0.99])


@query(f"{_BRANCHES} select count(*) as violations, count(distinct l.qid) as queries from lex l join embeddings q on q.vec_id = l.qid join embeddings c on c.vec_id = l.source_id where lr <= 10 and c.label % 2 <> q.label % 2")
def filter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    hits = _first(spark, sf_dir).filter("rank <= 10")
    both = hits.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(e.select(F.col("vec_id").alias("source_id"), F.col("label").alias("cl")), "source_id")
    return both.filter("cl % 2 != ql % 2").agg(F.count("*").alias("violations"), F.count_distinct("qid").alias("queries"))


@query(f"{_BRANCHES} select qid, count(*) - count(distinct c.label) as repeated from lex join embeddings c on c.vec_id = source_id where lr <= 10 group by qid")
def dup_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _first(spark, sf_dir).join(t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), "label"), "source_id")
    return evaluate.duplicate_crowding(hits, F.col("label"))


@query(f"{_BRANCHES} select min(n) as least, count(*) filter (n < 80) as short from (select qid, count(*) as n from lex group by qid)")
def branch_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _first(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.count_if(F.col("n") < fusion.WINDOW).alias("short"))


_CELLS = """cells as (select vec_id as cell, (vec_id * 7 % 11)::bigint as rescued, (vec_id * 5 % 7)::bigint as harmed, (vec_id % 13) / 13.0::double as cross_recall, (vec_id % 17) / 17.0::double as ndcg, (vec_id % 4 + 1) / 4.0::double as dense_weight, (vec_id % 19)::bigint as snapshot_bytes, 'm' || vec_id as name, (vec_id % 23) / 23.0::double as mrr, (64 * (1 + vec_id % 3))::bigint as dimension from embeddings)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return t(spark, sf_dir, "embeddings").select(
        v.alias("cell"), (v * 7 % 11).alias("rescued"), (v * 5 % 7).alias("harmed"), (v % 13 / 13.0).alias("cross_recall"), (v % 17 / 17.0).alias("ndcg"), ((v % 4 + 1) / 4.0).alias("dense_weight"),
        (v % 19).alias("snapshot_bytes"), F.concat(F.lit("m"), v.cast("string")).alias("name"), (v % 23 / 23.0).alias("mrr"), (64 * (1 + v % 3)).alias("dimension"),
    )


@query(f"with {_CELLS} select rescued - harmed as net, harmed, round(cross_recall, 6) as cross_recall, round(ndcg, 6) as ndcg, dense_weight from cells order by net desc, harmed, cross_recall desc, ndcg desc, dense_weight limit 1")
def select_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_weight(_cells(spark, sf_dir)).select("net", "harmed", F.round("cross_recall", 6).alias("cross_recall"), F.round("ndcg", 6).alias("ndcg"), "dense_weight")


@query(f"with {_CELLS} select name, rescued - harmed as net from cells where rescued > harmed order by net desc, rescued desc, harmed, snapshot_bytes, name limit 1")
def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_model(_cells(spark, sf_dir)).select("name", "net")


@query(f"with {_CELLS} select name, snapshot_bytes from cells where harmed <= 3 and ndcg >= (select max(ndcg) from cells where harmed <= 3) - 0.02::double order by snapshot_bytes, name limit 1")
def select_light_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluate.failed_gates(_cells(spark, sf_dir), {"harm": F.col("harmed") <= 3})
    return evaluate.select_tier(cells, 0.02, True).select("name", "snapshot_bytes")


@query(f"with {_CELLS} select name, snapshot_bytes from cells where harmed <= 3 and ndcg >= (select max(ndcg) from cells where harmed <= 3) - 0.005::double order by mrr desc, snapshot_bytes, name limit 1")
def select_quality_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluate.failed_gates(_cells(spark, sf_dir), {"harm": F.col("harmed") <= 3})
    return evaluate.select_tier(cells, 0.005, False).select("name", "snapshot_bytes")


@query(f"with {_CELLS} select dimension, dense_weight, rescued - harmed as net from cells order by net desc, harmed, cross_recall desc, ndcg desc, dimension, dense_weight limit 1")
def select_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_cell(_cells(spark, sf_dir)).select("dimension", "dense_weight", "net")


@query("""with r as (select page_id, page_id % 10 / 10.0::double as bn, page_id % 7 / 10.0::double as n, 0.9::double + page_id % 9 / 100.0::double as bt, 0.9::double + page_id % 8 / 100.0::double as t, page_id % 2 as v, case when page_id % 11 = 0 then 0.9::double else 1::double end as g, page_id % 3 % 2 as st, page_id % 5 / 5.0::double as bc, page_id % 4 / 5.0::double as c from pages)
    select page_id, concat_ws(',', case when n <= bn then 'ndcg_not_better' end, case when t < bt or t < 0.95::double then 'exact_worse' end, case when v <> 0 then 'filter_violations' end, case when g < 1 then 'round_trip_worse' end, case when st <> 0 then 'stale_results' end, case when c < bc then 'comments_worse' end, case when page_id % 13 = 0 then 'gate:x' end) as reasons from r""")
def profile_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, none = F.col("page_id"), F.array().cast("array<string>")
    side = lambda n, top, v, g, st, c, f: F.struct(n.alias("ndcg"), top.alias("exact_top1"), v.alias("violations"), g.alias("round_trip"), st.alias("stale"), F.array(F.lit(0.5), c).alias("comment"), f.alias("failures"))
    base = side(p % 10 / 10.0, 0.9 + p % 9 / 100.0, F.lit(0), F.lit(1.0), F.lit(0), p % 5 / 5.0, none)
    other = side(p % 7 / 10.0, 0.9 + p % 8 / 100.0, p % 2, F.when(p % 11 == 0, 0.9).otherwise(1.0), p % 3 % 2, p % 4 / 5.0, F.when(p % 13 == 0, F.array(F.lit("x"))).otherwise(none))
    made = t(spark, sf_dir, "pages").select("page_id", base.alias("base"), other.alias("other"))
    return made.select("page_id", F.array_join(evaluate.profile_blockers(F.col("base"), F.col("other")), ",").alias("reasons"))


@query("""select page_id, concat_ws(',', case when page_id % 20 < 3 then 'exact_top1' end, case when page_id % 5 = 0 then 'recall_english_semantic' end, case when page_id % 4 / 4.0 < 0.65 then 'recall_korean_semantic' end, 'recall_ko_query_en_source', case when page_id % 3 <> 2 then 'recall_en_query_ko_source' end, case when page_id % 2 = 1 then 'violations' end, case when page_id % 9 = 0 then 'round_trip' end) as failed from pages""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    recall = F.create_map(F.lit("english_semantic"), F.when(p % 5 == 0, 0.7).otherwise(0.75), F.lit("korean_semantic"), p % 4 / 4.0, F.lit("en_query_ko_source"), p % 3 / 3.0)
    rows = t(spark, sf_dir, "pages").select("page_id", F.when(p % 20 < 3, 0.94).otherwise(0.95).alias("exact_top1"), recall.alias("recall_5"), (p % 2).alias("violations"), F.when(p % 9 == 0, 0.99).otherwise(1.0).alias("round_trip"))
    return evaluate.failed_gates(rows, evaluate.quality_gates()).select("page_id", F.array_join("failed", ",").alias("failed"))


@query("select distinct conv_id as thread_id from conversations a where conv_id % 5 < 3 and turn % 2 = 0 and exists (select 1 from conversations b where b.conv_id = a.conv_id and b.conv_id % 5 >= 2 and turn % 3 = 1)")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "thread_id")
    return evaluate.leaked_threads(c.filter("thread_id % 5 < 3 and turn % 2 = 0"), c.filter("thread_id % 5 >= 2 and turn % 3 = 1"))


@query("""with r as (select page_id, page_id % 40 / 20.0::double as warm_p95, page_id % 90 / 15.0::double as cold_p95, (page_id * 13 % 1500)::double as rss, (page_id * 7 % 700)::double as snapshot, (page_id % 25)::double as chunks_per_s, page_id % 5::double as growth, page_id % 3 as fingerprints from pages)
    select page_id, concat_ws(',', case when not warm_p95 <= 1.5 then 'warm_p95' end, case when not cold_p95 <= 5 then 'cold_p95' end, case when not rss <= 1024 then 'rss' end, case when not chunks_per_s >= 10 then 'throughput' end, case when not fingerprints = 1 then 'one_chunker' end, case when not snapshot <= 500 then 'snapshot' end, case when not growth <= 3 then 'growth' end) as failed from r""")
def resource_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    rows = t(spark, sf_dir, "pages").select("page_id", (p % 40 / 20.0).alias("warm_p95"), (p % 90 / 15.0).alias("cold_p95"), (p * 13 % 1500).cast("double").alias("rss"), (p * 7 % 700).cast("double").alias("snapshot"), (p % 25).cast("double").alias("chunks_per_s"), (p % 5).cast("double").alias("growth"), (p % 3).alias("fingerprints"))
    return evaluate.failed_gates(rows, decisions.resource_gates("light")).select("page_id", F.array_join("failed", ",").alias("failed"))


@query("""with q as (select item_id % 30 as query_id, case when item_id % 11 = 0 then ' ' else text end as query, case when item_id % 7 = 0 then 'negative' else 'exact' end as class, item_id % 2 + 1 as n_adj, case when item_id % 5 = 0 then 0 else 1 end as n_rel, item_id % 5 as grade from benchmark),
    m as (select *, count(*) over (partition by query_id) > 1 as repeated from q)
    select problem, count(*) as n from (select unnest(list_filter([case when repeated then 'repeated_id' end, case when trim(query) = '' then 'blank_query' end, case when n_adj < 2 then 'too_few_adjudicators' end, case when n_rel > 0 and grade not between 1 and 3 then 'bad_grade' end, case when class = 'negative' and n_rel > 0 then 'negative_with_gold' end, case when class <> 'negative' and n_rel = 0 then 'no_gold' end], lambda x: x is not null)) as problem from m) group by problem""")
def qrels_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    adj = F.when(i % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    gold = F.array(F.struct(F.lit("s").alias("source_id"), (i % 5).alias("grade")))
    rows = t(spark, sf_dir, "benchmark").select((i % 30).alias("query_id"), F.when(i % 11 == 0, " ").otherwise(F.col("text")).alias("query"), F.when(i % 7 == 0, "negative").otherwise("exact").alias("class"), adj.alias("adjudicators"), F.when(i % 5 == 0, F.slice(gold, 1, 0)).otherwise(gold).alias("relevant"))
    return evaluate.check_qrels(rows)


@query("""with d as (select source as repo, count(*) as n, count(*) filter (sha256(text) = sha256(substr(text, 1))) as intact from documents group by source) select repo, n, n = intact as ok from d""")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body has its recorded digest, counted per repository."""
    docs = t(spark, sf_dir, "documents").select(F.col("source").alias("repo"), (F.sha2("text", 256) == F.sha2(F.substring("text", 1, 1 << 30), 256)).alias("same"))
    return docs.groupBy("repo").agg(F.count("*").alias("n"), F.bool_and("same").alias("ok"))
