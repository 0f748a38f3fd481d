"""Shapes, scopes, profiles and seams: what a caller hands over and gets back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import times, vectors
from skein.operators import decisions, filters, fusion, models
from skein.plans import search
from skein.plans.contracts import ENVELOPE, QUERY, schema_error
from skein.plans.publish import Generations
from skein.plans.storage import new_folder
from skein.sources import records
from skein.suite.base import bm25_sql, lexical_hits, query, t, top_sql


@query(f"""{bm25_sql()}, top as {top_sql(10)} select qid, to_json({{'schema_version': 'skein.v1', 'ok': true, 'data': list({{'source_id': source_id, 'rank': rank}} order by rank), 'warnings': [], 'meta': {{'results': count(*)}}}})::varchar as json from top group by qid""")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's results as one JSON text of a stated shape."""
    return search.envelope(lexical_hits(spark, sf_dir, 10).select("qid", "source_id", "rank"))


@query(f"""{bm25_sql()}, top as {top_sql(5)} select sha256(b.text) as query_hash, source_id, rank, 'bm25' as kind from top join benchmark b on b.item_id = qid""")
def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be kept of queries holds no word of them."""
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.query_log(lexical_hits(spark, sf_dir, 5).withColumn("kind", fusion.ranking_kind(F.lit(None))), asked)


@query("select item_id, 'query: ' || text as said, replace(text || ' --flag', '--', ' ') as plain from benchmark")
def query_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder gets of a query, and the query without option-like dashes."""
    b = t(spark, sf_dir, "benchmark")
    return b.select("item_id", models.query_input(F.col("text")).alias("said"), X.normalised_query(F.concat("text", F.lit(" --flag"))).alias("plain"))


@query("select event_id, epoch_us(case when event_id % 3 = 0 then ts - interval 1 day else ts - interval 360 days end)::bigint as floor_us from events")
def bootstrap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run fixes how far back a history goes; later runs keep it."""
    ts = F.col("ts").cast("timestamp")
    existing = F.when(F.col("event_id") % 3 == 0, ts - F.expr("interval 1 day"))
    return t(spark, sf_dir, "events").select("event_id", F.unix_micros(times.bootstrap_floor(existing, ts)).alias("floor_us"))


@query("""select a.doc_id, a.lang is not distinct from b.lang and nullif(a.source, 'src3') is not distinct from nullif(b.source, 'src3') as same from documents a join documents b on b.doc_id = a.doc_id + 1""")
def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints are equal in every field or not at all; two missing values are equal."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.struct("lang", F.nullif("source", F.lit("src3")).alias("source")).alias("print"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("print").alias("next"))
    return d.join(after, "doc_id").select("doc_id", decisions.same_fingerprint(F.col("print"), F.col("next"), ("lang", "source")).alias("same"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sources: the first of a conversation is an issue, later ones are comments."""
    c, first = t(spark, sf_dir, "conversations"), F.col("turn") == 0
    parent = c.filter("turn = 0").select("conv_id", F.col("text").alias("parent"))
    return c.join(parent, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.when(first, "issue").otherwise("issue_comment").alias("entity_type"), F.concat(F.lit("org/r"), (F.col("conv_id") % 5).cast("string")).alias("repo"),
        F.col("conv_id").alias("issue_number"), F.when(first, "open").alias("state"), F.when(first, F.array("role", F.lit("all"))).alias("labels"), F.col("role").alias("author"), F.when(first, F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("body"), F.when(~first, F.col("parent")).alias("parent_issue_title"),
    )


@query("select 'comments' as f, conv_id * 1000 + turn as source_id from conversations where turn > 0 and role = 'user' union all select 'issues', conv_id * 1000 + turn from conversations where turn = 0 union all select 'both', conv_id * 1000 + turn from conversations where conv_id % 5 = 2")
def source_type_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by source type, beside others; both types are no filter, none match nothing."""
    some = _threads(spark, sf_dir)
    made = {"comments": filters.Filters(source_types=("issue_comment",), author="user"), "issues": filters.Filters(source_types=("issue",)), "both": filters.Filters(source_types=("issue", "issue_comment"), repo="org/r2"), "none": filters.Filters(source_types=())}
    out = None
    for name, f in made.items():
        own = filters.allowed(some, f).select(F.lit(name).alias("f"), "source_id")
        out = own if out is None else out.unionByName(own)
    return out


@query("""select conv_id * 1000 + turn as source_id, case when turn = 0 then split_part(text, chr(10), 1) else '' end as title, text as body, case when turn = 0 then role || ' all' end as labels, 'org/r' || (conv_id % 5) as repo, conv_id::varchar as issue_number,
    case when turn = 0 then '' else (select text from conversations p where p.conv_id = c.conv_id and p.turn = 0) end as parent_title from conversations c""")
def indexed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a source is indexed by."""
    made = search.index_fields()
    return _threads(spark, sf_dir).select("source_id", *(made[k].alias(k) for k in search.FIELDS))


@query("""with p as (select distinct source as repo, 'h' || (substr(source, 4)::int % 3) || '.example' as host from documents), r as (select doc_id, 'H' || (doc_id % 3) || '.Example' as host, case when doc_id % 5 > 0 then source end as repo from documents),
    j as (select r.doc_id, count(p.repo) as n, min(p.repo) as name from r left join p on p.host = lower(r.host) and (r.repo is null or r.repo = p.repo) group by r.doc_id)
    select doc_id, case when n = 1 then name end as profile, case when n = 0 then 'profile.not_found' when n > 1 then 'profile.ambiguous' end as error from j""")
def profile_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only profile of a host that lists the repository; none or several are errors."""
    d = t(spark, sf_dir, "documents")
    host = lambda k: F.concat(F.lit("h"), k.cast("string"), F.lit(".example"))
    profiles = d.select("source").distinct().select(F.col("source").alias("name"), host(F.substring("source", 4, 9).cast("int") % 3).alias("host"), F.array("source").alias("repos"))
    asked = d.select("doc_id", F.initcap(host(F.col("doc_id") % 3)).alias("host"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("repo"))
    return records.matched_profiles(asked, profiles, "doc_id").select("doc_id", "profile", "error")


@query("select c.conv_id, c.turn, case when p.conv_id % 7 = 0 then 'pull_request' when p.conv_id % 5 > 0 then 'issue' else 'unknown' end as parent from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = 0 and p.role = 'user' where c.turn > 0")
def parent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parents of waiting comments turn out to be."""
    c = t(spark, sf_dir, "conversations")
    i = F.col("conv_id")
    found = c.filter("turn = 0 and role = 'user'").select(i, F.when(i % 7 == 0, "url").alias("pull_request"), F.when((i % 5 > 0) | (i % 7 == 0), i).alias("number"))
    waiting = c.filter("turn > 0").select("conv_id", "turn").join(found, "conv_id", "left")
    return waiting.select("conv_id", "turn", records.parent_class(waiting).alias("parent"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), w as (select vec_id, a, list_concat([a[1] * (1 + (vec_id % 4) / 50.0::double)], a[2:]) as b from v)
    select vec_id, len(a)::bigint as dimension, list_cosine_similarity(a, b) >= 0.99999::double as agree from w""")
def vector_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the stated dimension, and whether two encodings of a text agree: the second has a first component
    that is up to six hundredths larger."""
    a = vectors.checked(F.col("embedding"), 64)
    other = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i == 0, x * (1 + (F.col("vec_id") % 4) / 50)).otherwise(x))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.size(a).cast("long").alias("dimension"), vectors.comparable(F.col("embedding"), other).alias("agree"))


@query("""with s as (select vec_id // 8 as g, list(list_transform(embedding, lambda x: x::double) order by vec_id) filter (vec_id % 8 = 7 or vec_id % 3 > 0) as inside from embeddings group by 1),
    n as (select g, inside, len(inside) as k from s where len(inside) > 0)
    select g, i::bigint as i, round(inside[1][i], 6) as cls, round(list_avg(list_transform(inside, lambda v: v[i])), 6) as mean, round(inside[k][i], 6) as last from n, range(1, 65) r(i)""")
def pooled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight neighbouring vectors as one text's token states, some of them masked: three ways to pool."""
    e = t(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    row = F.struct(i, F.col("embedding").cast("array<double>").alias("v"), ((i % 8 == 7) | (i % 3 > 0)).alias("in"))
    states = e.groupBy(F.floor(i / 8).alias("g")).agg(F.array_sort(F.collect_list(row)).alias("s")).filter(F.exists("s", lambda x: x["in"]))  # eight at most
    s, mask = F.transform("s", lambda x: x["v"]), F.transform("s", lambda x: x["in"])
    each = states.select("g", *(vectors.pooled(s, mask, k).alias(k) for k in ("cls", "mean", "last")))
    flat = each.select("g", F.posexplode(F.arrays_zip("cls", "mean", "last")).alias("i", "x"))
    return flat.select("g", (F.col("i") + 1).cast("long").alias("i"), *(F.round(F.col("x")[k], 6).alias(k) for k in ("cls", "mean", "last")))


@query(f"""{bm25_sql()}, top as {top_sql(30)}, s as (select qid, source_id, rank, (source_id * 7 + qid) % 11 as v, rank <= 20 as head, bool_or(rank = 3 and qid % 4 = 0) over (partition by qid) as spoilt from top)
    select qid, source_id, rank as pre_rerank_rank, row_number() over (partition by qid order by case when head then 0 else 1 end, case when head and not spoilt then -v else rank end, rank) as rank from s""")
def rerank_not_a_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score that is no number, and a query's order stays as it was; the others are reordered in their heads."""
    hits = lexical_hits(spark, sf_dir, 30)
    value = ((F.col("source_id") * 7 + F.col("qid")) % 11).cast("double")
    given = hits.select("qid", "source_id", F.when((F.col("rank") == 3) & (F.col("qid") % 4 == 0), F.lit(float("nan"))).otherwise(value).alias("rerank_score"))
    return fusion.rerank(hits, given, 20).select("qid", "source_id", F.col("pre_rerank_rank"), "rank")


@query("select doc_id, coalesce(case when doc_id % 4 = 0 then source end, case when doc_id % 3 = 0 then 'policy' end, 'default') as scope, coalesce(case when doc_id % 5 = 0 then 'open' end, lang) as state from documents")
def effective_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An argument goes before the policy, and that before the default."""
    i = F.col("doc_id")
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", filters.effective(F.when(i % 4 == 0, F.col("source")), F.when(i % 3 == 0, "policy"), F.lit("default")).alias("scope"), filters.effective(F.when(i % 5 == 0, "open"), F.col("lang")).alias("state"))


@query("select source, count(*) as n, true as intact, 'ready' as state from documents group by source")
def sealed_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build is reserved, written, sealed by its contents, and read under its final name."""
    made = Generations(spark, new_folder(spark, "generations"))
    build = made.reserve("2024-01-01T00:00:00Z")
    t(spark, sf_dir, "documents").select("doc_id", "source").write.parquet(f"{made.path(build)}/rows")
    ready = made.seal(build, "2024-01-01T00:01:00Z")
    held = made.manifest(ready.generation)
    whole = made.intact(ready.generation) and made.damaged(ready.generation).count() == 0
    return spark.read.parquet(f"{made.path(held)}/rows").groupBy("source").agg(F.count("*").alias("n"), F.lit(whole).alias("intact"), F.lit(held.state).alias("state"))


@query("select source, lang, sum(doc_id % 3)::bigint as purged_sources, sum(doc_id % 2)::bigint as purged_issues, coalesce(sum(case when doc_id % 4 = 0 then 1 end), 0)::bigint as purged_comments from documents group by source, lang")
def purge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's purges removed, by repository."""
    i = F.col("doc_id")
    d = t(spark, sf_dir, "documents").select("source", "lang", (i % 3).alias("purged_sources"), (i % 2).alias("purged_issues"), F.when(i % 4 == 0, 1).alias("purged_comments"))
    return decisions.purge_totals(d, "source", "lang")


@query("select conv_id * 100 + turn as chunk_id, 64::bigint as dimension from conversations")
def activated_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a generation become active once it holds every chunk's."""
    c = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.sha2("text", 256).alias("context_hash"), F.col("text").alias("body"))
    first = models.staged(c, c.filter("chunk_id % 2 = 0"), models.HashingEncoder())
    rest = models.staged(c, c.filter("chunk_id % 2 = 1"), models.HashingEncoder())
    return models.activated(c, first.unionByName(rest)).select("chunk_id", F.size("vector").cast("long").alias("dimension"))


@query("select qid, null::varchar as error from (select distinct item_id as qid from benchmark)")
def envelope_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every envelope is as its schema says."""
    made = search.envelope(lexical_hits(spark, sf_dir, 10).select("qid", "source_id", "rank"))
    return made.select("qid", schema_error(F.col("json"), ENVELOPE).alias("error"))


@query("""select event_id, case when event_id % 13 = 0 then '$: json' when event_id % 11 = 0 then '$: type' when event_id % 7 = 0 then '$.query: required' when event_id % 5 = 0 then '$.odd: additionalProperties' when event_id % 8 = 4 then '$.repo: dependentRequired'
    when event_id % 9 = 3 then '$.query: minLength' when user_id % 120 = 0 then '$.limit: minimum' when user_id % 120 > 100 then '$.limit: maximum' when event_type not in ('click', 'view') then '$.state: enum' when event_id % 17 = 2 then '$.label: anyOf' end as error from events""")
def query_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed decode of what callers ask with, one in many broken in a way of its own: the path of the first fault."""
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    state = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "all").otherwise(F.col("event_type"))
    label = F.when(i % 17 == 2, F.array(F.lit("a"), F.lit("a"))).when(i % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    asked = F.struct(
        F.when(i % 7 != 0, F.when(i % 9 == 3, "").otherwise(F.col("event_type"))).alias("query"), (F.col("user_id") % 120).alias("limit"), state.alias("state"), label.alias("label"), F.when(i % 5 == 0, 1).alias("odd"), F.when(i % 8 == 4, 2).alias("issue"),
    )
    text = F.when(i % 13 == 0, "{").when(i % 11 == 0, "[]").otherwise(F.to_json(asked))
    return e.select("event_id", schema_error(text, QUERY).alias("error"))
