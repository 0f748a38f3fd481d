"""Further operators: scopes, summaries, consistency, model seams, the whole search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators.grammar import plain
from skein.operators import chunks, decisions, filters, fusion, grammar, lexical, models, resolve
from skein.plans import search
from skein.plans.storage import new_folder, written
from skein.suite.base import bm25_sql, index_of, lexical_hits, query, t, top_sql
from skein.suite.retrieval import _BRANCHES, EVERY, _branches


@query("select item_id, coalesce(case when item_id % 3 = 0 then item_id + 1 end, case when item_id % 2 = 0 then 7 end, 10)::bigint as lim from benchmark")
def effective_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return t(spark, sf_dir, "benchmark").select("item_id", filters.effective_limit(F.when(i % 3 == 0, i + 1).cast("int"), F.when(i % 2 == 0, 7)).cast("long").alias("lim"))


@query("select doc_id, case when source not in ('src1', 'src2') then 'scope.not_allowed' end as error from documents")
def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", filters.scope_error(F.array(F.lit("src1"), F.lit("src2")), F.col("source")).alias("error"))


@query(f"""{bm25_sql()}, top as {top_sql(10)} select qid, count(*) filter (source_id % 9 <> 0 and source_id % 7 <> 0) as kept, count(*) filter (source_id % 9 = 0 or source_id % 7 = 0) as mismatched from top group by qid""")
def publication_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose source is gone (every ninth) or was changed since (every seventh) are dropped and counted."""
    s = F.col("doc_id")
    sources = t(spark, sf_dir, "documents").filter(s % 9 != 0).select(s.alias("source_id"), F.when(s % 7 == 0, 2).otherwise(1).alias("version"))
    checked = resolve.consistent(lexical_hits(spark, sf_dir, 10).withColumn("version", F.lit(1)), sources)
    return checked.groupBy("qid").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("mismatched"))


@query("select event_type as endpoint, count(*) as fetched, sum(case when user_id % 2 = 0 then 1 else 0 end)::bigint as updated, max(event_id) as last_run from events group by event_type")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page summaries merge by sums and the last run."""
    pages = t(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 10).alias("page")).agg(F.count("*").alias("fetched"), F.count_if(F.col("user_id") % 2 == 0).alias("updated"), F.max("event_id").alias("run"))
    return pages.groupBy(F.col("event_type").alias("endpoint")).agg(F.sum("fetched").alias("fetched"), F.sum("updated").alias("updated"), F.max_by("run", "run").alias("last_run"))


@query("select case when event_id % 4 = 0 then 'deferred' when event_id % 5 = 0 then 'failed' when event_id % 7 = 0 then 'deferred' else 'completed' end as outcome, count(*) as n from events group by 1")
def schedule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    error = F.when(i % 5 == 0, "network").when(i % 7 == 0, "backoff")
    return t(spark, sf_dir, "events").groupBy(decisions.schedule_outcome(i % 4 != 0, error).alias("outcome")).agg(F.count("*").alias("n"))


@query("select lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, count(*) as pages, string_agg(distinct lower(left(url, 5)), ',' order by lower(left(url, 5))) as schemes from pages group by 1")
def profiles_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    return t(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_set(F.lower(F.substring("url", 1, 5)))), ",").alias("schemes"))


@query(f"""{bm25_sql()}, top as {top_sql(10)} select qid, count(distinct source) as repos, bool_or(doc_id % 3 = 0) as any_open from top join documents on doc_id = source_id group by qid""")
def result_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source")
    return lexical_hits(spark, sf_dir, 10).join(docs, "source_id").groupBy("qid").agg(F.size(F.collect_set("source")).cast("long").alias("repos"), F.bool_or(F.col("source_id") % 3 == 0).alias("any_open"))


@query("select source, case when count(*) filter (doc_id % 50 = 7) = 0 then min(doc_id) end as oldest_sync from documents group by source")
def oldest_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository that never had a sync leaves the whole scope without one."""
    d = t(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 50 != 7, F.col("doc_id")).alias("synced_at"))
    return d.groupBy("source").agg(F.when(F.count_if(F.col("synced_at").isNull()) == 0, F.min("synced_at")).alias("oldest_sync"))


@query("select event_id, case when event_id % 2 = 0 then case when event_id % 3 = 0 then 'thread' else 'source' end when event_id % 5 = 0 then 'repo' end as target from events")
def purge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    decision = F.when(i % 2 == 0, "deleted").when(i % 5 == 0, "permission_loss").otherwise("present")
    return t(spark, sf_dir, "events").select("event_id", decisions.purge_target(decision, F.when(i % 3 == 0, "issue").otherwise("issue_comment")).alias("target"))


@query("select event_id, event_id % 6 <> 0 and event_id % 100 <= 40 and event_id % 2 = 0 as skip, event_id % 6 <> 0 and (event_id % 5 = 0 or event_id % 300 > 200) as stale from events")
def skip_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return t(spark, sf_dir, "events").select("event_id", decisions.skip_if_fresh(i % 100, F.when(i % 6 != 0, 40), i % 2 == 0).alias("skip"), decisions.reconciliation_stale(F.when(i % 6 != 0, 200), F.when(i % 5 != 0, i % 300)).alias("stale"))


@query(f"""{_BRANCHES}, pool as (select 'lexical' as branch, qid, source_id, lr as rank from lex where lr <= 20 union all select 'dense', qid, source_id, dr from den where dr <= 20),
    s as (select pool.*, greatest((source_id * 7) % 31, (source_id * 11) % 29) as score from pool) select branch, qid, source_id, row_number() over (partition by branch, qid order by score desc, rank, source_id) as pool_rank from s""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two heads is scored once per chunk; a source has its best chunk's score."""
    lex, den = _branches(spark, sf_dir)
    pools = lex.filter("rank <= 20").withColumn("branch", F.lit("lexical")).unionByName(den.filter("rank <= 20").withColumn("branch", F.lit("dense")))
    each = pools.select("qid", "source_id").distinct().withColumn("score", F.explode(F.array(F.col("source_id") * 7 % 31, F.col("source_id") * 11 % 29)))
    return fusion.pool_reranked(pools, each).select("branch", "qid", "source_id", "pool_rank")


@query(f"""{_BRANCHES}, f as (select *, round(coalesce(1::double / (60 + lr), 0::double) + coalesce(1::double / (60 + dr), 0::double), 9) as s from both_ where lr <= 20 or dr <= 20), r as (select *, row_number() over (partition by qid order by s desc, case when lr is null then 1 else 0 end, coalesce(lr, dr), source_id) as rank from f)
    select qid, source_id, rank from r where rank <= 20""")
def screening_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights; ties go to what was seen first, lexical rows before dense ones."""
    return fusion.screened(*_branches(spark, sf_dir))


@query("select 0::bigint as backwards, count(*) filter (len(regexp_extract_all(text, '[^ ]+')) > 900) > 0 as several from documents")
def chunk_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No chunk of any document ends before its predecessor."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    made = chunks.chunked(t(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("before", F.lag("token_end").over(w))
    return made.agg(F.count_if(F.col("token_end") <= F.col("before")).alias("backwards"), (F.max("chunk_index") > 0).alias("several"))


@query("with recursive m as (select doc_id as source, doc_id // 2 as target from documents where doc_id > 3 and doc_id % 2 = 0), w as (select source, target as final, 1 as hops from m union all select w.source, m.target, hops + 1 from w join m on m.source = w.final where hops < 8) select source, final, hops::bigint as hops from w qualify row_number() over (partition by source order by hops desc) = 1")
def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves are followed to their end, eight at most."""
    moves = t(spark, sf_dir, "documents").filter("doc_id > 3 and doc_id % 2 = 0").select(F.col("doc_id").alias("source"), F.expr("doc_id div 2").alias("target"))
    return resolve.aliases(moves).select("source", "final", F.col("hops").cast("long").alias("hops"))


@query("select conv_id, turn, case when turn % 4 = 0 then 'complete' when turn % 4 = 1 then 'missing' when turn % 4 = 2 then 'corrupt' else 'partial' end as state, case when turn % 4 = 0 then 'none' when turn % 4 = 2 then 'rebuild' else 'embed_missing' end as repair, case when turn % 4 = 0 then 'hybrid' else 'bm25' end as mode from conversations")
def embedding_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    state = F.when(k == 0, "complete").when(k == 1, "missing").when(k == 2, "corrupt").otherwise("partial")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("state"), decisions.embedding_repair(state).alias("repair"), decisions.search_mode(state).alias("mode"))


@query("select conv_id * 100 + turn as chunk_id, sqrt(1)::double as length from conversations where turn % 3 <> 0")
def staged_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chunks that a generation lacks are encoded; every vector has length one."""
    c = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.sha2("text", 256).alias("context_hash"), F.col("text").alias("body"), "turn")
    made = models.staged(c, c.filter("turn % 3 = 0"), models.HashingEncoder())
    return made.select("chunk_id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


_TOKENS = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"


@query(f"""{bm25_sql()}, top as {top_sql(10)}, p as (select qid, source_id, regexp_extract_all(lower(b.text), '{_TOKENS}')[1:{models.QUERY_TOKENS}] as q, regexp_extract_all(lower(d.text), '{_TOKENS}') as d from top join benchmark b on b.item_id = qid join documents d on d.doc_id = source_id)
    select qid, source_id, len(list_intersect(list_distinct(q), list_distinct(d[1:greatest({models.DOCUMENT_TOKENS}, {models.PAIR_TOKENS} - len(q))])))::double / greatest(1, len(list_distinct(q))) as score from p""")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable scorer over each query's first ten hits; what lies beyond its window does not count."""
    text = lambda table, key, name, to: t(spark, sf_dir, table).select(F.col(key).alias(name), F.col("text").alias(to))
    pairs = lexical_hits(spark, sf_dir, 10).select("qid", "source_id").join(text("benchmark", "item_id", "qid", "query"), "qid").join(text("documents", "doc_id", "source_id", "body"), "source_id")
    return models.scored_pairs(pairs, models.OverlapScorer(), "query", "body", ["qid", "source_id"])


@query()
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query lifecycle over conversations: turn 0 is an issue, other turns its comments. The whole
    first turns of conversations whose id is divisible by fifty ask all; first turns are titles. Every turn is
    a source, also where a conversation has no first turn: then it has no title. Routes, filters, BM25 and
    dense branch, fusion, version check, evidence. No SQL: its parts have theirs."""
    c = t(spark, sf_dir, "conversations")
    issues = c.filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("parent"))  # one of a conversation, should there be more
    titled = c.join(issues, "conv_id", "left")
    first = F.coalesce(F.col("turn") == 0, F.lit(False))
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    sources = written(
        titled.select(
            F.concat_ws("/", part("conv_id"), part("turn")).alias("source_id"), F.when(first, "issue").otherwise("issue_comment").alias("entity_type"), F.concat(F.lit("org/"), F.col("role")).alias("repo"), F.col("conv_id").alias("issue_number"),
            F.when(first, "open").alias("state"), F.when(first, F.array("role")).alias("labels"), F.col("role").alias("author"), F.when(first, F.col("text")).alias("title"), F.col("text").alias("body"),
            F.when(~first, F.col("parent")).alias("parent_issue_title"), F.lit(1).alias("version"),
        ),
        "sources",
    )
    index = lexical.Index.build(sources, search.index_fields(), new_folder(spark, "index"), phrases=False)  # whole texts as plain terms
    encoder = models.HashingEncoder()
    vectors = written(models.embedded(sources, encoder, "body", ["source_id"]), "vectors")
    lines = sources.select("source_id", "version", F.posexplode(F.split("body", "\n")).alias("chunk_index", "body"))
    asked = issues.filter(f"conv_id % {EVERY} = 0").select(F.col("conv_id").alias("qid"), plain(F.col("parent")).alias("query"))
    queries = models.embedded(asked, encoder, "query", ["qid", "query"], models.QUERY_PREFIX).withColumnRenamed("vector", "query_vector")
    corpus = search.Corpus(sources, sources.filter("issue_number % 97 = 5").select("source_id"), index, vectors, lines, dimension=encoder.dimension)
    return search.search(corpus, queries)


_OPERATORS = """ops as (select item_id, [x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> '' and strlen(x) < 40] as w from benchmark),
    cl as (select item_id as qid, 'must' as occur, 'body' as asked, w[1] as term from ops union all select item_id, 'not', null, w[4] from ops where w[4] not in (w[1], w[2], w[3]) union all select item_id, 'should', null, w[2] from ops union all select item_id, 'should', 'title', w[3] from ops),
    qc as (select qid, occur, asked, term, count(*) as qtf from cl where term is not null group by all),
    h as (select qc.*, p.doc_id as source_id, qtf * ln(1 + (s.n - f.df + 0.5::double) / (f.df + 0.5::double)) * p.tf * 2.2::double / (p.tf + 1.2::double * (0.25::double + 0.75::double * p.length / s.average)) as w
        from qc join post p on p.term = qc.term and (qc.asked is null or qc.asked = p.field) join freq f on f.field = p.field and f.term = p.term join stats s on s.field = p.field),
    g as (select qid, source_id, sum(w) filter (occur <> 'not') as score, count(distinct term) filter (occur = 'must') as met, count(*) filter (occur = 'not') as broken from h group by qid, source_id),
    top as (select qid, source_id, score from g where broken = 0 and met = 1)"""


@query(f"{bm25_sql(fields=('title', 'body'))}, {_OPERATORS} select * from {top_sql(10, 'top')}")
def bm25_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required term in the body, a forbidden one anywhere, optional ones, one of them in the title."""
    w = tokens(F.col("text"))
    forbidden = F.when(~F.get(w, 3).isin(*(F.get(w, i) for i in range(3))), F.concat(F.lit("-"), F.get(w, 3)))
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat_ws(" ", F.concat(F.lit("+body:"), F.get(w, 0)), F.get(w, 1), F.concat(F.lit("title:"), F.get(w, 2)), forbidden).alias("query"))
    index = index_of(spark, sf_dir)
    return lexical.ranked(grammar.scores(index, written(grammar.nodes(asked, F.col("query"), ["title", "body"]), "parsed")), 10)


_TREES = """qs as (select item_id as qid, [x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> '' and strlen(x) < 40] as w from benchmark),
    toks as (select 'title' as field, doc_id, [x for x in regexp_split_to_array(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\\p{L}\\p{N}]+') if x <> '' and strlen(x) < 40] as t from documents
        union all select 'body', doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> '' and strlen(x) < 40] from documents),
    places as (select field, doc_id, len(t) as length, unnest(t) as term, unnest(range(1, len(t) + 1)) as i from toks),
    one as (select p.field, p.doc_id, p.term, any_value(p.length) as length, count(*) as tf from places p where p.term in (select unnest(w) from qs) group by p.field, p.doc_id, p.term),
    two as (select qs.qid, a.field, a.doc_id, any_value(a.length) as length, count(*) as tf from qs join places a on a.term = w[1] join places b on b.term = w[2] and b.field = a.field and b.doc_id = a.doc_id and b.i = a.i + 1 group by all),
    factor as (select f.field, term, ln(1 + (s.n - f.df + 0.5::double) / (f.df + 0.5::double)) as idf, s.average from freq f join stats s on s.field = f.field),
    sat as (select 'phrase' as leaf, qid, doc_id, sum((x.idf + y.idf) * 2 * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / x.average))) as v
            from two join qs using (qid) join factor x on x.field = two.field and x.term = w[1] join factor y on y.field = two.field and y.term = w[2] group by qid, doc_id
        union all select 'l' || k, qid, doc_id, sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / average)))
            from (select qid, k, w[k] as term from qs, range(3, 6) r(k)) q join one using (term) join factor using (field, term) where k <> 5 or one.field = 'body' group by k, qid, doc_id),
    wide as (select qid, doc_id, max(v) filter (leaf = 'phrase') as p, max(v) filter (leaf = 'l3') as c, max(v) filter (leaf = 'l4') as d, max(v) filter (leaf = 'l5') as e from sat group by qid, doc_id),
    top as (select qid, doc_id as source_id, coalesce(p, 0) + coalesce(case when d is null then c end, 0) + coalesce(e, 0) as score from wide where p is not null or (c is not null and d is null))"""


@query(f"{bm25_sql(fields=('title', 'body'))}, {_TREES} select * from {top_sql(10, 'top')}")
def bm25_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``+("a b"^2 OR (c AND NOT d)) body:e`` of each text's first five words: phrases in either field, nested groups."""
    w = tokens(F.col("text"))
    text = F.concat(F.lit('+("'), F.get(w, 0), F.lit(" "), F.get(w, 1), F.lit('"^2 OR ('), F.get(w, 2), F.lit(" AND NOT "), F.get(w, 3), F.lit(")) body:"), F.get(w, 4))
    asked = t(spark, sf_dir, "benchmark").filter(F.size(w) >= 5).select(F.col("item_id").alias("qid"), text.alias("query"))
    return lexical.ranked(grammar.scores(index_of(spark, sf_dir, phrases=True), written(grammar.nodes(asked, F.col("query"), ["title", "body"]), "parsed"), fields=["title", "body"]), 10)
