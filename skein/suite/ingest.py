"""Ingest, lifecycle and streams over ``events`` and ``conversations``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.times import overlap_since as overlap
from skein.operators import lifecycle, resolve
from skein.plans.storage import new_folder, written
from skein.sources import pages, records
from skein.streaming import ingest
from skein.suite.base import ORACLE_SQL, query, t


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select user_id, event_id, epoch_us(ts)::bigint as ts_us from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = resolve.latest(_events(spark, sf_dir), ["user_id"], [F.col("ts"), F.col("event_id")])
    return last.select("user_id", "event_id", F.unix_micros("ts").alias("ts_us"))


@query("select conv_id, turn from conversations c where turn > 0 and not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.role = 'system') and not exists (select 1 from labels l where l.doc_id = c.conv_id and l.quality = 0)")
def tombstone_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    dead = c.filter("role = 'system'").select("conv_id").union(t(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("conv_id"))).distinct()
    return resolve.active(c.filter("turn > 0"), dead, "conv_id").select("conv_id", "turn")


@query("select c.conv_id, c.turn, c.role, sha256(p.text) as parent_hash, p.role as parent_role from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = 0 where c.turn > 0")
def parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    issues = c.filter("turn = 0").select("conv_id", F.col("text").alias("body"), F.col("role").alias("author"))
    return resolve.with_parent(c.filter("turn > 0"), issues, "conv_id").select("conv_id", "turn", "role", F.sha2("parent.body", 256).alias("parent_hash"), F.col("parent.author").alias("parent_role"))


@query("""with r as (select item_id, unnest([item_id, item_id * 3, item_id + 100000]) as source_id, unnest([0, 1, 2]) as input_index, 'src' || (item_id % 20) as wanted from benchmark)
    select r.item_id as request_id, input_index::bigint as input_index, r.source_id, case when l.doc_id is not null then 'tombstoned' when d.doc_id is null then 'not_found' when r.wanted <> d.source then 'scope_mismatch' else 'ok' end as status
    from r left join documents d on d.doc_id = r.source_id left join (select doc_id from labels where quality = 0) l on l.doc_id = r.source_id""")
def get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    requests = t(spark, sf_dir, "benchmark").select(i.alias("request_id"), F.array(i, i * 3, i + 100000).alias("ids"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("repo"))
    sources = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("repo"))
    dead = t(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("source_id"))
    return resolve.get_batch(requests, sources, dead).select("request_id", F.col("input_index").cast("long").alias("input_index"), "source_id", "status")


@query("select event_type as endpoint, max(epoch_us(ts))::bigint as watermark_us, max(epoch_us(ts))::bigint - 60000000 as since_us from events group by event_type")
def cursor_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lifecycle.watermarks(_events(spark, sf_dir), "event_type", "ts")
    return w.select(F.col("event_type").alias("endpoint"), F.unix_micros("watermark").alias("watermark_us"), F.unix_micros(overlap(F.col("watermark"))).alias("since_us"))


@query("""with c as (select case when user_id % 2 = 0 then 'history:' else 'issues:' end || user_id as endpoint, max(epoch_us(ts))::bigint as cursor from events group by user_id) select case when endpoint like 'history:%' then 'history' else 'open' end as kind, case when endpoint like 'history:%' then min(cursor) else max(cursor) end as cursor from c group by kind, endpoint like 'history:%'""")
def combined_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "history:").otherwise("issues:"), F.col("user_id").cast("string"))
    return lifecycle.combined_cursors(_events(spark, sf_dir).groupBy(name.alias("endpoint")).agg(F.max(F.unix_micros("ts")).alias("cursor")))


@query("select event_id, event_type, user_id from events where epoch_us(ts) >= (select max(epoch_us(ts)) - 60000000 from events e2 where event_id % 10 < 9)")
def overlap_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan from the watermark less a minute brings again."""
    e = _events(spark, sf_dir)
    since = e.filter("event_id % 10 < 9").agg(overlap(F.max("ts")).alias("since"))
    return e.join(F.broadcast(since), F.col("ts") >= F.col("since")).select("event_id", "event_type", "user_id")


@query("with r as (select user_id, event_id, value, row_number() over (partition by user_id order by epoch_us(ts) desc, event_id desc) as n from events) select user_id, event_id, round(value, 6) as value from r where n = 1")
def upsert_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves and the second again: the same snapshot as all at once."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "value", "ts")
    first, second = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    keys, order = ["user_id"], ["ts", "event_id"]
    once = lifecycle.upsert(first.limit(0), first, keys, order)
    return lifecycle.upsert(lifecycle.upsert(once, second, keys, order), second, keys, order).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("""select count(*) filter (o.doc_id is null) as added, count(*) filter (o.h <> n.h) as updated, count(*) filter (o.h = n.h) as unchanged from (select doc_id, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as h from documents where doc_id % 3 <> 0) n left join (select doc_id, sha256(text) as h from documents where doc_id % 2 = 0) o using (doc_id)""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    arriving = d.filter("doc_id % 3 != 0").withColumn("body", F.when(F.col("doc_id") % 5 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return lifecycle.upsert_counts(d.filter("doc_id % 2 = 0"), arriving, ["doc_id"])


@query("""with o as (select user_id, epoch_us(ts)::bigint as us, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by epoch_us(ts), event_id rows unbounded preceding) as held from events) select user_id, max(us) filter (held = 0) as watermark_us, count(*) filter (held = 1) as behind from o group by user_id""")
def held_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error event stands for a deferred row."""
    w = lifecycle.held_watermark(_events(spark, sf_dir), "user_id", "ts", F.col("event_type") == "error", "event_id")
    return w.select("user_id", F.unix_micros("watermark").alias("watermark_us"), "behind")


@query("select user_id, event_type as operation, event_id from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def coalesce_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.coalesced(t(spark, sf_dir, "events"), "user_id", ["event_id"]).select("user_id", F.col("event_type").alias("operation"), "event_id")


@query("select conv_id, turn from conversations where conv_id % 3 = 0 and turn % 2 = 1")
def deleted_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch of every third conversation that lacks its odd turns."""
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn")
    return lifecycle.deleted_children(c, c.filter("conv_id % 3 = 0 and turn % 2 = 0"), ["conv_id", "turn"])


@query("select distinct source as repo from documents where lower(source) not in ('src0', 'src3', 'src7')")
def removed_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = spark.createDataFrame([("SRC0",), ("src3",), ("Src7",)], "repo string")
    return lifecycle.removed_repos(t(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct(), allow)


@query("""with g as (select case doc_id % 3 when 0 then 'thread' when 1 then 'source' else 'repo' end as kind, case when doc_id % 3 = 2 then upper(source) else source end as repo, doc_id as source_id from documents) select kind, repo, source_id from g where kind <> 'thread' or lower(repo) not in (select lower(repo) from g where kind = 'repo')""")
def purge_subsume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = t(spark, sf_dir, "documents"), F.col("doc_id") % 3
    targets = d.select(F.when(i == 0, "thread").when(i == 1, "source").otherwise("repo").alias("kind"), F.when(i == 2, F.upper("source")).otherwise(F.col("source")).alias("repo"), F.col("doc_id").alias("source_id"))
    return lifecycle.subsumed_purges(targets)


@query("""select conv_id, turn from conversations where not (role = 'user' and conv_id % 10 = 0) and conv_id % 7 <> 0 and conv_id * 100 + turn not in (select conv_id * 100 + turn from conversations where turn = 3 and conv_id % 2 = 0)""")
def purge_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table rewritten without purged repositories, threads and single sources."""
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", (F.col("conv_id") % 10).cast("string")).alias("repo"), F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("source_id"))
    threads = c.filter("conv_id % 7 = 0").select(F.lit("thread").alias("kind"), F.lit("").alias("repo"), F.col("conv_id").alias("source_id"))
    single = c.filter("turn = 3 and conv_id % 2 = 0").select(F.lit("source").alias("kind"), F.lit("").alias("repo"), "source_id")
    repo = spark.createDataFrame([("repo", "USER0", -1)], "kind string, repo string, source_id long")
    return lifecycle.purged(c, threads.union(single).union(repo)).select("conv_id", "turn")


@query("select conv_id * 100 + turn as chunk_id from conversations where not (turn % 2 = 0 and conv_id % 4 <> 0)")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of staged embeddings, those of every fourth conversation have another context."""
    c = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.sha2("text", 256).alias("context_hash"), "conv_id", "turn")
    staged = c.filter("turn % 2 = 0").withColumn("context_hash", F.when(F.col("conv_id") % 4 == 0, "old").otherwise(F.col("context_hash")))
    return lifecycle.missing_chunks(c, staged).select("chunk_id")


@query("select count(*) filter (turn = 0) as issues, count(*) filter (turn > 0) as comments, (select count(*) from labels where quality = 0) as tombstones, (select count(distinct user_id) from events) as dirty_tasks from conversations")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "conversations").select(F.when(F.col("turn") == 0, "issue").otherwise("issue_comment").alias("entity_type"))
    return lifecycle.status_counts(s, t(spark, sf_dir, "labels").filter("quality = 0"), t(spark, sf_dir, "events").select("user_id").distinct())


@query("select user_id, count(*) as changed from events where epoch_us(ts) >= (select max(epoch_us(ts)) from events) - 7 * 86400000000 group by user_id")
def recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumnRenamed("ts", "updated_at")
    now = e.agg(F.max("updated_at").alias("now"))
    return lifecycle.reconciliation_candidates(e.crossJoin(F.broadcast(now)), F.col("now")).groupBy("user_id").agg(F.count("*").alias("changed"))


@query("""with old as (select conv_id as source_id, turn as chunk_index, 1 + conv_id % 2 as version, case when conv_id % 5 = 0 then 'old' else 'now' end as fingerprint, text as body from conversations where turn < 4),
    again as (select distinct conv_id as source_id, 1 + conv_id % 2 as version from conversations where conv_id % 3 = 0), made as (select conv_id, turn, 1 + conv_id % 2, 'new', text || '!' from conversations where conv_id % 6 = 0 and turn = 0)
    select source_id, chunk_index, version, fingerprint, sha256(body) as h from (select * from old anti join again using (source_id, version) union all select * from made)""")
def chunk_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that are cut anew lose all old chunks, also where no new ones come."""
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), (1 + F.col("conv_id") % 2).alias("version"), F.when(F.col("conv_id") % 5 == 0, "old").otherwise("now").alias("fingerprint"), F.col("text").alias("body"))
    made = c.filter("source_id % 6 = 0 and chunk_index = 0").withColumns({"fingerprint": F.lit("new"), "body": F.concat("body", F.lit("!"))})
    out = lifecycle.replaced_chunks(c.filter("chunk_index < 4"), made, c.filter("source_id % 3 = 0").select("source_id", "version").distinct())
    return out.select("source_id", "chunk_index", "version", "fingerprint", F.sha2("body", 256).alias("h"))


@query("select distinct conv_id as source_id, 1 as version from conversations a where exists (select 1 from conversations b where b.conv_id = a.conv_id and turn > 0 and (conv_id + turn) % 4 = 0) or not exists (select 1 from conversations b where b.conv_id = a.conv_id and turn > 0)")
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions without chunks, or with some of another chunker."""
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.lit(1).alias("version"), "turn")
    chunks = c.filter("turn > 0").withColumn("fingerprint", F.when((F.col("source_id") + F.col("turn")) % 4 == 0, "old").otherwise("now"))
    return lifecycle.stale_versions(chunks, c.select("source_id", "version").distinct(), "now")


@query("select conv_id * 100 + turn as chunk_id, turn as generation_id, case when turn = 2 then 'active' else 'ready' end as state from conversations where turn < 3")
def generation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of known generations with their state."""
    members = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("turn").alias("generation_id"))
    generations = spark.createDataFrame([(0, "ready"), (1, "ready"), (2, "active")], "generation_id long, state string")
    return resolve.of_generation(members, generations).select("chunk_id", "generation_id", "state")


@query("select event_id from (select event_id, ['building', 'ready', 'active_'][event_id % 3 + 1] as state, event_id % 5 = 0 as active, 1800000000 - event_id * 3601 as changed from events) where not active and ((state = 'building' and 1800000000 - changed > 86400) or (state = 'ready' and 1800000000 - changed > 604800))")
def retained_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds older than a day and ready generations older than a week go, but for active ones."""
    i = F.col("event_id")
    g = t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.lit("building"), F.lit("ready"), F.lit("active_")), (i % 3 + 1).cast("int")).alias("state"), (i % 5 == 0).alias("active"), F.timestamp_seconds(1800000000 - i * 3601).alias("changed_at"))
    return lifecycle.retained(g, F.timestamp_seconds(F.lit(1800000000))).select("event_id")


def _pages(spark: SparkSession, sf_dir: str) -> str:
    """Landed pages of two repositories' issues and comments, a page for each conversation (its first turn
    as an issue, or a pull request) and for its later turns; some not modified, some of a known tag."""
    c, i = t(spark, sf_dir, "conversations"), F.col("conv_id")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    url = text("https://h.org/o/r", i % 2, "/issues/", i)
    user = F.struct(F.col("role").alias("login"))
    pull = F.when(i % 11 == 0, F.struct(F.lit("x").alias("url")))
    issue = F.struct(text("I", i).alias("node_id"), i.alias("id"), i.alias("number"), text("t", i).alias("title"), F.col("text").alias("body"), F.lit("open").alias("state"), F.array(F.struct(F.col("role").alias("name"))).alias("labels"), user.alias("user"), F.lit("2024-01-01T00:00:00Z").alias("updated_at"), url.alias("html_url"), pull.alias("pull_request"))
    comment = F.struct(text("C", i, "-", F.col("turn")).alias("node_id"), (i * 100 + F.col("turn")).alias("id"), F.col("text").alias("body"), user.alias("user"), text("https://h.org/repos/o/r", i % 2, "/issues/", i).alias("issue_url"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"))
    item, first = F.when(F.col("turn") == 0, F.to_json(issue)).otherwise(F.to_json(comment)), F.col("turn") == 0
    endpoint = F.concat(F.when(first, "issues:").otherwise("repo-comments:"), text("o/r", i % 2))
    pages = c.groupBy(endpoint.alias("endpoint"), i, text("o/r", i % 2).alias("repo")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # a conversation's turns
    rows = pages.select("endpoint", "repo", F.lit("h.org").alias("host"), (i + 1).alias("page"), F.when(i % 7 == 3, 304).otherwise(200).alias("status"), text("e", i).alias("etag"), F.lit(None).cast("string").alias("link"), F.lit(10).alias("remaining"), "items", F.lit("2024-02-01T00:00:00Z").alias("fetched_at"))
    path = new_folder(spark, "pages")
    rows.write.json(path, ignoreNullFields=False)
    return path


@query("""with kept as (select * from conversations where conv_id % 7 <> 3 and conv_id <> 5), i as (select * from kept where turn = 0 and conv_id % 11 <> 0)
    select 'skein://h.org/issue/I' || conv_id as source_id, 'issue' as entity_type, 'o/r' || conv_id % 2 as repo, 't' || conv_id as title, role as author, sha256(text) as body_hash, null as parent from i
    union all select 'skein://h.org/issue-comment/C' || k.conv_id || '-' || k.turn, 'issue_comment', 'o/r' || k.conv_id % 2, null, k.role, sha256(k.text), 'skein://h.org/issue/I' || k.conv_id from kept k join i on i.conv_id = k.conv_id where k.turn > 0""")
def landed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages to sources: unchanged and not modified pages and pull requests are left out; comments
    whose issue is not known are deferred."""
    known = spark.createDataFrame([("issues:o/r1", "e5"), ("repo-comments:o/r1", "e5")], "endpoint string, etag string")
    pages = records.changed(records.landed(spark, _pages(spark, sf_dir)), known)
    of = lambda kind, schema: records.items(pages.filter(F.startswith("endpoint", F.lit(kind))), schema)
    issues = records.issues(of("issues:", records.ISSUE))
    good, _ = records.comments(of("repo-comments:", records.COMMENT), issues)
    return records.all_sources(issues, good).select("source_id", "entity_type", "repo", "title", "author", "body_hash", F.col("parent_issue_source_id").alias("parent"))


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """The same pages, each a file of its own as a client lands them: written by tasks."""
    path = new_folder(spark, "page-files")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for page in b.to_pylist():
                folder = f"{root}/{quote(page['endpoint'], safe='')}"
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{page['page']:08d}.json") as f:
                    f.write(json.dumps(page).encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    written(records.landed(spark, _pages(spark, sf_dir)).mapInArrow(put, "n long"), "landed")
    return path


@query(ORACLE_SQL["landed_sources"])
def streamed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of page files in two bounded runs, whose rows and cursors become visible together."""
    path, landing, state = _page_files(spark, sf_dir), new_folder(spark, "landing"), new_folder(spark, "state")
    pages.landed(spark, path, landing, state, endpoints="issues:")
    known = spark.createDataFrame([("issues:o/r1", "e5"), ("repo-comments:o/r1", "e5")], "endpoint string, etag string")
    fresh = records.changed(pages.landed(spark, path, landing, f"{state}-2"), known)
    of = lambda kind, schema: records.items(fresh.filter(F.startswith("endpoint", F.lit(kind))), schema)
    issues = records.issues(of("issues:", records.ISSUE))
    good, _ = records.comments(of("repo-comments:", records.COMMENT), issues)
    return records.all_sources(issues, good).select("source_id", "entity_type", "repo", "title", "author", "body_hash", F.col("parent_issue_source_id").alias("parent"))


@query("""with i as (select conv_id, 'o/r' || conv_id % 2 as repo from conversations where turn = 0 and conv_id % 11 <> 0 and conv_id % 7 <> 3) select 'C' || k.conv_id || '-' || k.turn as node_id, k.conv_id as parent_issue_number from conversations k left join i using (conv_id) where k.turn > 0 and k.conv_id % 7 <> 3 and i.conv_id is null""")
def deferred_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = records.changed(records.landed(spark, _pages(spark, sf_dir)), spark.createDataFrame([], "endpoint string, etag string"))
    of = lambda kind, schema: records.items(pages.filter(F.startswith("endpoint", F.lit(kind))), schema)
    return records.comments(of("repo-comments:", records.COMMENT), records.issues(of("issues:", records.ISSUE)))[1].select("node_id", "parent_issue_number")


@query("""select page_id, 'skein://h/issue/' || page_id || '%2Fa%20%7E'::varchar as source_id, 'issue' as kind, case page_id % 4 when 0 then 'o/n' || page_id when 1 then 'o/n' || page_id when 2 then 'o/n.x' else null end as repo, page_id % 3 = 0 as trusted, case when page_id % 2 = 0 then 'https://x/' || page_id end as next, case when page_id % 5 <> 0 then 'name-' || page_id end as name from pages""".replace("%7E", "~"))
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids and their kind, repositories of git remotes, origins that may see a token, the page that
    a header calls the next, names of resources."""
    i = F.col("page_id")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    source = X.source_id("skein", F.lit("h"), F.lit("issue"), text(i, "/a ~"))
    remote = F.when(i % 4 == 0, text("git@h.org:o/n", i, ".git")).when(i % 4 == 1, text("https://h.org/o/n", i)).when(i % 4 == 2, F.lit("ssh://git@h.org/o/n.x.git")).otherwise(F.lit("nothing"))
    origin = F.when(i % 3 == 0, "https://api.h.org/x").when(i % 3 == 1, "https://api.h.org.evil/x").otherwise("http://api.h.org/x")
    link = F.when(i % 2 == 0, text('<https://x/', i, '>; rel="next", <https://x/9>; rel="last"')).otherwise(F.lit('<https://x/1>; rel="prev"'))
    name = F.when(i % 5 == 0, text("a b", i)).otherwise(text("Name-", i))
    return t(spark, sf_dir, "pages").select(
        "page_id", source.alias("source_id"), X.source_kind(source).alias("kind"), records.repo_of_remote(remote).alias("repo"), records.trusted_origin(origin, "api.h.org").alias("trusted"), X.next_page(link).alias("next"), X.safe_name(name).alias("name")
    )


def _landing(spark: SparkSession, sf_dir: str, times: int, files: int) -> str:
    """A landing folder with all events, so many times over, in so many files."""
    path, e = new_folder(spark, "landing"), t(spark, sf_dir, "events")
    for _ in range(times):
        e.repartition(files, "event_id").write.mode("append").parquet(path)
    return path


@query("select count(*) as events, count(distinct event_id) as distinct_events from events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that finds all events twice, deduplicated within the overlap."""
    out, path = new_folder(spark, "dedupe"), _landing(spark, sf_dir, 2, 2)
    stream = ingest.deduplicated(spark.readStream.schema(t(spark, sf_dir, "events").schema).parquet(path), ["event_id"])
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("distinct_events"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in steps of two files; each step's snapshot is the last one with its rows."""
    out, path = new_folder(spark, "upsert"), _landing(spark, sf_dir, 1, 4)
    stream = ingest.timed(ingest.bounded(spark, t(spark, sf_dir, "events").schema, path, 2))
    ingest.snapshots(stream, f"{out}/table", f"{out}/state", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return ingest.current(spark, f"{out}/table").select("user_id", "event_id")
