"""Decision ladders over rows derived from ``events``, ``pages`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import times
from skein.operators import decisions as D
from skein.plans.storage import new_folder
from skein.streaming import ingest, waiting
from skein.suite.base import query, t


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events")


def _pick(values, i):
    """The value whose place is ``i`` modulo their number; null for None."""
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else repr(v) for v in values) + "]"


def _picked(values, i: str) -> str:
    return f"{_list(values)}[({i}) % {len(values)} + 1]"


@query("""with r as (select event_id, case when event_id % 11 <> 0 then event_id * 37 % 5000 end as age, event_id % 3 = 0 as opened, case when event_id % 4 <> 1 then event_id * 13 % 2000 end as open_max, event_id % 5 = 0 as fails from events),
    w as (select *, coalesce(age > 1000, false) as older, coalesce(opened and age > open_max, false) as older_open from r)
    select event_id, case when age is null then 'never_synced' when not older and not older_open then 'fresh' when fails then 'stale_fail' else 'stale_warn' end as decision, case when opened and open_max < 1000 then open_max else 1000 end::bigint as max_age,
        concat_ws(',', case when age is null then 'never_synced:' || case when fails then 'fail' else 'warn_strong' end end, case when older then 'query_snapshot_stale:' || case when fails then 'fail' else 'warn' end end, case when older_open then 'active_issue_snapshot_stale:' || case when fails then 'fail' else 'warn_strong' end end) as warnings from w""")
def freshness_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    f = D.freshness(F.when(i % 11 != 0, i * 37 % 5000), F.lit(1000).cast("long"), i % 3 == 0, F.when(i % 4 != 1, i * 13 % 2000), i % 5 == 0)
    made = _e(spark, sf_dir).select("event_id", f.alias("f"))
    return made.select("event_id", "f.decision", "f.max_age", F.array_join(F.transform("f.warnings", lambda w: F.concat_ws(":", w["code"], w["severity"])), ",").alias("warnings"))


@query("select event_id, case when event_id % 2 = 0 and event_id % 3 = 0 and event_id % 5 <> 0 then 'complete' else 'partial' end as coverage, case when event_id % 2 <> 0 then 'sync_open' when event_id % 3 <> 0 then 'backfill_history' else 'none' end as next_action, not (event_id % 2 = 0 and event_id % 3 = 0 and event_id % 5 <> 0) and event_id % 4 = 0 and event_id % 7 <> 0 as warned from events")
def coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    opened, history = i % 2 == 0, i % 3 == 0
    scope = D.scope_fingerprint(F.array(F.lit("A/b "), F.lit("c/D")))
    recorded = F.when(i % 5 == 0, "other").otherwise(D.scope_fingerprint(F.array(F.lit("c/d"), F.lit("a/b"), F.lit("A/B"))))
    state = D.coverage(opened, history, recorded, scope)
    return _e(spark, sf_dir).select("event_id", state.alias("coverage"), D.next_action(opened, history).alias("next_action"), D.coverage_warning(state, i % 4, F.when(i % 7 == 0, "exact").otherwise("ranked")).alias("warned"))


@query("""with s as (select source, count(*) as total, count(*) filter (doc_id % 20 < 18 and doc_id % 101 <> 0) as completed, count(*) filter (doc_id % 20 < 18 and doc_id % 101 = 0) as mismatched, min(doc_id) % 5 <> 4 as active, min(doc_id) % 4 <> 3 as matches, bool_or(doc_id % 331 = 7) as corrupt from documents group by source)
    select source, total, completed, total - completed as missing, mismatched, case when corrupt then 'corrupt' when not matches and mismatched > 0 then 'fingerprint_mismatch' when not active then 'missing' when not matches then 'fingerprint_mismatch' when total = completed then 'complete' else 'partial' end as state, not corrupt and matches and total > 0 and total = completed as ready from s""")
def embedding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a repository is embedded under the configured fingerprint, and what that allows."""
    d, docs = F.col("doc_id"), t(spark, sf_dir, "documents").withColumn("chunk_id", F.col("doc_id"))
    staged = docs.filter(d % 20 < 18).select("chunk_id", F.when(d % 101 == 0, "old").otherwise("now").alias("fingerprint"))
    counts = D.embedding_coverage(docs.select("source", "chunk_id"), staged, "now", ["source"])
    flags = docs.groupBy("source").agg((F.min(d) % 5 != 4).alias("active"), (F.min(d) % 4 != 3).alias("matches"), F.bool_or(d % 331 == 7).alias("corrupt"))
    c = counts.join(flags, "source")
    state = D.embedding_state(F.col("corrupt"), F.col("active"), F.col("matches"), F.col("missing"), F.col("mismatched"))
    return c.select("source", "total", "completed", "missing", "mismatched", state.alias("state"), D.hybrid_ready(F.col("corrupt"), F.col("matches"), F.col("total"), F.col("missing")).alias("ready"))


_RATE = """r as (select event_id, case when event_id % 7 <> 0 then event_id % 5000 end as lim, case when event_id % 9 <> 0 then event_id % 300 end as remaining, case when event_id % 5 <> 0 then 1000 + event_id % 400 end as reset_at, 900 + event_id % 500 - 300 as observed_at from events)"""


def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", F.when(i % 7 != 0, i % 5000).alias("limit"), F.when(i % 9 != 0, i % 300).alias("remaining"), F.when(i % 5 != 0, 1000 + i % 400).alias("reset_at"), (900 + i % 500 - 300).alias("observed_at"))


@query(f"with {_RATE} select event_id, case when 1050 - observed_at > 300 or observed_at > 1050 or (reset_at is not null and reset_at <= 1050) then 'stale' when lim is null or remaining is null or reset_at is null then 'partial' else 'fresh' end as state from r")
def rate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate(spark, sf_dir).select("event_id", D.rate_state(F.col("limit"), F.col("remaining"), F.col("reset_at"), F.col("observed_at"), F.lit(1050)).alias("state"))


@query(f"with {_RATE} select event_id, ceil(lim / 5.0)::bigint as reserve, case when lim < 0 or remaining < 0 or remaining > lim then 0 else greatest(0, remaining - ceil(lim / 5.0)::bigint) end::bigint as allowance from r where lim is not null and remaining is not null")
def reserve_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rate(spark, sf_dir).filter("`limit` is not null and remaining is not null")
    return r.select("event_id", times.reserve(F.col("limit")).alias("reserve"), D.allowance(F.col("limit"), F.col("remaining")).alias("allowance"))


@query("""with o as (select user_id, event_id as position, case when event_id % 4 = 0 then 'search' else 'core' end as resource, case when event_id % 7 <> 0 then event_id % 1000 end as lim, case when event_id % 9 <> 0 then event_id % 300 end as remaining, case when event_id % 5 <> 0 then 1000 + event_id % 400 end as reset_at, 900 + event_id % 500 - 300 as observed_at from events),
    f as (select *, case when remaining > lim then 0 else greatest(0, remaining - ceil(lim / 5.0)::bigint) end::bigint as allowance from o where resource = 'core' and 1050 - observed_at <= 300 and observed_at <= 1050 and reset_at > 1050 and lim is not null and remaining is not null)
    select user_id, allowance, position, observed_at from f qualify row_number() over (partition by user_id order by allowance, position) = 1""")
def conservative_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale, partial and other resources' observations do not count; of equal ones the first does."""
    i = F.col("event_id")
    rows = _rate(spark, sf_dir).withColumn("limit", F.when(i % 7 != 0, i % 1000)).join(_e(spark, sf_dir).select("event_id", "user_id"), "event_id")
    rows = rows.select("user_id", i.alias("position"), F.when(i % 4 == 0, "search").otherwise("core").alias("resource"), "limit", "remaining", "reset_at", "observed_at")
    return D.conservative_budget(rows, ["user_id"], F.lit(1050))


#: A gate's events: requests, reports with a figure, and a few reports without one.
_EVENTS = "select 'h' || user_id as host, event_id as seq, event_id // 64 as part, case when event_id % 3 = 0 then 'report' else 'request' end as kind, case when event_id % 3 = 0 and event_id % 21 <> 0 then event_id % 9 end as remaining from events"


def _gate_sql(key: str) -> str:
    return f"""with recursive e as (select *, row_number() over (partition by {key} order by seq) as n from ({_EVENTS})),
    s as (select distinct {key}, 0::bigint as n, '' as blocked, null::bigint as known, false as probed, null::bigint as seq, null::varchar as said, false as request from e
        union all select {", ".join(f"e.{k.strip()}" for k in key.split(","))}, e.n,
            case when blocked <> '' then blocked when kind = 'report' then case when remaining is null then 'unknown_budget_limit' else '' end when known is null then case when probed then 'unknown_budget_limit' else '' end when known > 0 then '' else 'rate_budget_reserve' end,
            case when kind = 'report' then case when known is null or remaining < known then remaining else known end when blocked = '' and known > 0 then known - 1 else known end,
            probed or (kind = 'request' and blocked = '' and known is null), e.seq,
            case when blocked <> '' then blocked when known is null then case when probed then 'unknown_budget_limit' else 'admitted' end when known > 0 then 'admitted' else 'rate_budget_reserve' end, kind = 'request'
        from s join e using ({key}) where e.n = s.n + 1)"""


@query(f"{_gate_sql('host, part')} select host, part, string_agg(said, ',' order by seq) as said from s where request group by host, part")
def request_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of 64 events is a run of its own."""
    i = F.col("event_id")
    event = F.struct("event_id", F.when(i % 3 == 0, "report").otherwise("request").alias("kind"), F.when((i % 3 == 0) & (i % 21 != 0), i % 9).alias("left"))
    runs = _e(spark, sf_dir).groupBy(F.concat(F.lit("h"), "user_id").alias("host"), F.expr("event_id div 64").alias("part")).agg(F.array_sort(F.collect_list(event)).alias("events"))  # 64 at most
    said = D.request_gate(F.col("events"))
    return runs.select("host", "part", F.array_join(said, ",").alias("said")).filter("said != ''")


@query(f"{_gate_sql('host')} select host, seq, said = 'admitted' as passes, nullif(said, 'admitted') as reason from s where request")
def budget_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gate over a stream, with its state kept per host."""
    i, path = F.col("event_id"), new_folder(spark, "requests")
    rows = _e(spark, sf_dir).select(F.concat(F.lit("h"), "user_id").alias("host"), i.alias("seq"), F.when(i % 3 == 0, "report").otherwise("request").alias("kind"), F.when((i % 3 == 0) & (i % 21 != 0), i % 9).alias("remaining"))
    rows.write.parquet(path)
    return _streamed(spark, ingest.gated(spark.readStream.schema(rows.schema).parquet(path)))


#: Micro-batches of a stream made of a table: each costs a task for every partition of the state, however few its rows, so
#: that their number must not grow with the table. Rows of one of its files, about.
BATCHES, FILE_ROWS = 4, 100_000


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stateful stream gives for the files that are there."""
    key, out = "spark.sql.streaming.stateStore.providerClass", new_folder(spark, "streamed")
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("select 'o/r' || k.conv_id % 2 as repo, k.conv_id as number, 'C' || k.conv_id || '-' || k.turn as node_id, 'I' || k.conv_id as parent, 'resolved' as state from conversations k where k.turn > 0 and exists (select 1 from conversations p where p.conv_id = k.conv_id and p.turn = 0 and p.conv_id % 11 <> 0)")
def waiting_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of a stream wait for their issue, which may come later; every eleventh one never comes."""
    c, i, path = t(spark, sf_dir, "conversations"), F.col("conv_id"), new_folder(spark, "thread-rows")
    node = F.when(F.col("turn") == 0, F.concat(F.lit("I"), i)).otherwise(F.concat(F.lit("C"), i, F.lit("-"), "turn"))
    rows = c.filter((F.col("turn") > 0) | (i % 11 != 0)).select(F.concat(F.lit("o/r"), i % 2).alias("repo"), i.alias("number"), F.when(F.col("turn") == 0, "issue").otherwise("comment").alias("kind"), node.alias("node_id"), F.lit("2024-02-01").cast("timestamp").alias("at"), F.col("turn").alias("t"))
    files = BATCHES * -(-max(1, rows.count()) // (BATCHES * FILE_ROWS))
    rows.repartitionByRange(files, F.col("t").desc(), "node_id").drop("t").write.parquet(path)
    stream = spark.readStream.schema(rows.drop("t").schema).option("maxFilesPerTrigger", files // BATCHES).parquet(path)
    return _streamed(spark, waiting.with_parents(stream))


@query("select event_id, case when event_id % 13 = 0 then 'bootstrap_required' when event_id % 100 <= 20 and event_id % 7 <> 0 then 'fresh' when event_id % 1000 > 500 then 'cooldown' when event_id % 3 = 0 then 'sync_busy' else 'eligible' end as state from events")
def plan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", D.plan_state(i % 13 != 0, i % 100, F.lit(20), i % 7 != 0, i % 1000, i % 3 == 0, F.lit(500)).alias("state"))


@query("select event_id, case when event_id - 5 <= 0 then 'none' when event_id - 5 <= 100 then 'low' when event_id - 5 <= 1000 then 'medium' else 'high' end as cost from events")
def cost_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", D.cost_class(i - 5).alias("cost"))


@query("select event_id, coalesce(case when event_id % 3 = 0 then event_id * 2 end, event_id + greatest(event_id % 600 - 100, 0)) as deadline from events")
def backoff_deadline_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", times.sync_deadline(F.when(i % 3 == 0, i * 2), i, i % 600 - 100).alias("deadline"))


@query("select event_id, greatest(case when event_id % 3 = 0 then event_id * 2 end, event_id + least(greatest(event_id * 31 - 5000, 0), 86400)) as deadline from events")
def backoff_deadline_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", times.schedule_deadline(F.when(i % 3 == 0, i * 2), i, i * 31 - 5000).alias("deadline"))


@query("""with r as (select page_id, (page_id % 50) || (case page_id % 7 when 0 then 's' when 1 then 'm' when 2 then 'h' when 3 then 'd' when 4 then 'mo' when 5 then 'x' else '' end) as said from pages) select page_id, said, case when regexp_matches(said, '^[0-9]+(s|m|h|d|mo)$') and regexp_extract(said, '^([0-9]+)', 1)::bigint > 0 then regexp_extract(said, '^([0-9]+)', 1)::bigint * case regexp_extract(said, '([a-z]+)$', 1) when 's' then 1 when 'm' then 60 when 'h' then 3600 when 'd' then 86400 else 2592000 end end as seconds from r""")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    unit = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "mo", "x", ""))), (p % 7 + 1).cast("int"))
    rows = t(spark, sf_dir, "pages").select("page_id", F.concat((p % 50).cast("string"), unit).alias("said"))
    return rows.withColumn("seconds", times.duration_seconds(F.col("said")))


_HOSTS = (("Host0", "open", "p000030"), ("host1", "unknown", None), ("host2", "cooldown", None), ("host3", "busy", "p000050"))


@query(f"""with h(host, host_state, cursor) as (values {", ".join(f"({h.lower()!r}, {st!r}, {'null' if c is None else repr(c)})" for h, st, c in _HOSTS)}),
    p as (select distinct 'HOST' || (user_id % 4) as host, 'p' || lpad(user_id::varchar, 6, '0') as profile, case when user_id % 5 = 0 then 'fresh' when user_id % 7 = 0 then 'sync_busy' else 'eligible' end as state from events),
    k as (select p.*, host_state, case when lower(p.host) > 'host1' then 0 else 1 end as round, case when cursor is null or profile > cursor then 0 else 1 end as after, state <> 'fresh' as able from p join h on h.host = lower(p.host)),
    w as (select *, case when able then case when host_state = 'busy' then 'host_busy' when host_state = 'cooldown' then 'host_cooldown' when host_state = 'unknown' and row_number() over (partition by host, able order by after, profile) > 1 then 'unknown_budget_limit' end end as why from k),
    c as (select *, row_number() over (order by round, lower(host), after, profile) as turn, sum(case when able and why is null then 1 else 0 end) over (order by round, lower(host), after, profile) as tried from w)
    select host, profile, turn, able and why is null and tried <= 8 as attempted, case when able and why is null and tried > 8 then 'pass_limit' else why end as reason from c""")
def rotate_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over the profiles of all users on four hosts, the second of which was served last."""
    u = F.col("user_id")
    state = F.when(u % 5 == 0, "fresh").when(u % 7 == 0, "sync_busy").otherwise("eligible")
    p = _e(spark, sf_dir).select(F.concat(F.lit("HOST"), (u % 4).cast("string")).alias("host"), F.concat(F.lit("p"), F.lpad(u.cast("string"), 6, "0")).alias("profile"), state.alias("state")).distinct()
    hosts = spark.createDataFrame(_HOSTS, "host string, state string, cursor string")
    return D.schedule_pass(p, hosts, "host1").select("host", "profile", "turn", "attempted", "reason")


_STATUSES = (200, 304, 301, 401, 403, 404, 410, 429, 500, 418, None)
_BODIES = ("You have exceeded a secondary rate limit", "Resource not accessible by integration", "Forbidden", "Must have admin rights", "SAML enforcement", None, "abuse detection", "Permission denied")
_CLASS = """case when status between 200 and 299 then 'ok' when status between 300 and 399 then 'redirect'
        when status = 429 or (status = 403 and (remaining = 0 or retry is not null or contains(body, 'rate limit') or contains(body, 'abuse detection'))) then 'backoff' when status = 401 then 'auth' when status = 404 then 'permission'
        when status = 403 and (contains(body, 'resource not accessible') or contains(body, 'permission denied') or contains(body, 'must have')) then 'permission' when status = 403 then 'ambiguous' when status = 410 and {source} then 'gone' else 'transient' end"""
_RESPONSES = f"""r as (select event_id, {_picked(_STATUSES, "event_id")} as status, coalesce(lower({_picked(_BODIES, "event_id // 11")}), '') as body, nullif(event_id % 5, 4) as remaining, case when event_id % 13 = 0 then event_id % 7 - 2 end as retry, case when event_id % 6 <> 0 then event_id % 100 end as reset_at from events)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", _pick(_STATUSES, i).alias("status"), _pick(_BODIES, F.expr("event_id div 11")).alias("body"), F.nullif(i % 5, F.lit(4)).alias("remaining"), F.when(i % 13 == 0, i % 7 - 2).alias("retry"), F.when(i % 6 != 0, i % 100).alias("reset_at"))


@query(f"with {_RESPONSES} select event_id, {_CLASS.format(source='true')} as of_source, {_CLASS.format(source='false')} as of_repo from r")
def response_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda target: D.response_class(F.col("status"), F.col("remaining"), F.col("retry"), F.col("body"), target)
    return _responses(spark, sf_dir).select("event_id", of("source").alias("of_source"), of("repo").alias("of_repo"))


@query(f"""with {_RESPONSES}, b as (select *, remaining is not null and remaining = 0 as is_primary from r where {_CLASS.format(source='true')} = 'backoff'),
    w as (select event_id, case when is_primary then 'primary_rate_limit' else 'secondary_rate_limit' end as reason, case when is_primary then case when reset_at is null then 60 else greatest(reset_at - 40, 0) end else case when retry is null then 60 else greatest(retry, 0) end end::bigint as seconds, case when is_primary then reset_at end as reset_at from b)
    select *, case when coalesce(reset_at, 40 + seconds) <= 70 then 'now' else 'later' end as retry from w""")
def backoff_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a response that asks to wait, at second 40, and what it means at second 70."""
    limited = _responses(spark, sf_dir).filter(D.response_class(F.col("status"), F.col("remaining"), F.col("retry"), F.col("body")) == "backoff")
    made = limited.select("event_id", D.backoff(F.col("status"), F.col("remaining"), F.col("reset_at"), F.col("retry"), F.lit(40)).alias("b")).select("event_id", "b.*")
    return made.withColumn("retry", D.retry_action(times.sync_deadline(F.col("reset_at"), F.lit(40), F.col("seconds")), F.lit(70)))


_FIRST = (("ok", 200), ("permission", 404), ("permission", 403), ("gone", 410), ("auth", 401), ("ambiguous", 403), ("transient", 500), ("backoff", 429), ("redirect", 301))
_SECOND = ("ok", "permission", "auth", "ambiguous", "transient", "backoff", "redirect")
#: Every pair of answers with its decision, as a table: a denied source, then its repository.
_TABLE = {("permission", 404): ("deleted", "permission_loss", "auth", "ambiguous", "transient", "backoff", "transient"), ("permission", 403): ("ambiguous", "permission_loss", "auth", "ambiguous", "transient", "backoff", "transient"), ("gone", 410): ("deleted", "permission_loss", "auth", "ambiguous", "transient", "backoff", "transient")}
_ALONE = {"ok": "active", "auth": "auth", "ambiguous": "ambiguous", "transient": "transient", "backoff": "backoff", "redirect": "transient"}
_DECISIONS = "decisions(first, first_status, second, decision) as (values " + ", ".join(repr((f, n, s, _TABLE[f, n][k] if (f, n) in _TABLE else _ALONE[f])) for f, n in _FIRST for k, s in enumerate(_SECOND)) + ")"


def _probed(i):
    return _pick([f for f, _ in _FIRST], i), _pick([n for _, n in _FIRST], i)


@query(f"with {_DECISIONS} select event_id, decision from events join decisions on first = {_picked([f for f, _ in _FIRST], 'event_id')} and first_status = {_picked([n for _, n in _FIRST], 'event_id')} and second = {_picked(_SECOND, 'event_id // 9')}")
def denial_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _e(spark, sf_dir).select("event_id", D.denial(*_probed(i), _pick(_SECOND, F.expr("event_id div 9"))).alias("decision"))


@query(f"""with {_DECISIONS}, last_ as (select max(event_id) - 50 as stop_at from events),
    r as (select user_id as repo, event_id as position, case when event_id = stop_at then 7 else event_id % 4 end as f, case when event_id % 37 = 0 then 1 else 0 end as s from events, last_),
    d as (select r.*, decision from r join decisions on first = {_list([f for f, _ in _FIRST])}[f + 1] and first_status = {_list([n for _, n in _FIRST])}[f + 1] and second = {_list(_SECOND)}[s + 1]),
    l as (select *, min(case when decision = 'permission_loss' then position end) over (partition by repo) as lost from d),
    x as (select *, coalesce(position > lost, false) as skipped from l), z as (select *, min(case when decision in ('auth', 'backoff', 'ambiguous', 'transient') and not skipped then position end) over () as stop from x)
    select repo, position, case when coalesce(position > stop, false) then 'not_reached' when skipped then 'skipped' else decision end as decision from z""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over all events; near its end a response asks to wait."""
    i, e = F.col("event_id"), _e(spark, sf_dir)
    rows = e.crossJoin(F.broadcast(e.agg((F.max("event_id") - 50).alias("at"))))  # one row
    first = F.when(i == F.col("at"), 7).otherwise(i % 4)
    f, n = _probed(first)
    probes = rows.select(F.col("user_id").alias("repo"), i.alias("position"), f.alias("first"), n.alias("first_status"), _pick(_SECOND, F.when(i % 37 == 0, 1).otherwise(0)).alias("second"))
    return D.reconcile(probes).select("repo", "position", "decision")


@query("""with i as (select doc_id as source_id, case when doc_id % 9 = 0 then 'not_found' else 'ok' end as status from documents), p as (select doc_id as source_id, ['active', 'deleted', 'permission_loss', 'auth', 'transferred', 'transient'][doc_id % 6 + 1] as said from documents where doc_id % 5 <> 0),
    j as (select i.*, said, status = 'ok' and coalesce(said in ('deleted', 'permission_loss', 'transferred'), false) as gone from i left join p using (source_id))
    select source_id, case when gone then 'tombstoned' else status end as status, case when status = 'ok' and said = 'active' then 'active' when status = 'ok' and not gone then 'not_checked' end as remote, status = 'ok' and (gone or coalesce(said = 'active', false)) as remote_checked from j""")
def verified_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A get that asks the host about what it found; a confirmed loss is a tombstone."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    i = F.col("source_id")
    said = _pick(("active", "deleted", "permission_loss", "auth", "transferred", "transient"), i)
    return D.verified(d.withColumn("status", F.when(i % 9 == 0, "not_found").otherwise("ok")), d.filter(i % 5 != 0).withColumn("decision", said)).select("source_id", "status", "remote", "remote_checked")


@query("select source, least(case when min(doc_id) % 3 <> 0 then 5 end, min(doc_id) filter (doc_id % 7 <> 0)) as oldest, sum(doc_id % 3)::bigint as purged_sources, sum(doc_id % 2)::bigint as purged_issues, coalesce(sum(case when doc_id % 4 = 0 then 1 end), 0)::bigint as purged_comments from documents group by source")
def reach_and_purges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far back each repository reaches, and what its purges removed."""
    i = F.col("doc_id")
    d = t(spark, sf_dir, "documents").select("source", i, (i % 3).alias("purged_sources"), (i % 2).alias("purged_issues"), F.when(i % 4 == 0, 1).alias("purged_comments"))
    found = d.groupBy("source").agg(F.min(i).alias("first"), F.min(F.when(i % 7 != 0, i)).alias("found")).join(D.purge_totals(d, "source"), "source")
    return found.select("source", D.oldest_active(F.when(F.col("first") % 3 != 0, F.lit(5).cast("long")), F.col("found")).alias("oldest"), "purged_sources", "purged_issues", "purged_comments")


@query("select page_id, (('0x' || substr(sha256(url), 1, 16))::uhugeint % 15)::bigint * 60 as jitter from pages")
def schedule_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", times.jitter_seconds(F.array("url")).alias("jitter"))


@query("select event_id, epoch_us(ts)::bigint // 1000000 as then_s, greatest(0, 1800000000 - epoch_us(ts)::bigint // 1000000)::bigint as age, (greatest(0, 1800000000 - epoch_us(ts)::bigint // 1000000) // 86400)::bigint as days, strftime(make_timestamp(epoch_us(ts)::bigint // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') as said from events")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, ts = F.timestamp_seconds(F.lit(1800000000)), F.col("ts").cast("timestamp")
    return _e(spark, sf_dir).select("event_id", times.seconds(ts).alias("then_s"), times.age_seconds(now, ts).alias("age"), times.age_days(now, ts).alias("days"), times.rfc3339(times.seconds(ts)).alias("said"))


@query("select case when blocked then 'blocked' when n = 0 then 'not ready' else 'ready' end as readiness, source from (select source, count(*) filter (doc_id % 2 = 0) as n, bool_or(doc_id % 331 = 7) as blocked from documents group by source)")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    s = t(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(d % 2 == 0).alias("n"), F.bool_or(d % 331 == 7).alias("blocked"))
    return s.select(D.readiness(F.col("blocked"), F.when(F.col("n") == 0, "never_synced").otherwise("fresh")).alias("readiness"), "source")
