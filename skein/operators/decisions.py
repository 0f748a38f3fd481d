"""Decision ladders over state rows, each a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import response_reason
from skein.plans.storage import written


def freshness(age: Column, max_age: Column, open_results: Column, open_max_age: Column, fails: Column) -> Column:
    """struct(decision, max_age, warnings): decision is never_synced, fresh, stale_warn or stale_fail. One
    age is held against the query's limit and, where open issues are in the result and they have a
    limit, against theirs too; the lesser limit is reported. ``fails``: staleness is an error, not a
    warning (the policy says so, or the caller requires fresh data)."""
    fails, open_results = F.coalesce(fails, F.lit(False)), F.coalesce(open_results, F.lit(False))
    older, older_open = F.coalesce(age > max_age, F.lit(False)), F.coalesce(open_results & (age > open_max_age), F.lit(False))
    stale = older | older_open
    decision = F.when(age.isNull(), "never_synced").when(~stale, "fresh").when(fails, "stale_fail").otherwise("stale_warn")
    said = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.when(fails, "fail").otherwise(severity).alias("severity")))
    warnings = F.array_compact(F.array(said(age.isNull(), "never_synced", "warn_strong"), said(older, "query_snapshot_stale", "warn"), said(older_open, "active_issue_snapshot_stale", "warn_strong")))
    return F.struct(decision.alias("decision"), F.when(open_results, F.least(max_age, open_max_age)).otherwise(max_age).alias("max_age"), warnings.alias("warnings"))


def oldest_active(recorded: Column, found: Column) -> Column:
    """How far back a corpus reaches: the recorded time only ever moves backward."""
    return F.least(recorded, found)


def purge_totals(outcomes: DataFrame, *by: str) -> DataFrame:
    """What the purges of a run removed: one row, or one for each value of ``by``."""
    return outcomes.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("purged_sources", "purged_issues", "purged_comments")))


def oldest_sync(repos: DataFrame) -> DataFrame:
    """One row: the oldest successful sync over repos; null if one never had any."""
    return repos.agg(F.when(F.count_if(F.col("synced_at").isNull()) == 0, F.min("synced_at")).alias("oldest_sync"))


def scope_fingerprint(names: Column) -> Column:
    """A digest of trimmed, lower-case, distinct names in order, each with its length."""
    clean = F.array_sort(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n)))))
    return F.sha2(F.array_join(F.transform(clean, lambda n: F.concat(F.octet_length(n).cast("string"), F.lit(":"), n)), ""), 256)


def coverage(open_done: Column, history_done: Column, recorded_scope: Column, scope: Column) -> Column:
    return F.when(open_done & history_done & recorded_scope.eqNullSafe(scope), "complete").otherwise("partial")


def coverage_warning(state: Column, results: Column, route: Column) -> Column:
    """Whether to say that an empty result may be due to missing sources."""
    return (state == "partial") & (results == 0) & (route != "exact")


def next_action(open_done: Column, history_done: Column) -> Column:
    return F.when(~open_done, "sync_open").when(~history_done, "backfill_history").otherwise("none")


def embedding_coverage(chunks: DataFrame, staged: DataFrame, fingerprint: str, by: list[str]) -> DataFrame:
    """Per group of chunks (``by``, chunk_id): total, completed, missing and mismatched ones, by whether
    ``staged`` (chunk_id, fingerprint) has them under the configured ``fingerprint`` or another."""
    own = staged.groupBy("chunk_id").agg(F.bool_or(F.col("fingerprint") == fingerprint).alias("own"))
    known = chunks.join(own, "chunk_id", "left")
    counts = (F.count("*").alias("total"), F.count_if("own").alias("completed"), F.count_if(~F.coalesce("own", F.lit(False))).alias("missing"), F.count_if(~F.col("own")).alias("mismatched"))
    return known.groupBy(*by).agg(*counts)


def embedding_state(corrupt: Column, active: Column, matches: Column, missing: Column, mismatched: Column) -> Column:
    """``active``: there is an active generation or fingerprint; ``matches``: it is the configured one."""
    other = F.lit("fingerprint_mismatch")
    return F.when(corrupt, "corrupt").when(~matches & (mismatched > 0), other).when(~active, "missing").when(~matches, other).when(missing == 0, "complete").otherwise("partial")


def hybrid_ready(corrupt: Column, matches: Column, total: Column, missing: Column) -> Column:
    return ~corrupt & matches & (total > 0) & (missing == 0)


def embedding_repair(state: Column) -> Column:
    return F.when(state == "complete", "none").when(state.isin("corrupt", "fingerprint_mismatch"), "rebuild").otherwise("embed_missing")


def same_fingerprint(left: Column, right: Column, fields: tuple[str, ...]) -> Column:
    """Equal in every field; two missing values are equal."""
    out = F.lit(True)
    for f in fields:
        out = out & left[f].eqNullSafe(right[f])
    return out


def response_class(status: Column, remaining: Column, retry_after: Column, body: Column, target: str = "source") -> Column:
    """What a response says about its request: ok, redirect, backoff, auth, permission (a candidate for a
    loss of permission), gone, transient or ambiguous. A null status is a request that got no answer.
    Only a source can be gone; an unexpected status is no evidence, so it is transient."""
    reason = response_reason(body)
    limited = (status == 429) | ((status == 403) & ((remaining == 0) | retry_after.isNotNull() | (reason == "rate_limited")))
    return (
        F.when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect")
        .when(F.coalesce(limited, F.lit(False)), "backoff").when(status == 401, "auth")
        .when((status == 404) | ((status == 403) & (reason == "permission")), "permission")
        .when(status == 403, "ambiguous").when((status == 410) & F.lit(target == "source"), "gone").otherwise("transient")
    )


def backoff(status: Column, remaining: Column, reset_at: Column, retry_after: Column, now: Column) -> Column:
    """struct(reason, seconds, reset_at) to record for a response of class backoff; times in seconds."""
    primary = F.coalesce(remaining == 0, F.lit(False)) & status.isin(403, 429)
    given = F.when(primary, reset_at - now).otherwise(retry_after)
    wait = F.when(given.isNull(), 60).otherwise(F.greatest(F.lit(0), given)).cast("bigint")
    return F.struct(F.when(primary, "primary_rate_limit").otherwise("secondary_rate_limit").alias("reason"), wait.alias("seconds"), F.when(primary, reset_at).alias("reset_at"))


def retry_action(deadline: Column, now: Column) -> Column:
    """now, later, or unknown where no time can be told."""
    return F.when(deadline.isNull(), "unknown").when(deadline <= now, "now").otherwise("later")


def denial(first: Column, first_status: Column, second: Column) -> Column:
    """What a source's response class (with its status) and then its repository's together confirm:
    active, deleted, permission_loss, ambiguous, auth, backoff or transient. Only a repository that is
    itself denied in the way of lost permission is lost; a failed login, a plain 403, a rate limit or
    an unexpected answer of it destroys nothing. A 403 of the source alone never means deletion."""
    evidence = first.isin("permission", "gone")
    confirmed = (
        F.when(second == "permission", "permission_loss")
        .when(second == "ok", F.when((first == "permission") & (first_status == 403), "ambiguous").otherwise("deleted"))
        .when(second.isin("auth", "backoff", "ambiguous"), second).otherwise("transient")
    )
    return F.when(evidence, confirmed).when(first == "ok", "active").when(first.isin("auth", "backoff", "ambiguous"), first).otherwise("transient")


#: Decisions that end a walk over candidates.
INTERRUPTIONS = ("auth", "backoff", "ambiguous", "transient")


def reconcile(probes: DataFrame) -> DataFrame:
    """probes (repo, position, source_id, first, first_status, second: response classes) in order of
    position: the decision for each candidate; skipped once its repository is lost, and not reached
    after the first interruption over all. Neither needs a sort: both are least positions."""
    decided = probes.withColumn("decision", denial(F.col("first"), F.col("first_status"), F.col("second")))
    lost = decided.filter("decision = 'permission_loss'").groupBy("repo").agg(F.min("position").alias("skein_lost"))
    known = decided.join(lost, "repo", "left")
    skipped = F.coalesce(F.col("position") > F.col("skein_lost"), F.lit(False))
    stop = known.filter(F.col("decision").isin(*INTERRUPTIONS) & ~skipped).agg(F.min("position").alias("skein_stop"))
    final = F.when(F.col("position") > F.col("skein_stop"), "not_reached").when(skipped, "skipped").otherwise(F.col("decision"))
    return known.crossJoin(F.broadcast(stop)).withColumn("decision", final).drop("skein_lost", "skein_stop")  # stop: one row


def verified(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items of a get (source_id, status, ...) with what a remote check adds: remote (active,
    not_checked, or null where the item is no source) and remote_checked; a confirmed loss makes the
    item tombstoned. probes: source_id, decision. A source without a probe has no candidate."""
    known = items.join(probes.select("source_id", F.col("decision").alias("skein_said")), "source_id", "left")
    ok, said = F.col("status") == "ok", F.col("skein_said")
    gone = ok & said.isin("deleted", "permission_loss", "transferred")
    remote = F.when(ok & (said == "active"), "active").when(ok & ~F.coalesce(gone, F.lit(False)), "not_checked")
    checked = F.coalesce(ok & said.isin("active", "deleted", "permission_loss", "transferred"), F.lit(False))
    return known.withColumns({"status": F.when(gone, "tombstoned").otherwise(F.col("status")), "remote": remote, "remote_checked": checked}).drop("skein_said")


def purge_target(decision: Column, entity: Column) -> Column:
    return F.when(decision == "permission_loss", "repo").when((decision == "deleted") & (entity == "issue"), "thread").when(decision == "deleted", "source")


def rate_state(limit: Column, remaining: Column, reset_at: Column, observed_at: Column, now: Column, old_after: int = 300) -> Column:
    """stale: too old, from the future, or past its reset; partial: a figure is missing; else fresh."""
    stale = (now - observed_at > old_after) | (observed_at > now) | (reset_at.isNotNull() & (reset_at <= now))
    return F.when(stale, "stale").when(limit.isNull() | remaining.isNull() | reset_at.isNull(), "partial").otherwise("fresh")


def allowance(limit: Column, remaining: Column) -> Column:
    """Requests that may be made without touching the reserve of a fifth; none if the figures make no
    sense together, null if one is missing."""
    broken = (limit < 0) | (remaining < 0) | (remaining > limit)
    known = limit.isNotNull() & remaining.isNotNull()
    return F.when(known & broken, F.lit(0)).when(known, F.greatest(F.lit(0), remaining - F.ceil(limit / 5))).cast("bigint")


def conservative_budget(observations: DataFrame, by: list[str], now: Column) -> DataFrame:
    """Of each group's fresh observations of the core resource (resource, limit, remaining, reset_at,
    observed_at, position) that with the least allowance, the first of equal ones."""
    fresh = (F.col("resource") == "core") & (rate_state(F.col("limit"), F.col("remaining"), F.col("reset_at"), F.col("observed_at"), now) == "fresh")
    value = F.struct(allowance(F.col("limit"), F.col("remaining")).alias("allowance"), "position", "observed_at")
    return observations.filter(fresh).groupBy(*by).agg(F.min(value).alias("v")).select(*by, "v.allowance", "v.position", "v.observed_at")


#: What a budget gate says to a request that it does not let through.
RESERVE, UNKNOWN = "rate_budget_reserve", "unknown_budget_limit"


def request_gate(events: Column, known: Column | None = None) -> Column:
    """events: array<struct<kind: request or report, left: bigint>> in order -> for each request
    "admitted" or why not. ``known``: requests that may be made, if that is known before. An unknown
    budget lets one probe through. A report never raises what is known; one without a figure blocks,
    and what is blocked stays so."""
    left = F.lit(None).cast("bigint") if known is None else known.cast("bigint")
    start = F.struct(F.lit("").alias("blocked"), left.alias("left"), F.lit(False).alias("probed"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        report = e["kind"] == "report"
        free, unknown = s["blocked"] == "", s["left"].isNull()
        passes = free & F.when(unknown, ~s["probed"]).otherwise(s["left"] > 0)
        blocked = (
            F.when(~free, s["blocked"]).when(report, F.when(e["left"].isNull(), UNKNOWN).otherwise(""))
            .when(passes, "").when(unknown, UNKNOWN).otherwise(RESERVE)
        )
        now = F.when(report, F.least(s["left"], e["left"])).when(passes, s["left"] - 1).otherwise(s["left"])
        said = F.when(passes, "admitted").otherwise(blocked)
        return F.struct(blocked.alias("blocked"), now.alias("left"), (s["probed"] | (~report & passes & unknown)).alias("probed"), F.when(report, s["out"]).otherwise(F.concat(s["out"], F.array(said))).alias("out"))

    return F.aggregate(events, start, step, lambda s: s["out"])


def plan_state(bootstrapped: Column, age: Column, max_age: Column, artifact_ok: Column, backoff_until: Column, busy: Column, now: Column) -> Column:
    """Fresh needs a usable index too."""
    return F.when(~bootstrapped, "bootstrap_required").when((age <= max_age) & artifact_ok, "fresh").when(backoff_until > now, "cooldown").when(busy, "sync_busy").otherwise("eligible")


def schedule_pass(profiles: DataFrame, hosts: DataFrame, host_cursor: str | None = None, most: int = 8) -> DataFrame:
    """profiles (host, profile, state) and hosts (host, state: open, busy, cooldown or unknown; cursor) ->
    profiles with ``turn``, ``attempted`` and ``reason``, why an eligible one is put off: host_busy,
    host_cooldown, unknown_budget_limit, pass_limit. Hosts go one after another, beginning after
    ``host_cursor``, and each host's profiles beginning after its cursor, both going round. A host of
    unknown budget gets one attempt, a pass ``most`` in all. Profiles are dealt by range; counts are
    taken inside the ranges and start from the ranges' totals, so no task goes over all profiles."""
    later = lambda value, cursor: F.when(cursor.isNull() | (value > cursor), 0).otherwise(1)
    at = hosts.select(F.lower("host").alias("skein_host"), F.col("state").alias("skein_state"), F.col("cursor").alias("skein_cursor"))
    known = profiles.withColumn("skein_host", F.lower("host")).join(at, "skein_host", "left")
    order = ["skein_round", "skein_host", "skein_after", "profile"]
    known = known.withColumns({"skein_round": later(F.col("skein_host"), F.lit(host_cursor and host_cursor.lower()).cast("string")), "skein_after": later(F.col("profile"), F.col("skein_cursor")), "skein_able": F.col("state").isin("eligible", "sync_busy")})
    firsts = known.filter("skein_able and skein_state = 'unknown'").groupBy("skein_host").agg(F.min(F.struct("skein_after", "profile")).alias("skein_first"))
    known = known.join(firsts, "skein_host", "left")
    probe = (F.col("skein_state") == "unknown") & (F.struct("skein_after", "profile") != F.col("skein_first"))
    why = F.when(F.col("skein_able"), F.when(F.col("skein_state") == "busy", "host_busy").when(F.col("skein_state") == "cooldown", "host_cooldown").when(probe, UNKNOWN))
    known = known.withColumn("skein_why", why).withColumn("skein_tries", F.when(F.col("skein_able") & F.col("skein_why").isNull(), 1).otherwise(0))
    ranged = written(known.repartitionByRange(*order).withColumn("skein_part", F.spark_partition_id()), "profiles")
    totals = ranged.groupBy("skein_part").agg(F.count("*").alias("n"), F.sum("skein_tries").alias("tries"))  # a row per range
    earlier = Window.orderBy("skein_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("skein_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"skein_{c}_before") for c in ("n", "tries")))
    turn = Window.partitionBy("skein_part").orderBy(*order)
    sized = ranged.join(F.broadcast(before), "skein_part").withColumn("turn", (F.col("skein_n_before") + F.row_number().over(turn)).cast("long"))
    tried = F.col("skein_tries_before") + F.sum("skein_tries").over(turn)
    done = sized.withColumn("attempted", (F.col("skein_tries") == 1) & (tried <= most))
    reason = F.when((F.col("skein_tries") == 1) & ~F.col("attempted"), "pass_limit").otherwise(F.col("skein_why"))
    return done.withColumn("reason", reason).select(*profiles.columns, "turn", "attempted", "reason")


def skip_if_fresh(age: Column, max_age: Column, artifact_ok: Column) -> Column:
    return max_age.isNotNull() & (age <= max_age) & artifact_ok


def schedule_outcome(attempted: Column, error: Column) -> Column:
    return F.when(~attempted, "deferred").when(error.isNull(), "completed").when(error.isin("backoff", "busy"), "deferred").otherwise("failed")


def readiness(blocked: Column, freshness_decision: Column) -> Column:
    """``blocked``: a purge is pending, or a warning stops retrieval."""
    return F.when(blocked, "blocked").when(freshness_decision == "never_synced", "not ready").otherwise("ready")


def search_mode(embedding: Column) -> Column:
    return F.when(embedding == "complete", "hybrid").otherwise("bm25")


def reconciliation_stale(policy_seconds: Column, last_age: Column) -> Column:
    return policy_seconds.isNotNull() & (last_age.isNull() | (last_age > policy_seconds))


def cost_class(requests: Column) -> Column:
    return F.when(requests <= 0, "none").when(requests <= 100, "low").when(requests <= 1000, "medium").otherwise("high")


def resource_gates(tier: str) -> dict[str, Column]:
    """Gate -> condition over warm_p95, cold_p95 (s), rss, snapshot (MiB), chunks_per_s, growth (KiB per
    chunk), fingerprints."""
    light = tier == "light"
    gates = {"warm_p95": F.col("warm_p95") <= 1.5, "cold_p95": F.col("cold_p95") <= (5.0 if light else 10.0), "rss": F.col("rss") <= (1024.0 if light else 2560.0), "throughput": F.col("chunks_per_s") >= (10.0 if light else 3.0), "one_chunker": F.col("fingerprints") == 1}
    return gates | ({"snapshot": F.col("snapshot") <= 500.0, "growth": F.col("growth") <= 3.0} if light else {})
