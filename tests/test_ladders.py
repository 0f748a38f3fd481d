"""Decision ladders as tables of literal cases: what goes in, what must come out."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import times
from skein.operators import decisions as D


def rows(spark, schema, cases):
    """Cases (inputs..., wanted) as a table with a column ``want``."""
    return spark.createDataFrame(cases, schema)


def check(df, made):
    got = [(r["want"], r["got"], r) for r in df.withColumn("got", made).collect()]
    assert [(w, r) for w, g, r in got if w != g] == []


def test_response_classes(spark):
    cases = [
        (200, None, None, None, "ok"), (204, None, None, None, "ok"), (301, None, None, None, "redirect"), (304, None, None, None, "redirect"),
        (429, 5, None, None, "backoff"), (429, 0, None, None, "backoff"), (403, 0, None, None, "backoff"), (403, 5, 30, None, "backoff"), (403, 5, None, "API Rate Limit exceeded", "backoff"), (403, 5, None, "abuse detection mechanism", "backoff"),
        (401, 0, None, "permission denied", "auth"), (403, 5, None, "Resource not accessible by integration", "permission"), (403, 5, None, "You MUST HAVE admin rights", "permission"), (403, 5, None, "does not have permission", "permission"),
        (403, 5, None, "Forbidden", "ambiguous"), (403, 5, None, "SAML enforcement", "ambiguous"), (403, 5, None, "permission", "ambiguous"), (403, None, None, None, "ambiguous"),
        (404, None, None, None, "permission"), (404, 0, None, None, "permission"), (410, None, None, None, "gone"), (500, None, None, None, "transient"), (503, 0, 5, None, "transient"), (418, None, None, None, "transient"), (None, None, None, None, "transient"),
    ]
    df = rows(spark, "status int, remaining int, retry int, body string, want string", cases)
    args = (F.col("status"), F.col("remaining"), F.col("retry"), F.col("body"))
    check(df, D.response_class(*args))
    check(rows(spark, "status int, remaining int, retry int, body string, want string", [(410, None, None, None, "transient"), (404, None, None, None, "permission"), (200, None, None, None, "ok")]), D.response_class(*args, target="repo"))


def test_denials(spark):
    """A failed login, a plain 403, a 410 or a rate limit of the repository never purges it."""
    cases = [
        ("ok", 200, "permission", "active"), ("permission", 404, "ok", "deleted"), ("gone", 410, "ok", "deleted"), ("permission", 403, "ok", "ambiguous"),
        ("permission", 404, "permission", "permission_loss"), ("permission", 403, "permission", "permission_loss"), ("gone", 410, "permission", "permission_loss"),
        ("permission", 404, "auth", "auth"), ("permission", 404, "ambiguous", "ambiguous"), ("permission", 404, "backoff", "backoff"), ("permission", 404, "transient", "transient"), ("permission", 404, "redirect", "transient"), ("gone", 410, "gone", "transient"),
        ("permission", 404, None, "transient"), ("auth", 401, "permission", "auth"), ("ambiguous", 403, "permission", "ambiguous"), ("backoff", 429, "permission", "backoff"), ("transient", 500, "permission", "transient"), ("redirect", 301, "permission", "transient"),
    ]
    check(rows(spark, "first string, status int, second string, want string", cases), D.denial(F.col("first"), F.col("status"), F.col("second")))


@pytest.mark.parametrize(("status", "body"), [(401, None), (403, "Forbidden"), (403, "rate limit"), (410, None), (500, None), (429, None)])
def test_no_such_answer_of_a_repository_purges(spark, status, body):
    second = D.response_class(F.lit(status), F.lit(5), F.lit(None).cast("int"), F.lit(body).cast("string"), "repo")
    for first, code in (("permission", 404), ("permission", 403), ("gone", 410)):
        said = spark.range(1).select(D.denial(F.lit(first), F.lit(code), second)).first()[0]
        assert said not in ("permission_loss", "deleted")


def test_reconciliation_walk(spark):
    cases = [
        ("a", 1, "ok", 200, "ok", "active"), ("b", 2, "permission", 404, "permission", "permission_loss"), ("b", 3, "transient", 500, None, "skipped"), ("a", 4, "permission", 404, "ok", "deleted"), ("b", 5, "ok", 200, "ok", "skipped"),
        ("a", 6, "auth", 401, None, "auth"), ("a", 7, "ok", 200, "ok", "not_reached"), ("b", 8, "ok", 200, "ok", "not_reached"), ("c", 9, "permission", 404, "permission", "not_reached"),
    ]
    made = D.reconcile(rows(spark, "repo string, position int, first string, first_status int, second string, want string", cases)).collect()
    assert {r["position"]: r["decision"] for r in made} == {c[1]: c[-1] for c in cases}


def test_freshness(spark):
    cases = [  # age, max_age, open, open_max, fails
        (None, 100, False, None, False, "never_synced", 100, ["never_synced"]), (None, 100, False, None, True, "never_synced", 100, ["never_synced"]), (100, 100, False, None, True, "fresh", 100, []),
        (101, 100, False, None, False, "stale_warn", 100, ["query_snapshot_stale"]), (101, 100, False, None, True, "stale_fail", 100, ["query_snapshot_stale"]), (60, 100, True, 50, False, "stale_warn", 50, ["active_issue_snapshot_stale"]),
        (60, 100, False, 50, False, "fresh", 100, []), (60, 100, True, None, False, "fresh", 100, []), (120, 100, True, 150, False, "stale_warn", 100, ["query_snapshot_stale"]), (200, 100, True, 150, True, "stale_fail", 100, ["query_snapshot_stale", "active_issue_snapshot_stale"]),
    ]
    df = rows(spark, "age long, most long, opened boolean, open_most long, fails boolean, want string, limit long, codes array<string>", cases)
    f = D.freshness(F.col("age"), F.col("most"), F.col("opened"), F.col("open_most"), F.col("fails"))
    for r in df.select("*", f.alias("f")).collect():
        assert (r["f"]["decision"], r["f"]["max_age"], [w["code"] for w in r["f"]["warnings"]]) == (r["want"], r["limit"], r["codes"])
        assert all((w["severity"] == "fail") == r["fails"] for w in r["f"]["warnings"])


def test_embedding_states(spark):
    cases = [  # corrupt, active, matches, missing, mismatched
        (True, True, True, 0, 0, "corrupt"), (False, True, False, 5, 5, "fingerprint_mismatch"), (False, False, False, 5, 2, "fingerprint_mismatch"), (False, False, False, 5, 0, "missing"), (False, False, True, 0, 0, "missing"),
        (False, True, False, 0, 0, "fingerprint_mismatch"), (False, True, True, 0, 0, "complete"), (False, True, True, 1, 0, "partial"), (False, True, True, 1, 3, "partial"),
    ]
    check(rows(spark, "c boolean, a boolean, m boolean, missing int, mismatched int, want string", cases), D.embedding_state(*map(F.col, ("c", "a", "m", "missing", "mismatched"))))
    ready = [(False, True, 5, 0, True), (True, True, 5, 0, False), (False, False, 5, 0, False), (False, True, 0, 0, False), (False, True, 5, 1, False)]
    check(rows(spark, "c boolean, m boolean, total int, missing int, want boolean", ready), D.hybrid_ready(*map(F.col, ("c", "m", "total", "missing"))))


def test_readiness(spark):
    check(rows(spark, "b boolean, f string, want string", [(True, "fresh", "blocked"), (True, "never_synced", "blocked"), (False, "never_synced", "not ready"), (False, "stale_fail", "ready"), (False, None, "ready")]), D.readiness(F.col("b"), F.col("f")))


def test_plan_states(spark):
    cases = [(False, 1, True, None, False, "bootstrap_required"), (True, 10, True, 99, True, "fresh"), (True, 10, False, 99, True, "cooldown"), (True, 11, True, 99, True, "cooldown"), (True, 11, True, 50, True, "sync_busy"), (True, 11, True, None, False, "eligible")]
    check(rows(spark, "b boolean, age int, ok boolean, until int, busy boolean, want string", cases), D.plan_state(F.col("b"), F.col("age"), F.lit(10), F.col("ok"), F.col("until"), F.col("busy"), F.lit(50)))


def gate(spark, events, known=None):
    e = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).cast("bigint").alias("left")) for k, n in events))
    return spark.range(1).select(D.request_gate(e, None if known is None else F.lit(known))).first()[0]


def test_request_gate(spark):
    ask, ok, none, low = ("request", None), "admitted", D.UNKNOWN, D.RESERVE
    assert gate(spark, [ask, ask, ("report", 9), ask]) == [ok, none, none]  # one probe; then it stays blocked
    assert gate(spark, [ask, ("report", 2), ask, ask, ask, ask]) == [ok, ok, ok, low, low]
    assert gate(spark, [ask, ("report", None), ask, ("report", 50), ask]) == [ok, none, none]  # no figure blocks
    assert gate(spark, [ask, ("report", 3), ask, ("report", 50), ask, ask, ask]) == [ok, ok, ok, ok, low]  # never more
    assert gate(spark, [ask, ("report", 5), ("report", 1), ask, ask]) == [ok, ok, low]
    assert gate(spark, [ask, ask, ask], known=2) == [ok, ok, low]
    assert gate(spark, [ask], known=0) == [low]


def test_allowance(spark):
    cases = [(5000, 5000, 4000), (5000, 1000, 0), (5000, 1001, 1), (7, 7, 5), (10, 11, 0), (-1, 0, 0), (5, -1, 0), (0, 0, 0)]
    cases += [(None, 5, None), (5, None, None)]
    check(rows(spark, "l long, r long, want long", cases), D.allowance(F.col("l"), F.col("r")))


def test_conservative_budget_keeps_the_first_of_equals(spark):
    now = 1000
    obs = [("h", 1, "core", 100, 60, 2000, 990), ("h", 2, "core", 100, 50, 2000, 995), ("h", 3, "core", 50, 40, 2000, 999), ("h", 4, "search", 100, 1, 2000, 999), ("h", 5, "core", 100, 1, 2000, 100), ("h", 6, "core", 100, None, 2000, 999), ("h", 7, "core", 100, 1, 900, 999)]
    df = spark.createDataFrame(obs, "host string, position long, resource string, `limit` long, remaining long, reset_at long, observed_at long")
    assert [tuple(r) for r in D.conservative_budget(df, ["host"], F.lit(now)).collect()] == [("h", 30, 2, 995)]


def test_schedule_pass(spark):
    profiles = [("A.org", f"a{i}", "eligible") for i in range(4)] + [("b.org", f"b{i}", "eligible") for i in range(3)] + [("c.org", "c0", "eligible"), ("d.org", "d0", "sync_busy"), ("d.org", "d1", "fresh"), ("d.org", "d2", "eligible")]
    hosts = [("a.org", "open", "a1"), ("b.org", "unknown", None), ("c.org", "cooldown", None), ("d.org", "open", None)]
    made = D.schedule_pass(spark.createDataFrame(profiles, "host string, profile string, state string"), spark.createDataFrame(hosts, "host string, state string, cursor string"), "a.org", most=5).orderBy("turn").collect()
    assert [r["profile"] for r in made] == ["b0", "b1", "b2", "c0", "d0", "d1", "d2", "a2", "a3", "a0", "a1"]
    assert [r["profile"] for r in made if r["attempted"]] == ["b0", "d0", "d2", "a2", "a3"]
    assert {r["profile"]: r["reason"] for r in made if r["reason"]} == {"b1": D.UNKNOWN, "b2": D.UNKNOWN, "c0": "host_cooldown", "a0": "pass_limit", "a1": "pass_limit"}


def test_backoff_and_deadlines(spark):
    cases = [(403, 0, 1060, None, ("primary_rate_limit", 60, 1060)), (429, 0, 900, 5, ("primary_rate_limit", 0, 900)), (429, 0, None, 5, ("primary_rate_limit", 60, None)), (429, 3, 1060, 5, ("secondary_rate_limit", 5, None)), (403, 3, None, -5, ("secondary_rate_limit", 0, None)), (403, 3, None, None, ("secondary_rate_limit", 60, None))]
    df = rows(spark, "s int, left int, reset long, retry long, want struct<reason:string,seconds:bigint,reset_at:bigint>", cases)
    check(df, D.backoff(F.col("s"), F.col("left"), F.col("reset"), F.col("retry"), F.lit(1000)))
    one = spark.range(1).select(times.sync_deadline(F.lit(None).cast("int"), F.lit(100), F.lit(-5)), times.schedule_deadline(F.lit(90), F.lit(100), F.lit(-5)), D.retry_action(F.lit(None).cast("int"), F.lit(1)), D.retry_action(F.lit(1), F.lit(1)), D.retry_action(F.lit(2), F.lit(1))).first()
    assert tuple(one) == (100, 100, "unknown", "now", "later")


def test_verified_items(spark):
    items = spark.createDataFrame([("s1", "ok"), ("s2", "ok"), ("s3", "ok"), ("s4", "not_found"), ("s5", "ok")], "source_id string, status string")
    probes = spark.createDataFrame([("s1", "active"), ("s2", "deleted"), ("s3", "auth"), ("s4", "deleted")], "source_id string, decision string")
    got = {r["source_id"]: (r["status"], r["remote"], r["remote_checked"]) for r in D.verified(items, probes).collect()}
    assert got == {"s1": ("ok", "active", True), "s2": ("tombstoned", None, True), "s3": ("ok", "not_checked", False), "s4": ("not_found", None, False), "s5": ("ok", "not_checked", False)}


def test_sensitive_shapes(spark):
    cases = [("/home/x", True), ("/Users/x", True), ("/users/x", False), (r"C:\\Users\\x", True), (r"C:\Users\x", False), ("Authorization : x", True), ("author", False)]
    cases += [("ghp_" + "a" * 20, True), ("ghp_" + "a" * 19, False), ("github_pat_" + "a_" * 10, True), ("github_pat_ab", False), ("bearer abcdefghijk", False)]
    check(rows(spark, "x string, want boolean", cases), X.needs_redaction(F.col("x")))


def test_oldest_and_totals(spark):
    check(rows(spark, "a long, b long, want long", [(5, 7, 5), (7, 5, 5), (None, 5, 5), (5, None, 5), (None, None, None)]), D.oldest_active(F.col("a"), F.col("b")))
    df = spark.createDataFrame([(1, 2, 3), (4, None, 6)], "purged_sources long, purged_issues long, purged_comments long")
    assert tuple(D.purge_totals(df).first()) == (5, 2, 9)
    assert tuple(D.purge_totals(df.limit(0)).first()) == (0, 0, 0)
