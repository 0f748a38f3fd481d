import json

import pytest
from pyspark.sql import functions as F

from skein.plans.publish import Generations, Publication, Publications
from skein.sources import records
from skein.streaming.ingest import gated


def test_generation_is_sealed_and_published_once(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}")
    m = g.reserve("2024-01-01T00:00:00Z")
    spark.range(5).write.parquet(f"{g.path(m)}/rows")
    ready = g.seal(m, "2024-01-01T00:01:00Z")
    assert g.intact(ready.generation)
    assert g.reserve("2024-01-02T00:00:00Z").generation == ready.generation + 1
    p = Publications(spark, f"file://{tmp_path}")
    assert p.active() is None
    p.activate(Publication("p1", ready.generation, None, "run1"), None)
    with pytest.raises(RuntimeError):
        p.activate(Publication("p2", ready.generation, None, "run2"), None)
    p.activate(Publication("p2", ready.generation, None, "run2"), "p1")
    assert p.active().id == "p2"


def test_another_owner_cannot_seal(spark, tmp_path):
    from dataclasses import replace

    g = Generations(spark, f"file://{tmp_path}")
    m = g.reserve("2024-01-01T00:00:00Z")
    with pytest.raises(PermissionError):
        g.seal(replace(m, owner="someone"), "2024-01-01T00:01:00Z")


def page(endpoint, items, **more):
    return json.dumps({"endpoint": endpoint, "repo": "a/b", "host": "h.org", "page": 1, "status": 200, "etag": None, "link": None, "remaining": 10, "items": [json.dumps(i) for i in items], "fetched_at": "2024-01-01T00:00:00Z"} | more)


def test_pages_become_sources(spark, tmp_path):
    issue = {"node_id": "I_1", "id": 1, "number": 7, "title": "t", "body": None, "state": "open", "labels": [{"name": "bug"}], "updated_at": "2024-01-01T00:00:00Z", "html_url": "https://h.org/a/b/issues/7", "user": {"login": "ann"}}
    pull = issue | {"node_id": "P_1", "number": 8, "pull_request": {"url": "x"}, "updated_at": "2024-02-01T00:00:00Z"}
    comment = {"node_id": "C_1", "id": 5, "body": "hi", "issue_url": "https://h.org/repos/a/b/issues/7", "updated_at": "2024-01-02T00:00:00Z"}
    orphan = comment | {"node_id": "C_2", "issue_url": "https://h.org/repos/a/b/issues/99"}
    (tmp_path / "i").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "i/1.json").write_text(page("issues:a/b", [issue, pull]) + "\n" + page("issues:a/b", [], status=304) + "\n")
    (tmp_path / "c/1.json").write_text(page("repo-comments:a/b", [comment, orphan]) + "\n")
    cursors = spark.createDataFrame([], "endpoint string, etag string")
    pages = records.changed(records.landed(spark, f"file://{tmp_path}/i"), cursors)
    decoded = records.items(pages, records.ISSUE)
    assert decoded.agg(F.max("item.updated_at")).first()[0] == "2024-02-01T00:00:00Z"
    issues = records.issues(decoded)
    r = issues.first()
    assert issues.count() == 1
    assert (r["source_id"], r["body"], r["labels"], r["assignees"]) == ("skein://h.org/issue/I_1", "", ["bug"], [])
    good, deferred = records.comments(records.items(records.landed(spark, f"file://{tmp_path}/c"), records.COMMENT), issues)
    assert [x["parent_issue_title"] for x in good.collect()] == ["t"]
    assert deferred.count() == 1
    assert records.all_sources(issues, good).count() == 2


def test_config_rejects_unknown_keys():
    good = 'schema_version = "skein.config.v1"\n[[profile]]\nname = "p"\nhost = "H.org"\nrepos = ["a/b"]\n[[profile.policy]]\nrepo = "a/b"\nlimit = 5\n'
    profile = records.profile_for(records.read_config(good), "h.ORG", "a/b")
    assert profile.policies["a/b"].limit == 5
    with pytest.raises(ValueError, match="unknown_key"):
        records.read_config(good + 'colour = "red"\n')
    with pytest.raises(LookupError, match="not_found"):
        records.profile_for(records.read_config(good), "other.org")


def test_link_header_remote_and_origin(spark):
    from skein.functions.text import next_page

    cases = spark.createDataFrame([('<https://x/2>; rel="next", <https://x/9>; rel="last"',), ('<https://x/1>; rel="prev"',)], "h string")
    assert [r[0] for r in cases.select(next_page(F.col("h"))).collect()] == ["https://x/2", None]
    urls = spark.createDataFrame([("git@h.org:a/b.git",), ("https://h.org/a/b",), ("ssh://git@h.org/a/b.git",), ("nope",)], "u string")
    assert [r[0] for r in urls.select(records.repo_of_remote(F.col("u"))).collect()] == ["a/b", "a/b", "a/b", None]
    o = spark.createDataFrame([("https://api.h.org/x",), ("http://api.h.org/x",), ("https://api.h.org.evil/x",), ("https://u@api.h.org/x",)], "u string")
    assert [r[0] for r in o.select(records.trusted_origin(F.col("u"), "api.h.org")).collect()] == [True, False, False, False]


def test_budget_gate_stream(spark, tmp_path):
    rows = [("h", 1, "request", None), ("h", 2, "report", 2), ("h", 3, "request", None), ("h", 4, "report", 50), ("h", 5, "request", None), ("h", 6, "request", None), ("h", 7, "report", 9), ("h", 8, "request", None)]
    rows += [("u", 1, "request", None), ("u", 2, "request", None), ("u", 3, "report", 9), ("u", 4, "request", None), ("n", 1, "request", None), ("n", 2, "report", None), ("n", 3, "request", None)]
    spark.createDataFrame(rows, "host string, seq long, kind string, remaining long").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = gated(spark.readStream.schema("host string, seq long, kind string, remaining long").parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {(r["host"], r["seq"]): r["reason"] if not r["passes"] else None for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    low, none = "rate_budget_reserve", "unknown_budget_limit"
    assert got == {("h", 1): None, ("h", 3): None, ("h", 5): None, ("h", 6): low, ("h", 8): low, ("u", 1): None, ("u", 2): none, ("u", 4): none, ("n", 1): None, ("n", 3): none}
