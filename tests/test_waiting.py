"""Comments and issues in any order of arrival, over several runs."""

import os
import random
from datetime import datetime, timezone

import pytest

from skein.streaming import waiting
from skein.suite import state

SCHEMA = "repo string, number long, kind string, node_id string, at timestamp"
DAY = 86_400


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run(spark, tmp_path, rows, day=0, patience=7 * 1000 * DAY):
    rows = [(*r, datetime.fromtimestamp(DAY * (20000 + day), timezone.utc)) for r in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = waiting.with_parents(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), patience)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["number"], r["node_id"], r["parent"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_any_order_gives_the_same(spark, tmp_path, rocks, monkeypatch):
    r = random.Random(4)
    rows = [("a/b", n, "issue", f"I{n}") for n in range(6)] + [("a/b", n, "comment", f"C{n}.{k}") for n in range(9) for k in range(5)]
    r.shuffle(rows)
    for part in (rows[:17], rows[17:40]):
        run(spark, tmp_path, part)
    got = run(spark, tmp_path, rows[40:])
    assert got == sorted((n, f"C{n}.{k}", f"I{n}", "resolved") for n in range(6) for k in range(5))
    assert run(spark, tmp_path, [("a/b", 8, "issue", "I8")])[-5:] == [(8, f"C8.{k}", "I8", "resolved") for k in range(5)]


def test_patience_ends(spark, tmp_path, rocks):
    assert run(spark, tmp_path, [("a/b", 1, "issue", "I1"), ("a/b", 1, "comment", "x"), ("a/b", 2, "comment", "y")]) == [(1, "x", "I1", "resolved")]
    assert run(spark, tmp_path, [("a/b", 3, "issue", "I3"), ("a/b", 3, "comment", "z")], 5) == [(1, "x", "I1", "resolved"), (3, "z", "I3", "resolved")]
    assert run(spark, tmp_path, [("a/b", 4, "issue", "I4")], 9) == [(1, "x", "I1", "resolved"), (2, "y", None, "expired"), (3, "z", "I3", "resolved")]


def test_batches_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A batch costs a task for each partition of the state, so 12,000 rows take no more of them than a few."""
    made = []
    monkeypatch.setattr(state, "new_folder", lambda spark, label: made.append(f"{tmp_path}/{label}") or made[-1])
    spark.range(12_000).selectExpr("id % 12 as conv_id", "id div 12 as turn", "'user' as role", "'x' as text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = state.waiting_comments(spark, str(tmp_path))
    assert got.count() == got.distinct().count() == 10 * 999  # issues 0 and 11 never come
    assert len([x for x in os.listdir(f"{made[-1]}/state/commits") if x.isdigit()]) <= state.BATCHES + 1
