"""The page stream and its landing: budgets, pages that wait, broken runs, repeated batches."""

import json

import pyarrow as pa
import pytest

from skein.sources import landing, pages
from skein.sources.records import PAGE


@pytest.fixture
def land(tmp_path):
    def put(endpoint, number, status=200, **more):
        folder = tmp_path / "in" / endpoint.replace("/", "%2F")
        folder.mkdir(parents=True, exist_ok=True)
        page = {"endpoint": endpoint, "repo": "a/b", "host": "h", "page": number, "status": status, "etag": f"e{number}", "link": None, "remaining": 5, "items": [f'{{"n":{number}}}'], "fetched_at": "2024-01-01T00:00:00Z"}
        (folder / f"{number:06d}.json").write_text(json.dumps(page | more))

    return put


def run(spark, tmp_path, **more):
    rows = pages.landed(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/state", **more).select("endpoint", "page").collect()
    assert len(set(rows)) == len(rows)
    return {e: sorted(r["page"] for r in rows if r["endpoint"] == e) for e in {r["endpoint"] for r in rows}}


def test_runs_go_on_where_the_landing_is(spark, tmp_path, land):
    """Two pages of an endpoint a run, up to one that waits; then that one was fetched again."""
    for n in range(1, 6):
        land("issues:a/b", n, 429 if n == 4 else 200)
        land("history:a/b", n)
    seen = [run(spark, tmp_path, pages=2) for _ in range(4)]
    assert seen[0] == {"issues:a/b": [1, 2], "history:a/b": [1, 2]}
    assert seen[1] == {"issues:a/b": [1, 2, 3], "history:a/b": [1, 2, 3, 4]}
    assert seen[2] == seen[3] == {"issues:a/b": [1, 2, 3], "history:a/b": [1, 2, 3, 4, 5]}
    notes = landing.Notes(f"file://{tmp_path}/out")
    assert notes.cursors() == {"issues:a/b": (3, "e3"), "history:a/b": (5, "e5")}
    land("issues:a/b", 4)
    assert run(spark, tmp_path, seconds=0) == seen[3]  # out of time
    assert run(spark, tmp_path)["issues:a/b"] == [1, 2, 3, 4, 5]
    # a new checkpoint goes on from the landing too
    land("issues:a/b", 6)
    for f in (tmp_path / "state").rglob("*"):
        if f.is_file():
            f.unlink()
    assert run(spark, tmp_path)["issues:a/b"] == [1, 2, 3, 4, 5, 6]


def test_a_task_that_fails_leaves_nothing(spark, tmp_path, land):
    for n in range(1, 4):
        land("issues:a/b", n)
    assert run(spark, tmp_path, pages=1) == {"issues:a/b": [1]}
    land("comments:a/b", 1, page=None)  # breaks the writer's task
    with pytest.raises(Exception, match="(?i)fail|terminated"):
        run(spark, tmp_path)
    rows = landing.landed_rows(spark, f"file://{tmp_path}/out", PAGE)
    assert [r["page"] for r in rows.collect()] == [1]
    land("comments:a/b", 1)
    assert run(spark, tmp_path) == {"issues:a/b": [1, 2, 3], "comments:a/b": [1]}
    landing.Notes(f"file://{tmp_path}/out").swept()
    assert landing.landed_rows(spark, f"file://{tmp_path}/out", PAGE).count() == 4


def test_a_driver_that_dies_after_the_note_repeats_nothing(spark, tmp_path, land):
    """Spark has not noted the batch as done, so it comes again."""
    for n in range(1, 4):
        land("issues:a/b", n)
    want = run(spark, tmp_path)
    done = sorted((f for f in (tmp_path / "state/commits").iterdir() if not f.name.startswith(".")), key=lambda f: int(f.name))
    for f in (done[-1], done[-1].with_name(f".{done[-1].name}.crc")):
        f.unlink(missing_ok=True)
    land("issues:a/b", 4)
    assert run(spark, tmp_path) == want
    assert run(spark, tmp_path) == {"issues:a/b": [1, 2, 3, 4]}


def test_commits_are_whole_or_nothing(tmp_path):
    """By hand: what is written but not committed is not seen; the repetition of a batch is dropped, a part of one is an error."""
    path = f"file://{tmp_path}/out"
    writer, notes = landing.StreamWriter(path), landing.Notes(path)
    batch = lambda *rows: iter([pa.RecordBatch.from_pylist([{"endpoint": e, "page": p, "etag": f"{e}{p}"} for e, p in rows])])
    files = lambda: len(list((tmp_path / "out/rows").iterdir()))
    one = [writer.write(batch(("a", 1), ("a", 2))), writer.write(batch(("a", 3), ("b", 1))), writer.write(iter([])), None]
    assert notes.all() == [] and files() == 2
    writer.abort(one, 0)
    assert files() == 0
    one = [writer.write(batch(("a", 1), ("a", 2))), writer.write(batch(("a", 3), ("b", 1)))]
    writer.commit(one, 0)
    assert notes.cursors() == {"a": (3, "a3"), "b": (1, "b1")} and len(notes.all()) == 1
    again = [writer.write(batch(("a", 1), ("a", 2), ("a", 3), ("b", 1)))]
    assert files() == 3
    writer.commit(again, 0)
    assert len(notes.all()) == 1 and files() == 2
    with pytest.raises(RuntimeError, match="landing.overlap: a"):
        writer.commit([writer.write(batch(("a", 3), ("a", 4)))], 1)
    with pytest.raises(RuntimeError, match="landing.overlap: b"):
        writer.commit([writer.write(batch(("b", 1), ("c", 1)))], 1)
    assert files() == 2
    writer.write(batch(("z", 1)))
    assert notes.swept() == 1 and files() == 2


def test_a_batch_writer(spark, tmp_path):
    spark.dataSource.register(landing.Landing)
    rows = spark.createDataFrame([("a", i, f"e{i}", "x" * i) for i in range(1, 40)], "endpoint string, page long, etag string, body string").repartition(3)
    for _ in range(2):
        rows.write.format("skein_landing").option("path", f"file://{tmp_path}/out").mode("append").save()
    assert landing.landed_rows(spark, f"file://{tmp_path}/out", rows.schema).count() == 39
    assert landing.Notes(f"file://{tmp_path}/out").cursors() == {"a": (39, "e39")}
