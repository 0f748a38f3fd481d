"""Vectors, evidence, search, publication and snapshots on small fixtures with literal results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import dense, evaluate, fusion, grammar, lexical, lifecycle, models, resolve
from skein.operators.filters import escaped
from skein.plans import search
from skein.plans import publish
from skein.plans.publish import Generations, Publication, Publications
from skein.sources import pages
from skein.streaming import ingest


def near(spark, queries, vectors, **more):
    q = spark.createDataFrame(queries, "qid long, query_vector array<double>")
    c = spark.createDataFrame(vectors, f"source_id {'string' if isinstance(vectors[0][0], str) else 'long'}, vector array<double>")
    return {(r["qid"], r["rank"]): (r["source_id"], r["value"]) for r in dense.nearest(q, c.repartition(3), **more).collect()}


@pytest.mark.parametrize("far", [1.0, 1000.0, 1e6])
def test_ties_by_rounding_go_by_id(spark, far):
    """Two distances that round alike, the farther one of the smaller id."""
    assert near(spark, [(7, [0.0, 0.0])], [(5, [far, 0.0]), (1, [far + 4e-7, 0.0]), (9, [far + 1, 0.0])], limit=1) == {(7, 1): (1, round(far, 6))}


@pytest.mark.parametrize(("metric", "ids"), [("l2", "long"), ("cosine", "string")])
def test_nearest_equals_plain_loops(spark, monkeypatch, metric, ids):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "STRIP", 7)
    monkeypatch.setattr(dense, "GATHERED", 1)
    rng = np.random.default_rng(1)
    name = (lambda i: f"s{i:03d}é") if ids == "string" else (lambda i: i)
    vectors = [(name(i % 60), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    queries = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(8)] + [(20, None)]
    got = near(spark, queries, vectors, limit=5, metric=metric)

    def value(a, b):
        a, b = np.array(a), np.array(b)
        if metric == "l2":
            return round(float(np.sqrt(((a - b) ** 2).sum())), 6)
        return None if not a.any() or not b.any() else round(float(a / np.sqrt(a @ a) @ (b / np.sqrt(b @ b))), 6)

    for q, x in queries[:-1]:
        best = {}
        for s, v in vectors:
            if (d := value(x, v)) is not None:
                best[s] = d if s not in best else (min if metric == "l2" else max)(best[s], d)
        want = sorted(best.items(), key=lambda p: (p[1] if metric == "l2" else -p[1], str(p[0]) if ids == "string" else p[0]))[:5]
        assert [got[q, k] for k in range(1, len(want) + 1)] == [(s, pytest.approx(d, abs=1e-6)) for s, d in want]
    assert not any(q == 20 for q, _ in got)


def test_dimensions_are_checked(spark):
    with pytest.raises(Exception, match="dimension"):
        near(spark, [(1, [1.0, 2.0])], [(1, [1.0, 2.0, 3.0])])
    with pytest.raises(ValueError, match="dimensions"):
        near(spark, [(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0, 2.0])])
    assert near(spark, [(1, [1.0, 2.0, 9.0])], [(1, [1.0, 2.0, 3.0])], dimension=2) == {(1, 1): (1, 0.0)}


def test_best_in_groups(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query_vector array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], "b"), (4, [2.0, 2.0], "b"), (5, [0.0, 0.0], "c"), (6, None, "c")], "source_id long, vector array<double>, label string")
    got = {(r["label"], r["source_id"], r["value"]) for r in dense.best_in_groups(q, c, "label", exclude_same=True).collect()}
    assert got == {("a", 2, 0.0), ("b", 3, round(2**-0.5, 6))}


def test_dense_ranks_beyond_the_window_do_not_count(spark):
    lex = spark.createDataFrame([(1, "l1", 1)], "qid long, source_id string, rank long")
    den = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 82)], "qid long, source_id string, rank long")
    got = {r["source_id"] for r in fusion.fuse(lex, den, 100).collect()}
    assert "d80" in got
    assert "d81" not in got
    assert fusion.fuse(lex, den, 0).count() == 0


def test_evidence_is_of_the_version_and_has_a_match(spark):
    hits = spark.createDataFrame([(1, "red fox", "s1", "whole body", 2), (1, "red fox", "s2", "other body", 1), (2, "nothing", "s1", "whole body", 2), (3, "  ", "s1", "whole body", 2)], "qid long, query string, source_id string, body string, version int")
    parts = spark.createDataFrame([("s1", 1, 0, "red fox red"), ("s1", 2, 0, "a dog"), ("s1", 2, 1, "The RED dog"), ("s1", 2, 2, "red hen"), ("s2", 9, 0, "red fox")], "source_id string, version int, chunk_index int, body string")
    got = {(r["qid"], r["source_id"]): (r["chunk_index"], r["matched"], r["snippet"]) for r in resolve.evidence(hits, parts).collect()}
    assert got == {(1, "s1"): (1, 1, "The RED dog"), (1, "s2"): (None, None, "other body"), (2, "s1"): (None, None, "whole body"), (3, "s1"): (None, None, "whole body")}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [
        ("s1", "issue", "a/b", 1, "open", ["bug"], "ann", "Login broken", "token expired on login", None, 1), ("s2", "issue", "a/b", 2, "closed", [], "bob", "Payment", "login page token slow", None, 1), ("s3", "issue_comment", "a/b", 1, None, None, "cat", None, "again it fails", "Login broken", 1),
    ]
    sources = spark.createDataFrame(rows, "source_id string, entity_type string, repo string, issue_number long, state string, labels array<string>, author string, title string, body string, parent_issue_title string, version long")
    index = lexical.Index.build(sources, search.index_fields(), f"file://{tmp_path_factory.mktemp('i')}/g")
    vec = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.0, 1.0]), ("s3", [0.9, 0.1])], "source_id string, vector array<double>")
    return search.Corpus(sources, sources.limit(0).select("source_id"), index, vec, dimension=2, fingerprint="f")


def asked(spark, *queries):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(queries)], "qid long, query string, query_vector array<double>")


def test_search_knows_operators(spark, corpus):
    q = asked(spark, ("+login -payment", None), ("title:login", None), ('say "x', None), ("+", None), ("login^5 again", None), ("#2", None))
    got = search.search(corpus, q, fingerprint="f").collect()
    by = lambda n: [r["source_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == n]
    assert set(by(0)) == {"s1", "s3"}
    assert by(1) == ["s1"]
    assert by(2) == by(3) == []
    assert {r["qid"]: r["error"] for r in search.query_errors(q).collect()} == {2: "validation.invalid_query", 3: "validation.invalid_query"}
    assert by(4)[0] != "s3"
    assert by(5) == ["s2"]


def test_search_degrades_to_lexical(spark, corpus):
    """No vector, one of another size, other fingerprints, vectors that are not ready: never an error."""
    from dataclasses import replace

    q = asked(spark, ("again", [1.0, 0.0]), ("again", None), ("again", [1.0, 0.0, 0.0]))
    kinds = lambda c, f: {r["qid"]: r["n"] for r in search.search(c, q, fingerprint=f).groupBy("qid").agg(F.count_if(F.col("dense_rank").isNotNull()).alias("n")).collect()}
    said = lambda c, f: {r["qid"]: r["warning"] for r in search.warnings(c, q, f).collect()}
    assert kinds(corpus, "f") == {0: 3, 1: 0, 2: 0}
    assert said(corpus, "f") == {1: "embedding.query_encoding_failed", 2: "embedding.query_dimension_mismatch"}
    assert kinds(corpus, "other") == {0: 0, 1: 0, 2: 0}
    assert set(said(corpus, "other").values()) == {"embedding.fingerprint_mismatch"}
    assert set(said(replace(corpus, ready=False), "f").values()) == {"embedding.not_ready"}
    assert kinds(replace(corpus, ready=False), "f") == {0: 0, 1: 0, 2: 0}
    assert said(replace(corpus, chunks=None), None) == {}


def test_failed_encoding_is_a_null_vector(spark):
    class Picky:
        dimension = 2

        def encode(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot")
            return np.ones((len(texts), 2))

    rows = spark.createDataFrame([(i, "bad" if i == 2 else "good") for i in range(5)], "id long, body string")
    got = {r["id"]: r["vector"] is None for r in models.embedded(rows, Picky(), "body", ["id"], strict=False).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False}
    with pytest.raises(Exception, match="cannot"):
        models.embedded(rows, Picky(), "body", ["id"]).collect()


def test_activation_needs_a_whole_generation(spark):
    chunks = spark.createDataFrame([(1, "h1"), (2, "h2")], "chunk_id long, context_hash string")
    rows = [(1, "h1", [1.0]), (2, "h2", [2.0])]
    made = lambda r: spark.createDataFrame(r, "chunk_id long, context_hash string, vector array<double>")
    assert models.activated(chunks, made(rows)).count() == 2
    for bad in (rows[:1], [*rows, (3, "h3", [1.0])], [*rows, rows[0]], [rows[0], (2, "h2", [1.0, 2.0])], [rows[0], (2, "old", [1.0])]):
        with pytest.raises(RuntimeError, match="generation_incomplete"):
            models.activated(chunks, made(bad))


def test_corruption_of_the_same_size_is_seen(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}")
    m = g.reserve("2024-01-01T00:00:00Z")
    spark.range(50).coalesce(1).write.option("compression", "none").parquet(f"{g.path(m)}/rows")
    ready = g.seal(m, "2024-01-01T00:01:00Z")
    assert g.intact(ready.generation)
    file = next((tmp_path / f"generation={ready.generation}/rows").glob("part-*.parquet"))
    raw = bytearray(file.read_bytes())
    raw[20] ^= 1
    file.write_bytes(raw)
    for crc in file.parent.glob(".part-*.crc"):
        crc.unlink()
    assert not g.intact(ready.generation)


def test_a_damaged_stretch_is_named(spark, tmp_path, monkeypatch):
    """Files of many leaves and levels; a change of one byte, a file that went, one that came, one that grew."""
    monkeypatch.setattr(publish, "LEAF", 100)
    monkeypatch.setattr(publish, "FANOUT", 3)
    g = Generations(spark, f"file://{tmp_path}")
    m = g.reserve("2024-01-01T00:00:00Z")
    folder = tmp_path / f"generation={m.generation}.tmp"
    (folder / "deep").mkdir()
    for name, size in (("a", 2550), ("b", 0), ("c", 100), ("deep/d", 901)):
        (folder / name).write_bytes(bytes(i % 251 for i in range(size)))
    ready = g.seal(m, "2024-01-01T00:01:00Z")
    assert g.intact(ready.generation) and g.damaged(ready.generation).count() == 0
    whole = tmp_path / f"generation={ready.generation}"
    raw = bytearray((whole / "a").read_bytes())
    raw[1234] ^= 1
    (whole / "a").write_bytes(raw)
    assert {tuple(r) for r in g.damaged(ready.generation).collect()} == {("a", 1200, 100)} and not g.intact(ready.generation)
    raw[1234] ^= 1
    (whole / "a").write_bytes(raw)
    assert g.intact(ready.generation)
    (whole / "b").unlink()
    (whole / "new").write_bytes(b"x")
    (whole / "deep/d").write_bytes((whole / "deep/d").read_bytes() + b"y")
    assert {tuple(r) for r in g.damaged(ready.generation).collect()} == {("b", 0, 0), ("new", 0, 1), ("deep/d", 900, 1), ("deep/d", 900, 2)}


def test_a_reader_sees_one_publication(spark, tmp_path):
    p = Publications(spark, f"file://{tmp_path}")
    p.activate(Publication("p1", 1, None, None), None)
    with p.reading() as now:
        assert now.id == "p1"
    with pytest.raises(RuntimeError, match="changed"), p.reading():
        p.activate(Publication("p2", 1, None, None), "p1")


def test_snapshots_rewrite_only_hit_buckets(spark, tmp_path):
    root, src = f"file://{tmp_path}/table", f"{tmp_path}/in"
    schema = "k long, v long"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.snapshots(spark.readStream.schema(schema).parquet(src), root, f"{tmp_path}/state", ["k"], ["v"], 4).awaitTermination()
        return {tuple(r) for r in ingest.current(spark, root).select("k", "v").collect()}

    assert run([(k, 1) for k in range(40)]) == {(k, 1) for k in range(40)}
    assert run([(3, 2), (3, 0)]) == {(k, 2 if k == 3 else 1) for k in range(40)}
    held = json.loads((tmp_path / "table/batch=1/_table").read_text())
    assert sorted(held.values()) == [0, 0, 0, 1]
    assert run([(50, 1)]) == {(k, 2 if k == 3 else 1) for k in range(40)} | {(50, 1)}
    assert {tuple(r) for r in ingest.current(spark, root, 0).select("k", "v").collect()} <= {(k, 1) for k in range(40)}


def test_held_watermark(spark):
    rows = [("a", 1, 0, False), ("a", 3, 1, True), ("a", 3, 0, False), ("a", 5, 2, False), ("b", 1, 0, True), ("c", 2, 0, False)]
    df = spark.createDataFrame(rows, "p string, ts long, tie long, late boolean")
    got = {r["p"]: (r["watermark"], r["behind"]) for r in lifecycle.held_watermark(df, "p", "ts", F.col("late"), "tie").collect()}
    assert got == {"a": (3, 2), "b": (None, 1), "c": (2, 0)}


def test_latest_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), ("a", "n", 2, None), ("b", "m", 1, "y")], "k string, `odd name` string, v long, w string")
    got = resolve.latest(df, ["k"], [F.col("v")])
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {("a", "n", 2, None), ("b", "m", 1, "y")}


def test_escaped_values(spark):
    p = spark.createDataFrame([(1, "this holds a secret sentence indeed"), (2, "short"), (3, "a secret sentenc"), (4, None)], "payload_id long, payload string")
    v = spark.createDataFrame([("a secret sentence",), ("tiny",), (None,)], "value string")
    assert [r[0] for r in escaped(p, v).collect()] == [1]


def test_profile_blockers_and_leaks(spark):
    side = lambda ndcg, top, bad=0, trip=1.0, stale=0, comment=(0.5,), failed=(): F.struct(F.lit(ndcg).alias("ndcg"), F.lit(top).alias("exact_top1"), F.lit(bad).alias("violations"), F.lit(trip).alias("round_trip"), F.lit(stale).alias("stale"), F.array(*map(F.lit, comment)).alias("comment"), F.array(*map(F.lit, failed)).cast("array<string>").alias("failures"))
    why = lambda a, b: spark.range(1).select(evaluate.profile_blockers(a, b)).first()[0]
    base = side(0.5, 0.96)
    assert why(base, side(0.6, 0.96)) == []
    assert why(base, side(0.5, 0.96)) == ["ndcg_not_better"]
    assert why(side(0.5, 0.9), side(0.6, 0.94)) == ["exact_worse"]
    assert why(base, side(0.6, 0.99, 1, 0.9, 2, (0.4,), ("x",))) == ["filter_violations", "round_trip_worse", "stale_results", "comments_worse", "gate:x"]
    a, b = (spark.createDataFrame([(x,) for x in ids], "thread_id long") for ids in ((1, 2, 2), (2, 3)))
    assert [r[0] for r in evaluate.leaked_threads(a, b).collect()] == [2]


def test_index_keeps_frequencies(spark, corpus):
    got = {(r["field"], r["term"]): r["df"] for r in lexical.document_frequencies(corpus.index).collect()}
    assert got["body", "login"] == 2
    assert got["title", "login"] == 1


@pytest.mark.parametrize(("query", "want"), [("say +x -y title:z a^2", "say  x  y title z a 2"), ("a-b", "a-b")])
def test_plain_text_has_no_operators(spark, query, want):
    assert spark.range(1).select(grammar.plain(F.lit(query))).first()[0] == want


def test_page_scan(spark, tmp_path):
    """Pages behind the cursor, some of each endpoint, up to one that asks to wait."""
    def land(endpoint, number, status=200, **more):
        folder = tmp_path / endpoint.replace("/", "%2F")
        folder.mkdir(exist_ok=True)
        page = {"endpoint": endpoint, "repo": "a/b", "host": "h", "page": number, "status": status, "etag": f"e{number}", "link": None, "remaining": 5, "items": ["{}"], "fetched_at": "2024-01-01T00:00:00Z"}
        (folder / f"{number:06d}.json").write_text(json.dumps(page | more))

    for n in range(1, 6):
        land("issues:a/b", n, 429 if n == 4 else 200)
        land("history:a/b", n)
    path = f"file://{tmp_path}"
    assert pages.scan(spark, path).count() == 10
    some = pages.scan(spark, path, {"issues:a/b": 2}, pages=2)
    assert {(r["endpoint"], r["page"]) for r in some.collect()} == {("issues:a/b", 3), ("issues:a/b", 4), ("history:a/b", 1), ("history:a/b", 2)}
    good = pages.committed(some)
    assert {tuple(r) for r in pages.cursors(good).collect()} == {("issues:a/b", 3, "e3"), ("history:a/b", 2, "e2")}
    assert pages.scan(spark, path, endpoints="history:").count() == 5
    assert pages.scan(spark, f"{path}/none").count() == 0
    land("issues:a/b", 9, odd=1)
    with pytest.raises(Exception, match="unknown fields: odd"):
        pages.scan(spark, path).count()
