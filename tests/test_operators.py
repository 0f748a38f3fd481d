import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import times, vectors
from skein.operators import decisions as D
from skein.operators import evaluate, fusion, lexical, lifecycle, resolve
from skein.operators.filters import Filters, predicate
from skein.plans import search


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_snippet_keeps_whole_characters(spark):
    body = "é" * 200
    assert one(spark, X.snippet(F.lit(body)))[0] == "é" * 90 + "..."
    assert one(spark, X.snippet(F.lit("x" * 180)))[0] == "x" * 180
    assert one(spark, X.snippet(F.lit("a" + "漢" * 90)))[0] == "a" + "漢" * 59 + "..."


def test_cjk_terms_and_dashes(spark):
    assert one(spark, X.cjk_ngrams(F.lit("배포오류가 x")))[0] == ["배포", "포오", "오류", "류가", "배포오", "포오류", "오류가"]
    assert one(spark, X.normalised_query(F.lit("run --type x")))[0] == "run  type x"


@pytest.mark.parametrize(
    ("query", "number", "repo"),
    [
        ("https://h.org/a/b/issues/7", 7, "a/b"), ("https://h.org/a/b/issues/7#issuecomment-9", 7, "a/b"), ("#12", 12, None), ("-5", -5, None), ("12", 12, None),
        ("https://h.org/a/b/issues/0", None, None), ("https://h.org/a/b/issues/7?x=1", None, None), ("https://u@h.org/a/b/issues/7", None, None),
        ("https://h.org/a/b/pulls/7", None, None), ("https://h.org/a/b/issues/7#other", None, None), ("fix #12", None, None),
    ],
)
def test_locators(spark, query, number, repo):
    r = resolve.routed(spark.createDataFrame([(1, query)], "qid long, query string"), "https://h.org").first()
    assert r["number"] == number
    assert (r["locator"]["repo"] if r["locator"] else None) == repo
    assert r["route"] == ("ranked" if number is None else "exact")


def test_issue_filter_makes_any_query_exact(spark):
    q = spark.createDataFrame([(1, "words", 4)], "qid long, query string, filter_issue long")
    assert resolve.routed(q, "https://h.org").first()["route"] == "exact"


def test_ambiguous_number_is_an_error(spark):
    q = resolve.routed(spark.createDataFrame([(1, "#1")], "qid long, query string"), "https://h.org")
    issues = spark.createDataFrame([("s1", 1, "a/b"), ("s2", 1, "c/d")], "source_id string, issue_number long, repo string")
    assert {r["error"] for r in resolve.exact(q, issues).collect()} == {"locator.ambiguous"}


def test_protected_head_and_order(spark):
    lex = spark.createDataFrame([(1, f"l{i}", i) for i in range(1, 9)], "qid long, source_id string, rank long")
    den = spark.createDataFrame([(1, "l8", 1), (1, "d1", 2), (1, "l1", 3)], "qid long, source_id string, rank long")
    got = [r["source_id"] for r in fusion.fuse(lex, den, 20).orderBy("rank").collect()]
    assert got[:5] == ["l1", "l2", "l3", "l4", "l5"]
    assert got[5] == "l8"
    assert got[-1] == "d1"


def test_repeated_sources_keep_best_rank(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "qid long, source_id string, rank long")
    got = {r["source_id"]: r["lexical_rank"] for r in fusion.fuse(lex, lex.limit(0), 5).collect()}
    assert got == {"a": 1, "b": 3}


@pytest.mark.parametrize(("limit", "want"), [(10, 80), (20, 80), (100, 400)])
def test_candidate_window(spark, limit, want):
    assert one(spark, fusion.candidate_window(F.lit(limit)))[0] == want


def test_rerank_is_all_or_nothing(spark):
    ranked = spark.createDataFrame([(q, f"s{i}", i) for q in (1, 2) for i in range(1, 13)], "qid long, source_id string, rank long")
    scores = spark.createDataFrame([(1, f"s{i}", float(i)) for i in range(1, 11)] + [(2, f"s{i}", math.nan if i == 4 else float(i)) for i in range(1, 11)], "qid long, source_id string, rerank_score double")
    got = fusion.rerank(ranked, scores).orderBy("qid", "rank").collect()
    assert [r["source_id"] for r in got if r["qid"] == 1] == [f"s{i}" for i in (*range(10, 0, -1), 11, 12)]
    assert [r["source_id"] for r in got if r["qid"] == 2] == [f"s{i}" for i in range(1, 13)]


def test_metrics_closed_form(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3)], "qid long, source_id string, rank long")
    gold = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "qid long, source_id string, grade long")
    r = evaluate.query_metrics(run, gold).first()
    dcg, ideal = 1 / math.log2(2) + 7 / math.log2(4), 7 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)
    assert r["ndcg"] == pytest.approx(dcg / ideal)
    assert r["mrr"] == 1
    assert r["recall_5"] == pytest.approx(2 / 3)


def test_nearest_rank_takes_a_value(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "v long")
    r = evaluate.nearest_rank(rows, "v", [0.5, 0.95]).first()
    assert (r["p50"], r["p95"]) == (5, 10)


def test_filters(spark):
    rows = spark.createDataFrame(
        [("1", "issue", "a/b", 1, "open", ["ready-for-agent"], "x"), ("2", "issue", "a/b", 2, "closed", ["ready", "for", "agent"], "x"), ("3", "issue_comment", "a/b", 1, None, None, "y")],
        "source_id string, entity_type string, repo string, issue_number long, state string, labels array<string>, author string",
    )
    ids = lambda f: [r["source_id"] for r in rows.filter(predicate(f)).orderBy("source_id").collect()]
    assert ids(Filters()) == ["1", "2", "3"]
    assert ids(Filters(labels=("ready-for-agent",))) == ["1"]
    assert ids(Filters(labels=("ready", "for", "agent"))) == ["2"]
    assert ids(Filters(state="open")) == ["1"]
    assert ids(Filters(state="all")) == ["1", "2", "3"]
    assert ids(Filters(source_types=())) == []
    assert ids(Filters(source_types=("issue_comment",))) == ["3"]
    assert ids(Filters(repo="A/b")) == []


@pytest.mark.parametrize(("said", "want"), [("5m", 300), ("2h", 7200), ("1mo", 2592000), ("0d", None), ("5", None), ("x", None), ("-3s", None)])
def test_durations(spark, said, want):
    assert one(spark, times.duration_seconds(F.lit(said)))[0] == want


def test_two_backoff_rules(spark):
    r = one(spark, times.sync_deadline(F.lit(500), F.lit(100), F.lit(900)), times.schedule_deadline(F.lit(500), F.lit(100), F.lit(900)), times.schedule_deadline(F.lit(None).cast("int"), F.lit(0), F.lit(999999)))
    assert tuple(r) == (500, 1000, 86400)


@pytest.mark.parametrize(("limit", "want"), [(0, 0), (1, 1), (5, 1), (6, 2), (5000, 1000)])
def test_reserve(spark, limit, want):
    assert one(spark, times.reserve(F.lit(limit)))[0] == want


def test_unusable_vector_is_an_error(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(vectors.truncated(F.array(F.lit(0.0), F.lit(0.0)), 2)).collect()
    r = one(spark, vectors.truncated(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2))[0]
    assert r == pytest.approx([0.6, 0.8])


def test_fingerprint_ignores_order_case_and_repeats(spark):
    a, b, c = one(spark, *(D.scope_fingerprint(F.array(*map(F.lit, x))) for x in (("A/b ", "c/d"), ("c/D", "a/b", "a/b"), ("a/b", "c/e"))))
    assert a == b != c


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v long, body string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("b", 4, "old")], "k string, v long, body string")
    once = lifecycle.upsert(now, new, ["k"], ["v"])
    twice = lifecycle.upsert(once, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 2, "z"), ("b", 5, "y"), ("c", 1, "w")]


def test_alias_chains_end_and_loops_are_seen(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "source string, target string")
    got = {r["source"]: (r["final"], r["looped"]) for r in resolve.aliases(moves).collect()}
    assert got["a"] == ("c", False)
    assert got["b"] == ("c", False)
    assert got["x"][1]


def test_search_end_to_end(spark, tmp_path):
    rows = [
        ("s1", "issue", "a/b", 1, "open", ["bug"], "ann", "Login broken", "token expired on login", None, 1),
        ("s2", "issue", "a/b", 2, "closed", [], "bob", "배포 문제", "인증토큰 만료", None, 1),
        ("s3", "issue_comment", "a/b", 1, None, None, "cat", None, "login again --type fails", "Login broken", 1),
        ("s4", "issue", "a/b", 4, "open", [], "dan", "Gone", "login login login", None, 1),
    ]
    sources = spark.createDataFrame(rows, "source_id string, entity_type string, repo string, issue_number long, state string, labels array<string>, author string, title string, body string, parent_issue_title string, version long")
    dead = spark.createDataFrame([("s4",)], "source_id string")
    index = lexical.Index.build(sources, search.index_fields(), f"file://{tmp_path}/g")
    vec = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.0, 1.0]), ("s3", [0.9, 0.1])], "source_id string, vector array<double>")
    lines = sources.select("source_id", "version", F.lit(0).alias("chunk_index"), "body")
    corpus = search.Corpus(sources, dead, index, vec, lines)
    q = spark.createDataFrame([(1, "login", [1.0, 0.0]), (2, "인증토큰", None), (3, "#2", None), (4, "--type", None)], "qid long, query string, query_vector array<double>")
    got = search.search(corpus, q).collect()
    by = lambda n: [r["source_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == n]
    assert "s4" not in {r["source_id"] for r in got}
    assert set(by(1)) == {"s1", "s2", "s3"}
    assert by(2) == ["s2"]
    assert by(3) == ["s2"]
    assert by(4) == ["s3"]
    assert {r["kind"] for r in got if r["qid"] == 3} == {"exact"}
    lexical_only = search.search(search.Corpus(sources, dead, index), q, Filters(state="open")).collect()
    assert {(r["qid"], r["source_id"]) for r in lexical_only} == {(1, "s1")}
    assert search.envelope(search.search(corpus, q)).count() == 4
    assert "query" not in search.query_log(search.search(corpus, q), q).columns


@pytest.mark.parametrize(("query", "bad"), [("a b", False), ("+a -b title:c", False), ("+", True), ("a - b", True), ("title:", True), ('say "x', True), ('say "x"', False), ("http://x", False), ("--type", False)])
def test_invalid_queries(spark, query, bad):
    from skein.operators.grammar import query_error

    assert one(spark, query_error(F.lit(query), ["title", "body"]))[0] == ("validation.invalid_query" if bad else None)


def test_query_nodes(spark):
    from skein.operators.grammar import nodes

    q = spark.createDataFrame([(1, "+Foo -bar title:baz other:qux x^2 !!"), (2, "+"), (3, 'a AND title:(b OR "c d"^3)^2 NOT e'), (4, "..."), (5, None)], "qid long, query string")
    got = {(r["qid"], r["node"], r["parent"], r["occur"], r["field"], tuple(r["terms"] or ()), r["phrase"], r["boost"], r["required"]) for r in nodes(q, F.col("query"), ["title"]).collect()}
    assert got == {
        (1, 0, -1, "should", None, (), None, 1, 1), (1, 1, 0, "must", None, ("foo",), False, 1, 0), (1, 2, 0, "not", None, ("bar",), False, 1, 0), (1, 3, 0, "should", "title", ("baz",), False, 1, 0),
        (1, 4, 0, "should", None, ("other", "qux"), False, 1, 0), (1, 5, 0, "should", None, ("x",), False, 2, 0),
        (3, 0, -1, "should", None, (), None, 1, 0), (3, 1, 0, "should", None, (), None, 1, 2), (3, 2, 1, "must", None, ("a",), False, 1, 0), (3, 3, 1, "must", None, (), None, 2, 0),
        (3, 4, 3, "should", "title", ("b",), False, 2, 0), (3, 5, 3, "should", "title", ("c", "d"), True, 6, 0), (3, 6, 0, "not", None, ("e",), False, 1, 0),
    }


@pytest.mark.parametrize("query", ["(a", "a)", "()", "a AND", "OR a", "a AND OR b", "NOT", '"a', 'title:"a', "(a OR b))", "title: a", "+(", "-", "(" * 60 + "a" + ")" * 60])
def test_unbalanced_queries(spark, query):
    from skein.operators.grammar import nodes, query_error

    assert one(spark, query_error(F.lit(query), ["title"]))[0] == "validation.invalid_query"
    assert nodes(spark.createDataFrame([(1, query)], "qid long, query string"), F.col("query"), ["title"]).count() == 0


#: Titles and bodies, and queries with the sources that meet them.
TEXTS = {1: ("red fox", "the quick red fox runs"), 2: ("fox red", "a red and a fox"), 3: ("", "red red fox, red fox"), 4: ("blue", "the sea is blue"), 5: ("red", "blue fox")}
TREES = {
    '"red fox"': {1, 3}, 'title:"red fox"': {1}, '"fox red"': {2, 3}, '"red red fox red"': {3}, '"red blue"': set(), "(red OR sea) AND blue": {4, 5}, "red AND fox AND NOT blue": {1, 2, 3}, "-red": set(), "+fox -title:red": {3},
    'blue OR "quick red"': {1, 4, 5}, "+(quick sea) the": {1, 4}, "NOT (red OR sea)": set(), "fox NOT (blue OR runs)": {2, 3}, "body:(red AND fox)": {1, 2, 3}, "+red-fox": {1, 2, 3, 5}, "-(red AND blue) fox": {1, 2, 3}, "((red))": {1, 2, 3, 5}, "zzz OR sea": {4},
}


def test_trees_are_met(spark, tmp_path):
    from skein.operators import grammar, lexical

    sources = spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "source_id long, title string, body string")
    index = lexical.Index.build(sources, {"title": F.col("title"), "body": F.col("body")}, f"file://{tmp_path}/i")
    asked = spark.createDataFrame(list(enumerate(TREES)), "qid long, query string")
    found = grammar.scores(index, grammar.nodes(asked, F.col("query"), ["title", "body"])).collect()
    assert {q: {r["source_id"] for r in found if r["qid"] == k} for k, q in enumerate(TREES)} == TREES
    assert len(found) == sum(map(len, TREES.values()))
    few = grammar.scores(index, grammar.nodes(asked, F.col("query"), ["title", "body"]), allowed=sources.filter("source_id < 3").select("source_id"))
    assert {r["source_id"] for r in few.collect()} == {1, 2}
    assert grammar.scores(index, grammar.nodes(asked.limit(0), F.col("query"), ["title", "body"])).count() == 0
    # a phrase's score: the sum of its terms' rarity, and how often it stands
    idf = {r["term"]: r["factor"] for r in lexical.weights(index, asked.sparkSession.createDataFrame([("red",), ("fox",)], "term string"), fields=["body"]).collect()}
    mean = sum(len(b.replace(",", "").split()) for _, b in TEXTS.values()) / 5
    want = (idf["red"] + idf["fox"]) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 5 / mean))
    got = next(r["score"] for r in found if r["source_id"] == 3 and r["qid"] == 0)
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize("hops", [1, 3, 8])
def test_aliases_against_plain_loops(spark, hops):
    """Chains of all lengths, a star, cycles of all lengths with tails, and moves to itself."""
    from skein.operators.resolve import aliases

    moves = {f"c{i}": f"c{i + 1}" for i in range(20)} | {f"s{i}": "c3" for i in range(5)} | {"self": "self", "to": "self"}
    for n in (2, 3, 7, 8, 9):
        moves |= {f"r{n}.{i}": f"r{n}.{(i + 1) % n}" for i in range(n)} | {f"t{n}.{i}": f"t{n}.{i + 1}" if i < 3 else f"r{n}.1" for i in range(4)}

    def plain(source):
        path = [source]
        while len(path) <= hops and path[-1] in moves:
            path.append(moves[path[-1]])
            if path[-1] in path[:-1]:
                return source, path[-1], len(path) - 1, True
        return source, path[-1], len(path) - 1, False

    got = {tuple(r) for r in aliases(spark.createDataFrame(list(moves.items()), "source string, target string"), hops).collect()}
    assert got == set(map(plain, moves))


def test_raw_values_are_found_wherever_they_stand(spark):
    """At every place around the stretches' ends, among other characters, in long payloads."""
    from skein.operators.filters import RAW, STRETCH, escaped

    value = "Geheimnis-übér-alles"
    places = [0, 1, *range(STRETCH - 25, STRETCH + 5), 2 * STRETCH - 3, 9000]
    rows = [(k, "é" * n + value + "x" * (k % 40)) for k, n in enumerate(places)] + [(900, "é" * 5000), (901, value[:-1]), (902, value[: RAW - 1]), (903, "x" * 200_000 + value)]
    found = escaped(spark.createDataFrame(rows, "payload_id long, payload string"), spark.createDataFrame([(value,), (value[:10],)], "value string"))
    assert {r[0] for r in found.collect()} == {*range(len(places)), 903}
