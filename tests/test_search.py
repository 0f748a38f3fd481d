"""The whole search over conversations: every turn is a source, and all its lexical hits are right."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import suite
from skein.operators import bulk, dense, grammar, lexical
from skein.plans.storage import new_folder, written


def conversations(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return suite.QUERIES["search_conversations"](spark, str(path)).collect()


def test_turns_without_a_first_turn_are_sources(spark, tmp_path):
    """Turns of a conversation whose first turn is missing, and turns without a number or a conversation, are found;
    a first turn that is there twice repeats nothing."""
    rows = [(50, 0, "user", "zebra"), (7, 3, "user", "a zebra"), (8, None, "user", "the zebra"), (None, 2, "user", "no zebra"), (9, 0, "user", "other"), (9, 0, "user", "other"), (9, 1, "user", "one zebra")]
    got = conversations(spark, tmp_path, rows)
    assert sorted(r["source_id"] for r in got if r["lexical_rank"]) == ["/2", "50/0", "7/3", "8/", "9/1"]
    assert {r["qid"] for r in got} == {50}


@pytest.fixture(scope="module")
def index(spark):
    """Many equal texts, so that ties at a limit are decided by ids; ids are texts of several lengths."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("the of and to in rare gem".split(), [9, 9, 9, 5, 5, 0.5, 0.2], k=rng.randrange(1, 30))) for _ in range(60)]
    rows = [(f"{i}/{i % 7}", texts[i % 60] if i % 3 else "the of rare") for i in range(700)] + [("x", None)]
    sources = spark.createDataFrame(rows, "source_id string, text string")
    return lexical.Index.build(sources, {"title": F.lit("the title"), "body": F.coalesce("text", F.lit(""))}, new_folder(spark, "index"), phrases=True)


@pytest.mark.parametrize("small", (False, True))
@pytest.mark.parametrize("limit", (1, 7, 2000))
def test_bulk_equals_the_trees(spark, index, monkeypatch, limit, small):
    """Queries of optional words in bulk, others as trees, give what trees alone give, also with tiny blocks, strips and tiles."""
    monkeypatch.setattr(grammar, "FEW_TERMS", 3)
    taken = []
    made = bulk.best
    monkeypatch.setattr(bulk, "best", lambda index, words, *a, **b: (taken.append({r["qid"] for r in words.collect()}), made(index, words, *a, **b))[1])
    if small:
        for module, name, value in ((bulk, "QUERY_BLOCK", 2), (dense, "STRIP", 16), (bulk, "COMMON", 1), (bulk, "HITS", 20), (dense, "GATHERED", 100)):
            monkeypatch.setattr(module, name, value)
    said = {1: "the of the", 2: "rare gem", 3: "title:the of^2 gem^0.5", 4: "+the -of", 5: '"the of" rare', 6: "nothing here", 7: "(the rare) gem", 8: "in^0 to", 9: "the"}
    asked = spark.createDataFrame(list(said.items()), "qid long, query string")
    parsed = written(grammar.nodes(asked, F.col("query"), ["title", "body"]), "parsed")
    allowed = spark.createDataFrame([(f"{i}/{i % 7}",) for i in range(700) if i % 11], "source_id string")
    rows = lambda df: sorted((r["qid"], r["rank"], r["source_id"], r["score"]) for r in df.collect())
    got = rows(grammar.best(index, parsed, limit, allowed=allowed, fields=["title", "body"]))
    assert got == rows(lexical.ranked(grammar.scores(index, parsed, allowed=allowed, fields=["title", "body"]), limit))
    assert taken == [{1, 2, 3, 6, 9}]


def test_a_strip_has_no_row_for_each_hit():
    """Of a strip whose sources all hit all queries, only the best few are offered."""
    words = bulk.Words(300, np.repeat(np.arange(300), 2), np.tile([5, 9], 300), np.ones(600))
    score = words.scores(400, np.repeat(np.arange(400), 2), np.tile([5, 9], 400), np.linspace(1, 2, 800))
    assert (score > 0).all() and np.allclose(score[:, 0], np.linspace(1, 2, 800).reshape(400, 2).sum(1))
    top = bulk.Top(np.arange(300), 10)
    top.strip(score, np.arange(1000, 1400))
    assert top.size == 3000
    top.cut()
    top.strip(np.zeros((400, 300)), np.arange(400, 800))
    top.strip(np.full((400, 300), score[390, 0]), np.arange(2000, 2400))  # as good as the last of each query, but later
    assert top.size == 3000
    top.strip(np.full((1, 300), score[390, 0]), np.array([7]))
    assert top.size == 3300
    q, _, ids = top.rows()
    assert len(q) == 3000 and (ids == 7).sum() == 300 and not (ids == 1390).any()
