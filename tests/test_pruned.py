"""The best sources from blocks with bounds are those of the full sum."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import lexical, pruned
from skein.plans.storage import new_folder


@pytest.fixture(scope="module")
def index(spark):
    """Most sources are long and share common words; a few short ones, side by side, have the rare words; sources 300 to 339 are equal."""
    rng = random.Random(5)
    text = lambda i: "rare gem" if i in (40, 41, 42) else "same words here" if 300 <= i < 340 else " ".join(rng.choices("the of and to in rare".split(), [9, 9, 9, 9, 9, 0.3], k=rng.randrange(5, 40)))
    rows = [(i, text(i)) for i in range(400)] + [(900, None), (901, "")]
    sources = spark.createDataFrame(rows, "source_id long, text string")
    return lexical.Index.build(sources, {"title": F.lit("the"), "body": F.coalesce("text", F.lit(""))}, new_folder(spark, "index"))


@pytest.fixture(scope="module")
def blocks(spark, index):
    return pruned.Blocks.build(index, new_folder(spark, "blocks"), span=16)


def rows(df):
    return sorted((r["qid"], r["rank"], r["source_id"], r["score"]) for r in df.select("qid", "rank", "source_id", "score").collect())


def asked(spark):
    return spark.createDataFrame([(1, "rare gem"), (2, "the of"), (3, "same words"), (4, "nothing"), (5, None), (6, "rare the the")], "qid long, text string")


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_equals_the_full_sum(spark, index, blocks, limit):
    got = rows(pruned.search(blocks, asked(spark), F.col("text"), limit))
    assert got == rows(lexical.search(index, asked(spark), F.col("text"), limit))
    assert {q for q, *_ in got} == {1, 2, 3, 6}


def test_filters_fields_and_many_terms(spark, index, blocks, monkeypatch):
    allowed = spark.createDataFrame([(i,) for i in range(0, 400, 7)], "source_id long")
    monkeypatch.setattr(lexical, "FEW_TERMS", 1)
    monkeypatch.setattr(pruned, "held", lambda df: (df, False))
    more = {"profile": "metadata_boost_v1", "allowed": allowed, "fields": ["title", "body"]}
    assert rows(pruned.search(blocks, asked(spark), F.col("text"), 5, **more)) == rows(lexical.search(index, asked(spark), F.col("text"), 5, **more))


def test_spans_out_of_reach_are_not_summed(spark, index, blocks):
    report = {}
    one = asked(spark).filter("qid = 1")
    got = rows(pruned.search(blocks, one, F.col("text"), 3, fields=["body"], report=report))
    assert [r[2] for r in got] == [40, 41, 42]
    assert report["second"] == 0 and report["first"] < report["postings"]


def test_spans_are_bounded_and_hold_all(index, blocks):
    assert blocks.blocks.agg(F.max("size")).first()[0] <= 40
    assert blocks.blocks.agg(F.sum("size")).first()[0] == index.postings.count()
