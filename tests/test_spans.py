"""Blocks made from sources are those of an index, and neither their build nor a search moves postings one by one."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import lexical, pruned
from skein.plans.storage import new_folder

def fields():
    return {"title": F.lit("the"), "body": F.coalesce("text", F.lit(""))}


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("the of and to in rare".split(), [9, 9, 9, 9, 9, 0.3], k=rng.randrange(60)))) for i in range(400)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (None, "rare one"), (7, "rare of the"), (7, "the of rare"), (8, "rare")], "source_id long, text string").repartition(3)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("qid", "rank", "source_id", "score").collect())


def test_from_sources_equals_the_full_sum(spark, sources):
    index = lexical.Index.build(sources, fields(), new_folder(spark, "index"))
    blocks = pruned.Blocks.of(sources, fields(), new_folder(spark, "blocks"), span=16)
    for name in ("terms", "stats"):
        assert {tuple(sorted(r.asDict().items())) for r in getattr(blocks.index, name).collect()} == {tuple(sorted(r.asDict().items())) for r in getattr(index, name).collect()}
    own = blocks.blocks.select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.source_id", F.round("p.weight", 9))
    average = index.postings.join(index.stats, "field")
    want = average.select("field", "term", "source_id", F.round(lexical.term_score(F.col("tf"), F.col("length"), F.col("average")), 9))
    assert sorted(map(str, map(tuple, own.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert blocks.blocks.agg(F.max("size")).first()[0] <= 40
    asked = spark.createDataFrame([(1, "rare one"), (2, "the of"), (3, "rare the the"), (4, "nothing"), (5, None)], "qid long, text string")
    for limit in (1, 7, 500):
        assert rows(pruned.search(blocks, asked, F.col("text"), limit)) == rows(lexical.search(index, asked, F.col("text"), limit))


def test_hits_do_not_move(spark, sources):
    """The sum of hits follows blocks dealt by span in the same stage: a source's sums need no exchange of their own."""
    blocks = pruned.Blocks.of(sources, fields(), new_folder(spark, "blocks"), span=16)
    asked = spark.createDataFrame([(1, "rare one"), (2, "the of")], "qid long, text string")
    plan = pruned.search(blocks, asked, F.col("text"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(span" in plan and "hashpartitioning(qid#" in plan
    assert not any("source_id" in line for line in plan.splitlines() if "hashpartitioning(" in line)
