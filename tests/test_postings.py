"""Postings are made where a source is read; rows of one id are still one source."""

from collections import Counter

from pyspark.sql import functions as F

from skein.operators import lexical

ROWS = [(1, "B a b\na"), (2, None), (3, "x"), (3, "y"), (3, "y z"), (4, ""), (None, "n"), (None, "n"), (5, " ".join(["w"] * 300 + ["v"]))]


def test_equals_plain_counts(spark):
    sources = spark.createDataFrame(ROWS, "source_id long, text string").repartition(3)
    want, places = Counter(), {}
    for i, x in ROWS:
        words = (x or "").lower().split()
        for k, w in enumerate(words):
            want[i, w, len(words)] += 1
            places.setdefault((i, w, len(words)), []).append(k)
    for positions in (True, False):
        got = lexical.postings(sources, {"body": F.col("text")}, positions=positions).collect()
        assert len(got) == len(want)
        assert {(r["source_id"], r["term"], r["length"]): r["tf"] for r in got} == want
    got = lexical.postings(sources, {"body": F.col("text")}).collect()
    assert {(r["source_id"], r["term"], r["length"]): r["positions"] for r in got} == {k: sorted(v) for k, v in places.items()}


def test_no_shuffle(spark):
    sources = spark.createDataFrame([r for r in ROWS if r[0] in (1, 2, 4, 5)], "source_id long, text string")
    plan = lexical.postings(sources, {"body": F.col("text")}, positions=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
