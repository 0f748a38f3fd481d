"""Neighbours over a layout by centres are those of the full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import clusters, dense
from skein.plans.storage import new_folder


def data(spark, strings=False):
    """Forty groups, a hot group of equal vectors, nulls, zeros, and sources with several chunks."""
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 10, (40, 6))
    rows = [(int(i % 900), (middle[i % 40] + rng.normal(0, 0.3, 6)).tolist()) for i in range(1200)]
    rows += [(2000 + i, middle[0].tolist()) for i in range(600)] + [(5000, None), (5001, [0.0] * 6)]
    asked = [(int(i), (middle[i % 40] + rng.normal(0, 0.3, 6)).tolist()) for i in range(0, 50, 3)] + [(2003, middle[0].tolist()), (77, None)]
    name = (lambda i: f"s{i:05d}é") if strings else (lambda i: i)
    kind = "string" if strings else "long"
    return spark.createDataFrame([(name(i), v) for i, v in asked], f"qid {kind}, query_vector array<double>"), spark.createDataFrame([(name(i), v) for i, v in rows], f"source_id {kind}, vector array<double>").repartition(3)


def rows(df):
    return sorted((r["qid"], r["rank"], r["source_id"], r["value"]) for r in df.select("qid", "rank", "source_id", "value").collect())


@pytest.mark.parametrize(("metric", "strings"), [("l2", False), ("cosine", True)])
def test_equals_the_full_scan(spark, metric, strings):
    q, c = data(spark, strings)
    path = new_folder(spark, "layout")
    layout = clusters.Layout.build(c, path, metric, block=64, cells=40)
    sizes = [r["n"] for r in layout.rings.groupBy("block").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) >= 20 and max(sizes) < 200  # the hot group is spread
    assert rows(clusters.nearest(q, layout, 20, exclude_same=True)) == rows(dense.nearest(q, c, 20, metric, exclude_same=True))
    report, one = {}, q.filter(F.col("qid").cast("string").rlike("0?3[^0-9]*$") & ~F.col("qid").cast("string").contains("2003"))
    assert rows(clusters.nearest(one, layout, 20, report=report)) == rows(dense.nearest(one, c, 20, metric))
    assert 0 < report["first"] + report["second"] < report["blocks"]
    opened = clusters.Layout.open(spark, path, f"source_id {'string' if strings else 'long'}, vector array<double>")
    allowed = c.filter(F.crc32(F.col("source_id").cast("string")) % 3 == 0).select("source_id")
    assert rows(clusters.nearest(q, opened, 5, allowed)) == rows(dense.nearest(q, c, 5, metric, allowed))


def test_blocks_of_queries_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(clusters, "MOST_NAMED", 3)
    q, c = data(spark)
    layout = clusters.Layout.build(c, new_folder(spark, "layout"), block=64, cells=10)
    assert rows(clusters.nearest(q, layout, 3)) == rows(dense.nearest(q, c, 3))


def test_a_filter_that_leaves_few_looks_everywhere(spark):
    q, c = data(spark)
    layout = clusters.Layout.build(c, new_folder(spark, "layout"), block=64)
    few = spark.createDataFrame([(3,), (2100,), (899,)], "source_id long")
    report = {}
    got = rows(clusters.nearest(q, layout, 5, few, report=report))
    assert got == rows(dense.nearest(q, c, 5, allowed=few)) and len(got) == 3 * 18
    assert report["first"] + report["second"] == report["blocks"]


def test_empty_and_wrong(spark):
    q, c = data(spark)
    none = clusters.Layout.build(c.limit(0), new_folder(spark, "layout"))
    assert none.rings.count() == 0
    layout = clusters.Layout.build(c.filter("source_id < 30"), new_folder(spark, "layout"))
    assert clusters.nearest(q.limit(0), layout).count() == 0
    wrong = spark.createDataFrame([(1, [1.0])], "qid long, query_vector array<double>")
    with pytest.raises(ValueError, match="dimension"):
        clusters.nearest(wrong, layout)
    mixed = c.union(spark.createDataFrame([(9, [1.0])], c.schema))
    with pytest.raises(Exception, match="dimension"):
        clusters.Layout.build(mixed, new_folder(spark, "layout"))
