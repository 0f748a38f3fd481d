"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import dropped, written

#: Rounds after which something must be wrong: two star rounds halve a path's length at least.
MOST_ROUNDS = 64


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    Alternates large and small stars: each node's neighbours are hung on the smallest of them. The
    minima are partial sums before their shuffle, and the join back to the edges can be split where
    one node has very many, so a star around a hot node stays spread. Each round is written to the
    shared folder, and the one before is deleted. Edges with a null end and loops link nothing; repeated edges count once."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()  # a null end: least = greatest
    e = written(e, "edges")
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("x"), "m").filter("x > m").distinct()
        least = large.groupBy("x").agg(F.min("m").alias("low")).withColumnRenamed("x", "n")
        hung = large.join(least, large["x"] == least["n"])
        small = hung.filter("m > low").select(F.col("m").alias("b"), F.col("low").alias("a")).union(least.select(F.col("n"), F.col("low")))
        last, e = e, written(small.select("a", "b").filter("a < b").distinct(), "edges")
        dropped(last)
        before, state = state, _state(e)
        if state == before:
            break
    found = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return found.union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
