"""Queries go over all rows: what lies at high ids, late users and in long texts counts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import rows

from skein import suite


def test_exact_url(spark, tmp_path):
    """Every page is looked up once; pages of one address share the first of them."""
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None)], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in suite.QUERIES["exact_url"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 3), (2, 2, 1), (3, 1, 3), (4, 1, 3)}


def test_gold_is_all_vectors_of_a_label(spark, tmp_path):
    near = [(i, [1.0, i / 1000] + [0.0] * 14, 0 if i < 60 else 1) for i in (0, *(i for i in range(1, 90) if i % 5))]
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert suite.QUERIES["exact_top1"](spark, str(tmp_path)).collect()[0][0] == 1.0
    got = suite.QUERIES["ndcg_mrr_recall"](spark, str(tmp_path)).collect()
    n = sum(i < 60 for i, _, _ in near) - 1
    assert [(r["qid"], r["mrr"], r["recall_20"]) for r in got] == [(0, 1.0, round(20 / n, 6))]


@pytest.mark.parametrize("name", ("select_weight", "select_model", "select_light_tier", "select_quality_tier", "select_cell", "rotate_cursor", "purge_subsume"))
def test_high_ids_count(spark, tmp_path, name):
    spark.range(17017).select(F.col("id").alias("vec_id")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), F.col("id").cast("string")).alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for x in ("embeddings", "events", "documents"):
        con.execute(f"create view {x} as select * from '{tmp_path}/{x}.parquet/*.parquet'")
    assert rows(suite.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(suite.ORACLE_SQL[name]).df())


def test_search_conversations_whole_texts(spark, tmp_path):
    """Words after the first eighty characters reach the query and the titles: against looking for the word in
    plain Python."""
    ids = [50 * i for i in range(12)]
    said = {(i, 0): "-" * 90 + f" unique{i}" for i in ids}
    said |= {(i, 1): f"reply unique{(i + 50) % 600}" for i in ids} | {(i + 1, 0): f"other unique{i}" for i in ids}
    spark.createDataFrame([(i, n, "user", x) for (i, n), x in said.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["qid"], r["source_id"]) for r in suite.QUERIES["search_conversations"](spark, str(tmp_path)).filter("lexical_rank is not null").collect()}
    assert {q for q, _ in found} == set(ids)
    for q in ids:
        words = {k: set(f"{x} {said[k[0], 0]}".split()) for k, x in said.items() if k[0] % 97 != 5}
        assert {(q, f"{i}/{n}") for (i, n), w in words.items() if f"unique{q}" in w} == {x for x in found if x[0] == q}


def test_grid_has_all_windows(spark, small):
    got = suite.QUERIES["rrf_grid"](spark, small)
    assert {r[0] for r in got.select("window").distinct().collect()} == {40, 80, 100}
    cell = lambda w: {(r["k"], r["dense_weight"], r["qid"], r["source_id"], r["fusion_score"]) for r in got.filter(f"window = {w}").collect()}
    assert cell(100) != cell(80)


def test_no_query_states_a_subset():
    """No SQL keeps a few low ids or texts of some length."""
    for name, sql in suite.ORACLE_SQL.items():
        for part in ("vec_id < 200", "user_id < 60", "doc_id % 40", "page_id % 7 = 0", "strlen(d.text) <"):
            assert part not in sql, name
