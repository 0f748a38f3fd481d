import numpy as np
import pytest

from skein.operators import models


def test_pooling():
    states, mask = np.arange(12.0).reshape(4, 3), np.array([1, 1, 1, 0])
    assert models.pooled(states, mask, "cls").tolist() == [0, 1, 2]
    assert models.pooled(states, mask, "last").tolist() == [6, 7, 8]
    assert models.pooled(states, mask, "mean").tolist() == [3, 4, 5]


def test_fitted_ends_with_a_token():
    assert models.fitted("one two, three", 3) == "one two,"
    assert models.fitted("one", 3) == "one"
    assert models.fitted("", 3) == ""


def test_pairs_share_their_window():
    q, d = models.pair_texts("q " * 200, "d " * 1000)
    assert len(q.split()) == 96
    assert len(d.split()) == 288
    assert len(models.pair_texts("q", "d " * 1000)[1].split()) == 383


def test_every_row_is_in_one_batch():
    texts = ["a b", "c", "x " * 300, "", "d e f", "y " * 200, "g"]
    batches = list(models.batches_by_length(texts))
    assert sorted(i for b in batches for i in b) == list(range(len(texts)))
    assert [2] in batches
    assert all(len(b) <= models.BATCH for b in batches)


def test_staging_resumes(spark):
    chunks = spark.createDataFrame([(1, "h1", "a b"), (2, "h2", None), (3, "h3", "c")], "chunk_id long, context_hash string, body string")
    done = models.staged(chunks.limit(0), chunks, models.HashingEncoder(8))
    assert done.count() == 0
    first = models.staged(chunks.filter("chunk_id < 3"), done, models.HashingEncoder(8)).cache()
    rest = models.staged(chunks, first, models.HashingEncoder(8))
    assert [r["chunk_id"] for r in rest.collect()] == [3]
    state = models.complete(chunks, first.union(rest)).first()
    assert (state["total"], state["completed"], state["extra"]) == (3, 3, 0)


def test_vector_that_is_not_finite_is_an_error(spark):
    class Broken:
        dimension = 2

        def encode(self, texts):
            return np.full((len(texts), 2), np.nan)

    rows = spark.createDataFrame([(1, "a")], "id long, body string")
    with pytest.raises(Exception, match="not finite"):
        models.embedded(rows, Broken(), "body", ["id"]).collect()
