"""What a task of the nearest-neighbour search holds does not grow with its queries, and its bounds lose nothing."""

import tracemalloc

import numpy as np
import pytest

from skein import suite
from skein.operators import dense


def told(ids, queries, vectors, metric, limit):
    best = dense.Best(ids, dense.Scorer(queries, metric), limit, True)
    for i in range(0, len(vectors), dense.STRIP):
        best.add(np.arange(i, min(i + dense.STRIP, len(vectors))), vectors[i : i + dense.STRIP])
    return best.rows()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equals_all_pairs(metric, monkeypatch):
    """Equal vectors, ties after rounding, a vector without length, one that is no number, tiles of a few queries."""
    monkeypatch.setattr(dense, "TILE", 7 * dense.STRIP)
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (1500, 8)).round(1)
    v[700:800], v[3], v[900] = v[50] + 1e-8, 0, np.nan
    ids = np.arange(0, 1500, 25)
    q, value, found = told(ids, v[ids], v, metric, 20)
    scorer = dense.Scorer(v[ids], metric)
    prepared = scorer.prepared(v)
    for n, i in enumerate(ids):
        all_ = scorer.value(prepared, np.arange(1500), np.full(1500, n))
        order = [k for k in np.lexsort((np.arange(1500), all_)) if k != i and not np.isnan(all_[k])][:20]
        assert found[q == n].tolist() == order
        assert value[q == n].tolist() == all_[order].tolist()


def test_memory_is_bounded():
    """Before, the first strip compared anew with all queries held 512 x 2,000 x 64 components several times."""
    v = np.random.default_rng(1).normal(0, 1, (3000, 64))
    tracemalloc.start()
    told(np.arange(2000), v[:2000], v, "cosine", 80)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6


@pytest.mark.parametrize("name", ["knn_cosine", "knn_filtered", "lexical_guard", "rrf_grid", "gold_hit", "rrf_equal", "exact_top1", "rescue_harm", "knn_l2"])
def test_full_block_of_what_a_query_asks(spark, small, monkeypatch, name):
    """A task whose block of queries is full. Before, its first strip held 512 x 4,096 pairs of 64 components several times:
    2,250 MB by tracemalloc (640 MB of 16 components)."""
    asked, nearest = [], dense.nearest

    def told_of(queries, chunks, limit=80, metric="l2", allowed=None, exclude_same=False, dimension=None):
        asked.append((limit, metric, exclude_same, dimension))
        return nearest(queries, chunks, limit, metric, allowed, exclude_same, dimension)

    monkeypatch.setattr(dense, "nearest", told_of)
    suite.QUERIES[name](spark, small)
    assert asked
    v = np.random.default_rng(2).normal(0, 1, (dense.QUERY_BLOCK, 64))
    for limit, metric, exclude_same, dimension in asked:
        tracemalloc.start()
        best = dense.Best(np.arange(len(v)), dense.Scorer(v[:, :dimension], metric), limit, exclude_same)
        for i in range(0, 4 * dense.STRIP, dense.STRIP):
            best.add(np.arange(i, i + dense.STRIP), v[i : i + dense.STRIP, :dimension])
        found = best.rows()[0]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (np.bincount(found, minlength=len(v)) == limit).all()
        assert most < 200e6
