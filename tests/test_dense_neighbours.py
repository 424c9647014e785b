"""Dense neighbours, against plain versions."""

import numpy as np
import pytest

from postwright.operators import search


@pytest.mark.parametrize(("passages", "k", "decimals"), [(4096, 5, 8), (16, 5, 1), (16, 30, 8), (4, 60, 8)])
def test_nearest_passages_by_slices(spark, monkeypatch, passages, k, decimals):
    """F1: products in single precision leave out no neighbour, ties by id included."""
    rng = np.random.default_rng(passages + k)
    q, d = np.round(rng.normal(size=(40, 8)) * 100, decimals), np.round(rng.normal(size=(50, 8)), decimals)
    d[10:20] = d[0]  # ties
    monkeypatch.setattr(search, "PASSAGES", passages)
    monkeypatch.setattr(search, "PAIRS", 7)
    monkeypatch.setattr(search, "SLICE_CELLS", 64)
    frame = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>")
    got = {(r.qid, r["rank"]): (r.pid, round(r.score, 6)) for r in search.dense_search(frame(q, "qid"), frame(d, "pid").repartition(2), 8, k).collect()}
    want = {}
    for i, v in enumerate(q):
        score = np.round(np.einsum("ij,j->i", d, v), 8)
        for r, j in enumerate(np.lexsort((np.arange(50), -score))[:k]):
            want[i, r + 1] = (int(j), round(float(score[j]), 6))
    assert got == want


def test_a_slice_of_a_search_leaves_few_pairs():
    """pairs that are made in full are few, and most of a slice makes none."""
    rng = np.random.default_rng(2)
    q, d = rng.normal(size=(20, 16)), rng.normal(size=(6000, 16))
    near, made = search._Nearest(20, 10), 0
    for at in range(0, 6000, 1000):
        x = d[at : at + 1000]
        before = sum(len(w[0]) for w in near.waiting)
        near.merge, merge = lambda: None, near.merge
        near.add(q, x, np.arange(at, at + 1000), (q.astype(np.float32) @ x.T.astype(np.float32)), np.full(20, 1e-3))
        made += sum(len(w[0]) for w in near.waiting) - before
        near.merge = merge
        near.merge()
    assert made < 20 * 10 * 6
    assert [near.pid[near.query == i].tolist() for i in range(20)] == [np.argsort(-np.round(d @ v, 8), kind="stable")[:10].tolist() for v in q]
