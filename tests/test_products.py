"""The block product: frequent and rare terms, repeated terms, bounded frames,
passes over all pairs."""
import pickle

import numpy as np
import pandas as pd
import pytest

from lexigraph.operators import similarity as SM


def _rows(rng, n, V, p):
    X = rng.random((n, V)) * (rng.random((n, V)) < p)
    return X, pd.DataFrame({"doc": np.arange(n), "idx": [np.flatnonzero(x) for x in X], "val": [x[x > 0] for x in X], "src": "s"})


@pytest.mark.parametrize("share, most", [(0.0, 5), (0.2, 1), (2.0, 7), (2.0, 10_000)])
def test_split_product_equals_matrices(monkeypatch, share, most):
    monkeypatch.setattr(SM, "DENSE_SHARE", share)
    monkeypatch.setattr(SM, "LIGHT_PRODUCTS", most)
    rng = np.random.default_rng(5)
    X, left = _rows(rng, 30, 40, np.linspace(0.02, 0.9, 40))
    Y, right = _rows(rng, 17, 40, np.linspace(0.02, 0.9, 40))
    X[4] = 0.0
    left.at[4, "idx"] = left.at[4, "val"] = None
    X[6] = 0.0
    X[6, [3, 9]] = 0.5, 0.25
    left.at[6, "idx"], left.at[6, "val"] = np.array([3, 3, 9]), np.array([0.7, 0.5, 0.25])  # the last value of a term counts
    L, R = SM._Block(SM._held(left), 40), SM._Block(SM._held(right), 40)
    assert np.allclose(SM._product(L, R), X @ Y.T, atol=1e-14) and np.allclose(SM._product(L, L), X @ X.T, atol=1e-14)
    assert [i.tolist() for i, _ in L.rows()][6] == [3, 3, 9]


def test_pairs_leave_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(SM, "PAIR_ROWS", 50)
    X, rows = _rows(np.random.default_rng(6), 40, 5, 1.0)
    held = pickle.dumps([SM._held(rows.iloc[:25]), SM._held(rows.iloc[25:])])
    met = pd.DataFrame({"pi": [0], "pj": [0], "left": [held], "right": [held]})
    frames = list(SM._kernel("sims", 5, 0, 0.0, 1e-12, 2.0, 0, 8, ())(iter([met])))
    assert max(map(len, frames)) <= 50 and [*frames[0].columns] == ["doc_a", "doc_b", "sim"]
    got = pd.concat(frames)
    assert len(got) == 40 * 39 // 2 == len(got[["doc_a", "doc_b"]].drop_duplicates()) and (got["doc_a"] < got["doc_b"]).all()
    assert np.allclose(got["sim"], (X @ X.T)[got["doc_a"], got["doc_b"]])
    counted = list(SM._kernel("hist", 5, 0, 0.0, 0.0, 2.0, 0, 8, ())(iter([met, met])))
    assert len(counted) == 1 and counted[0]["n"].sum() == 2 * 40 * 39 // 2  # a task's counts leave it once


@pytest.mark.parametrize("stored", [1_000_000, 3])
def test_percentile_stores_the_values_of_one_bin(spark, monkeypatch, stored):
    X, rows = _rows(np.random.default_rng(8), 50, 12, 0.4)
    X /= np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
    X[20:30] = X[0]  # equal values
    vecs = spark.createDataFrame([(i, np.flatnonzero(x).tolist(), x[x > 0].tolist()) for i, x in enumerate(X)], "doc_id long, idx array<int>, val array<double>")
    monkeypatch.setattr(SM, "STORED_PAIRS", stored)
    made, products = [], SM.block_products
    monkeypatch.setattr(SM, "block_products", lambda *a, **b: made.append(a[3]) or products(*a, **b))
    v = (X @ X.T)[np.triu_indices(50, 1)]
    for q in (0.0, 0.5, 0.95, 1.0):
        made.clear()
        assert SM.exact_percentile(vecs, 12, 50, q, block_docs=9) == pytest.approx(float(np.percentile(v, 100 * q)), abs=1e-12)
        assert stored == 3 or len(made) <= 4 and made.count("hist") <= 1
    assert len(v) == 1225
