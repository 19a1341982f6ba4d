"""Reduction, topics and word vectors on planted structure."""
import numpy as np
import pytest

from lexigraph.operators import reduce as RD
from lexigraph.operators import topics as TP

from .test_kernels import sparse


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    X = rng.random((50, 14)) * (rng.random((50, 14)) < 0.5)
    X[4] = 0.0
    return X


def test_svd_equals_numpy(spark, rows):
    vecs = sparse(spark, rows)
    scores, vk, s, ratio = RD.svd_scores(vecs, 14, 5)
    U, S, Vt = np.linalg.svd(rows, full_matrices=False)
    assert np.allclose(s, S[:5], atol=1e-6)
    assert np.allclose(vk.T @ vk, np.eye(5), atol=1e-6)
    assert np.allclose(np.abs((vk * Vt[:5].T).sum(axis=0)), 1, atol=1e-6)
    got = np.stack([r["svd"] for r in scores.orderBy("doc_id").collect()])
    assert np.allclose(got, rows @ vk, atol=1e-9)
    assert np.allclose(ratio, (rows @ vk).var(axis=0) / rows.var(axis=0).sum(), atol=1e-9)


def test_pca_and_axis_terms(spark, rows):
    vecs = sparse(spark, rows)
    scores, vk, _, _ = RD.svd_scores(vecs, 14, 5)
    coords, comps, ratio = RD.pca3(scores)
    X = rows @ vk
    _, S, Vt = np.linalg.svd(X - X.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs((comps * Vt[:3]).sum(axis=1)), 1, atol=1e-6)
    assert np.allclose(ratio, (S ** 2 / (S ** 2).sum())[:3], atol=1e-6)
    xyz = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in coords.orderBy("doc_id").collect()])
    assert np.allclose(xyz, (X - X.mean(axis=0)) @ comps.T, atol=1e-6)
    vocabulary = spark.createDataFrame([(i, f"t{i}") for i in range(14)], "term_idx int, term string")
    load = comps @ vk.T
    for r in RD.axis_terms(vk, comps, vocabulary, 3).collect():
        order = np.argsort(-load[r["axis"] - 1] if r["side"] == "+" else load[r["axis"] - 1])
        assert r["term"] == f"t{order[r['rank'] - 1]}" and r["loading"] == pytest.approx(load[r["axis"] - 1][order[r["rank"] - 1]])


def test_lda_parts_two_vocabularies(spark):
    rng = np.random.default_rng(2)
    docs = [(i, [f"{'ab'[i % 2]}{rng.integers(12)}" for _ in range(40)]) for i in range(60)] + [(99, ["unseen"])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    assign, topics = TP.lda_topics(df, k=2, passes=30, max_df=0.9)
    got = {r["doc_id"]: r["topic_num"] for r in assign.collect()}
    assert got[99] is None
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and len({got[i] for i in range(1, 60, 2)}) == 1 and got[0] != got[1]
    words = {r["topic_num"]: r["keywords"] for r in topics.collect()}
    assert all(w[0] == words[got[0]][0] for w in words[got[0]].split(", ") if w)


def test_lda_reads_its_vocabulary_once(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizerModel
    read, plain = [], CountVectorizerModel.vocabulary.fget
    monkeypatch.setattr(CountVectorizerModel, "vocabulary", property(lambda cv: read.append(1) or plain(cv)))
    rng = np.random.default_rng(2)
    docs = [(i, [f"{'pq'[i % 2] * 3}{rng.integers(12)}" for _ in range(40)]) for i in range(20)]
    _, topics = TP.lda_topics(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), k=2, passes=2, max_df=0.9)
    assert sum(len(r["keywords"].split(", ")) for r in topics.collect()) == 10
    assert len(read) == 1


def test_density_topics_find_blobs_and_outliers(spark):
    rng = np.random.default_rng(5)
    blobs = np.concatenate([rng.normal(c, 0.05, (20, 4)) for c in (0.0, 3.0)])
    points = np.concatenate([blobs, [[50.0, 0, 0, 0], [0, -60.0, 0, 0]]])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["topic"] for r in TP.density_topics(df, components=None, eps_quantile=0.95).collect()}
    assert got[40] == got[41] == -1
    assert len({got[i] for i in range(20)}) == 1 and len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[20]


def test_reduction_merges_alike_topics_to_the_target(spark):
    rows = [("a", ["x", "y", "z"] * 3), ("b", ["x", "y", "z"] * 2 + ["q"]), ("c", ["m", "n"] * 4), ("d", ["u", "v"] * 4)]
    df = spark.createDataFrame(rows, "cls string, tokens array<string>")
    got = {r["cls"]: r["topic"] for r in TP.reduce_topics(df, "cls", 3).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}
