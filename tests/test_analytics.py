import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import cooccur as CO
from lexigraph.operators import embed as EM
from lexigraph.operators import communities as CM
from lexigraph.operators import graph as G
from lexigraph.operators import lexicon as LX
from lexigraph.operators import quality as QL
from lexigraph.operators import similarity as SM
from lexigraph.operators import tfidf as TF
from lexigraph.operators import topics as TP


def test_window_counts_and_npmi(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "c"])], "doc_id long, tokens array<string>")
    win = CO.windows(docs, ["a", "b", "c"])
    pairs = CO.pair_counts(win)
    got = {(r["w1"], r["w2"]): r["n"] for r in pairs.collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 1}
    anc = {r["word"]: r["windows"] for r in CO.anchor_counts(win).collect()}
    assert anc == {"a": 2, "b": 1}
    sc = CO.npmi(pairs, CO.anchor_counts(win), 5, min_pair=1).collect()
    assert len(sc) == 1 and (sc[0]["w1"], sc[0]["w2"]) == ("a", "b")
    assert sc[0]["npmi"] == pytest.approx(1.756471, abs=1e-6)


def _tfidf_fixture(spark):
    docs = spark.createDataFrame([(1, "fire wall"), (2, "fire gas"), (3, "gas gas")], "doc_id long, text string")
    rows = TF.term_rows(docs, stop=[])
    vocab = TF.fit_vocabulary(rows, 3, 2, 0.85, 5000)
    return docs, rows, vocab


def test_tfidf_vocabulary_and_weights(spark):
    _, rows, vocab = _tfidf_fixture(spark)
    v = {r["term"]: r["idf"] for r in vocab.collect()}
    assert set(v) == {"fire", "gas"}
    assert v["fire"] == pytest.approx(1.287682, abs=1e-6)
    w = {(r["doc_id"], r["term"]): r["weight"] for r in TF.weights(rows, vocab).collect()}
    assert w[(1, "fire")] == pytest.approx(1.0)
    assert w[(2, "fire")] == pytest.approx(math.sqrt(0.5))
    assert w[(3, "gas")] == pytest.approx(1.0)


def test_cosine_block_and_index_agree(spark):
    _, rows, vocab = _tfidf_fixture(spark)
    vecs = SM.doc_vectors(rows, vocab)
    blk = {(r["doc_a"], r["doc_b"]): r["sim"] for r in
           SM.block_products(vecs, 2, 3, "pairs", lo=1e-12, n_shared=0).collect()}
    idx = {(r["doc_a"], r["doc_b"]): r["sim"] for r in
           SM.cosine_pairs_index(TF.weights(rows, vocab)).collect()}
    assert blk.keys() == idx.keys() == {(1, 2), (2, 3)}
    for k in blk:
        assert blk[k] == pytest.approx(idx[k]) == pytest.approx(0.707107, abs=1e-6)
    assert SM.exact_percentile(vecs, 2, 3, 0.95) == pytest.approx(0.707107, abs=1e-6)


def test_block_kernel_many_blocks_matches_numpy(spark):
    rng = np.random.default_rng(7)
    n, V = 61, 12
    X = rng.random((n, V)) * (rng.random((n, V)) < 0.3)
    X[5] = X[9]                      # an exact copy: ties at 1.0
    X[11] = 0.0                      # an empty vector
    rows = []
    for i in range(n):
        nz = np.nonzero(X[i])[0]
        norm = np.linalg.norm(X[i]) or 1.0
        rows.append((i, [int(j) for j in nz], [float(X[i, j] / norm) for j in nz], f"s{i % 3}"))
    vecs = spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>, src string")
    Xn = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
    S = Xn @ Xn.T
    iu = np.triu_indices(n, 1)
    want = float(np.percentile(S[iu], 95))
    got = SM.exact_percentile(vecs, V, n, 0.95, block_docs=16)   # 4 blocks, 10 block pairs
    assert got == pytest.approx(want, abs=1e-12)
    pairs = SM.block_products(vecs, V, n, "pairs", lo=1e-12, n_shared=0, block_docs=16).collect()
    assert len(pairs) == int((S[iu] > 1e-12).sum())
    for r in pairs[:50]:
        assert r["sim"] == pytest.approx(S[r["doc_a"], r["doc_b"]])
    knn = SM.knn_edges(vecs, V, n, k=5, floor=0.15, block_docs=16)
    assert knn.count() > 0


def test_silhouette_line(spark):
    pts = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [4.0]), (4, 1, [6.0])],
                                "vec_id long, label int, embedding array<float>")
    s = {r["vec_id"]: r["silhouette"] for r in QL.silhouette_points(pts, block_points=2).collect()}
    assert [round(s[i], 6) for i in (1, 2, 3, 4)] == [0.8, 0.75, 0.428571, 0.636364]
    c = QL.silhouette_clusters(QL.silhouette_points(pts)).collect()
    assert {r["label"]: r["n_members"] for r in c} == {0: 2, 1: 2}


def test_lexicon_scores(spark):
    lex = spark.createDataFrame([("fire", 2.0, 6.0, 4.0), ("safe", 8.0, 3.0, 6.0)],
                                "word string, valence double, arousal double, dominance double")
    docs = spark.createDataFrame([(1, "Fire, fire! Safe exit"), (2, "b2b 12")], "doc_id long, text string")
    r = LX.score_documents(docs, lex).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["valence"], r["arousal"], r["matched"]) == (4.0, 5.0, 3)
    assert r["dominance"] == pytest.approx(4.666667, abs=1e-6)
    assert r["coverage"] == pytest.approx(0.75)


def _triangles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    e = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double")
    return nodes, edges


def test_modularity_two_triangles(spark):
    nodes, edges = _triangles(spark)
    part = nodes.select("node", F.when(F.col("node") <= 3, 0).otherwise(1).alias("community"))
    assert G.modularity(nodes, edges, part, 1.0).first()["q"] == pytest.approx(0.357143, abs=1e-6)
    assert G.modularity(nodes, edges, part, 0.8).first()["q"] == pytest.approx(0.457143, abs=1e-6)


def test_louvain_finds_the_triangles(spark):
    nodes, edges = _triangles(spark)
    part = {r["node"]: r["community"] for r in CM.louvain(nodes, edges).collect()}
    assert part[1] == part[2] == part[3]
    assert part[4] == part[5] == part[6]
    assert part[1] != part[4]


def test_connected_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")
    comp = {r["node"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_rank_and_minmax_sizes(spark):
    df = spark.createDataFrame([("p", 10), ("q", 30), ("r", 20)], "word string, frequency long")
    rs = {r["word"]: (round(r["marker_size"], 6), r["text_size"]) for r in EM.rank_sizes(df).collect()}
    assert rs == {"p": (2.0, 7), "r": (25.391744, 11), "q": (40.0, 19)}
    mm = {r["word"]: round(r["size"], 6) for r in EM.minmax_sizes(df).collect()}
    assert mm == {"p": 3.0, "q": 18.0, "r": 12.361532}


def test_class_tfidf(spark):
    df = spark.createDataFrame([("A", ["fire", "fire", "wall"]), ("B", ["gas", "wall", "gas", "gas", "gas"])],
                               "cls string, tokens array<string>")
    got = {(r["cls"], r["term"]): round(r["score"], 6) for r in TP.class_tfidf(df, "cls").collect()}
    assert got == {("A", "fire"): 2.197225, ("A", "wall"): 1.098612,
                   ("B", "gas"): 2.772589, ("B", "wall"): 1.098612}


def test_category_first_rule_wins(spark):
    words = spark.createDataFrame([("fire",), ("point",), ("zebra",)], "word string")
    got = {r["word"]: r["category"] for r in EM.categorise(words, EM.rules_table(spark)).collect()}
    assert got == {"fire": "Fire & Safety", "point": "Buildings & Places", "zebra": "Other"}
