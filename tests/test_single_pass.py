"""Texts are tokenised once, lengths are taken once for each row, windows once."""

import numpy as np
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions.arrays import with_value_counts
from lexigraph.operators import cooccur as CO
from lexigraph.operators import embed as EM
from lexigraph.operators import similarity as SM
from lexigraph.operators import tfidf as TF
from lexigraph.operators import topics as TP


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_tokenise_once(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "doc_id long, text string")
    got = docs.select("doc_id", TF.terms("text", ["x"]).alias("t"))
    assert _plan(got).count("regexp_extract_all") == 1
    assert {r["doc_id"]: r["t"] for r in got.collect()} == {1: ["one", "two", "three", "one two", "two three"], 2: None, 3: []}
    both = spark.createDataFrame([(["a", "b"],)], "t array<string>").select(T.bigrams("t").alias("b")).first()
    assert both["b"] == ["a b"]


def test_norms_are_taken_once(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "b", 2)], "doc_id long, term string, tf long")
    words = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "term string, term_idx int, idf double")
    v = SM.doc_vectors(rows, words)
    assert "transform(array(SQRT(aggregate(" in _plan(v)
    assert {r["doc_id"]: (r["idx"], r["val"]) for r in v.collect()} == {1: ([0, 1], [0.6, 0.8]), 2: ([1], [1.0])}
    points = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    u = EM.unit_vectors(points, "id", "v")
    assert "transform(array(SQRT(aggregate(" in _plan(u)
    assert {r["doc_id"]: r["val"] for r in u.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}


def test_value_counts_with_nulls(spark):
    d = spark.createDataFrame([(["b", None, "a", "b", None],), ([],), (None,)], "t array<string>")
    got = [r["c"] for r in with_value_counts(d, "t", "c").select("c").collect()]
    assert [(x["term"], x["tf"]) for x in got[0]] == [(None, 2), ("a", 1), ("b", 2)] and not got[1] and not got[2]


def test_window_counts_equal_separate_counts(spark):
    docs = spark.createDataFrame([(1, ["a", "z", "b", "a", "c"]), (2, ["c", "a"]), (3, []), (4, None), (5, ["z"])], "doc_id long, tokens array<string>")
    win = CO.windows(docs, ["a", "b", "c"])
    pairs, anchors = CO.window_counts(win)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, CO.pair_counts(win).collect()))
    assert sorted(map(tuple, anchors.collect())) == sorted(map(tuple, CO.anchor_counts(win).collect()))
    assert pairs.where(F.col("w1") >= F.col("w2")).isEmpty()


def test_sentences_and_class_counts_tokenise_once(spark):
    docs = spark.createDataFrame([(1, "x", "alpha beta gamma. delta\nalpha beta delta gamma"), (2, "y", None), (3, None, "alpha alpha")], "doc_id long, source string, text string")
    s = EM.sentence_tokens(docs, stop=[])
    assert _plan(s).count("regexp_extract_all") == 1
    assert sorted((r["doc_id"], r["tokens"]) for r in s.select("doc_id", "tokens").collect()) == [(1, ["alpha", "beta", "delta", "gamma"]), (1, ["alpha", "beta", "gamma"])]
    c = TP.class_counts(docs.select("source", T.tokens_words("text").alias("tokens")), "source")
    assert _plan(c).count("regexp_extract_all") == 1
    assert {(r["source"], r["term"]): r["tf"] for r in c.collect()} == {("x", "alpha"): 2, ("x", "beta"): 2, ("x", "gamma"): 2, ("x", "delta"): 2, (None, "alpha"): 2}


def test_block_pairs_do_not_shuffle_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, [0.0] * 4)], "id long, v array<double>")
    u = EM.unit_vectors(points, "id", "v")
    found = SM.block_products(u, 4, 61, "topk", k=3, floor=-2.0, n_shared=0, block_docs=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan  # no vector is copied for the blocks it meets
    blocks = SM.packed_blocks(u, 61, block_docs=9)
    assert blocks.count() > 6 and blocks.select("blk").distinct().count() == blocks.count()
    near = {(r["id"], r["rank"]): r["neighbour"] for r in EM.nearest(points, "id", "v", 3, block_docs=9).collect()}
    unit = np.vstack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((1, 4))])
    sim = np.round(unit @ unit.T, 6)
    for i in range(61):
        best = sorted((j for j in range(61) if j != i), key=lambda j: (-sim[i, j], j))[:3]
        assert [near[i, r] for r in (1, 2, 3)] == best
