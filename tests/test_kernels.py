"""Block kernels with many blocks, empty blocks, empty results; graph steps;
archive files on disk."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import embed as EM
from lexigraph.operators import communities as CM
from lexigraph.operators import graph as G
from lexigraph.operators import quality as QL
from lexigraph.operators import similarity as SM
from lexigraph.operators import topics as TP
from lexigraph.sources import blocks as BL


def sparse(spark, X):
    rows = []
    for i, x in enumerate(X):
        nz = np.nonzero(x)[0]
        rows.append((i, [int(j) for j in nz], [float(v) for v in x[nz]], f"s{i % 3}"))
    return spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>, src string")


@pytest.fixture(scope="module")
def unit():
    rng = np.random.default_rng(3)
    X = rng.random((40, 9)) * (rng.random((40, 9)) < 0.4)
    X[7] = X[3]
    X[5] = 0.0
    return X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize("block", [40, 9, 1])
def test_histogram_counts_every_pair_once(spark, unit, block):
    vecs = sparse(spark, unit[:10])
    h = SM.block_products(vecs, 9, 10, "hist", block_docs=block).agg(F.sum("n")).first()[0]
    assert h == 45


@pytest.mark.parametrize("block", [40, 7, 2])
def test_percentile_pairs_and_neighbours_equal_numpy(spark, unit, block):
    n = len(unit)
    vecs, S = sparse(spark, unit), unit @ unit.T
    iu = np.triu_indices(n, 1)
    for q in (0.05, 0.5, 0.95):
        assert SM.exact_percentile(vecs, 9, n, q, block_docs=block) == pytest.approx(float(np.percentile(S[iu], 100 * q)), abs=1e-12)
    assert SM.threshold_pairs(vecs, 9, n, 0.9999999, block_docs=block).count() == int((np.round(S[iu], 6) >= 1).sum())
    assert SM.threshold_pairs(vecs, 9, n, 1.5, block_docs=block).count() == 0
    want = set()
    for i in range(n):
        order = sorted((j for j in range(n) if j != i and round(S[i, j], 6) >= 0.15), key=lambda j: (-round(S[i, j], 6), j))[:5]
        want |= {(min(i, j), max(i, j)) for j in order}
    edges = SM.knn_edges(vecs, 9, n, block_docs=block)
    assert {(r["doc_a"], r["doc_b"]) for r in edges.collect()} == want

    def top(i, j):
        p = np.round(unit[i] * unit[j], 12)
        return [int(t) for t in sorted(np.flatnonzero(p > 0), key=lambda t: (-p[t], t))[:4]]

    for r in edges.collect() + SM.shared_terms_join(edges, vecs).collect() + SM.threshold_pairs(vecs, 9, n, 0.5, block_docs=block).collect():
        assert r["terms"] == top(r["doc_a"], r["doc_b"])


@pytest.mark.parametrize("block", [30, 4, 1])
def test_silhouette_and_core_distances_equal_numpy(spark, block):
    rng = np.random.default_rng(4)
    X, label = rng.random((24, 3)), np.arange(24) % 4
    df = spark.createDataFrame([(i, int(c), [float(v) for v in x]) for i, (x, c) in enumerate(zip(X, label))], "vec_id long, label int, embedding array<double>")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    got = {r["vec_id"]: r["silhouette"] for r in QL.silhouette_points(df, block_points=block).collect()}
    for i in range(24):
        a = D[i][label == label[i]].sum() / 5
        b = min(D[i][label == c].mean() for c in range(4) if c != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)
    core = {r["id"]: r["core"] for r in QL.core_distances(df, 3, "vec_id", "embedding", block).collect()}
    assert all(core[i] == pytest.approx(np.sort(D[i])[3], abs=1e-6) for i in range(24))
    total = QL.overall_silhouette(QL.silhouette_points(df, block_points=block)).first()
    assert total["n_points"] == 24 and total["mean_silhouette"] == pytest.approx(np.mean(list(got.values())))


def test_zero_vector_has_similarity_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["neighbour"]): r["sim"] for r in EM.nearest(df, "vec_id", "embedding", 2, block_docs=1).collect()}
    assert got[1, 2] == 0.0 and got[2, 3] == 0.0 and got[1, 3] == pytest.approx(0.707107, abs=1e-6)


def test_long_path_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    got = {r["node"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n: n}


def test_louvain_finds_the_ring_of_cliques(spark):
    edges = [(5 * c + i, 5 * c + j, 1.0) for c in range(12) for i in range(5) for j in range(i)]
    edges += [(5 * c, (5 * c + 6) % 60, 1.0) for c in range(12)]
    e, nodes = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(61).select(F.col("id").alias("node"))
    part = CM.louvain(nodes, e)
    assert part.select("community").distinct().count() == 13 and part.count() == 61
    assert G.modularity(nodes, e, part).first()["q"] == pytest.approx(0.825758, abs=1e-6)


def test_topic_info_names_the_outliers(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, -1), (4, 1)], "id long, topic int")
    names = spark.createDataFrame([(0, "a / b"), (1, "c")], "topic int, name string")
    got = {r["topic"]: (r["doc_count"], r["pct"], r["name"], r["is_outlier"]) for r in TP.topic_info(a, names, outlier_name="rest").collect()}
    assert got == {0: (2, 50.0, "a / b", False), 1: (1, 25.0, "c", False), -1: (1, 25.0, "rest", True)}


def test_archive_files_names_and_blank_headers(spark, tmp_path):
    body = "\n".join(["body of some words"] * 3)
    one = f"ARCHIVE_FOLDER: A 1\nDOCUMENT_ID: D1\nDATE:  \nPLACE: Here\n{'-' * 20}\n{body}\n{'=' * 25}\nDOCUMENT_ID:  \nDATE: x\n{'=' * 20}\r\nDOCUMENT: D2\n{body}"
    (tmp_path / "VF NEW one_cleaned.txt").write_bytes(one.encode() + b"\xff")
    (tmp_path / "skip me.txt").write_text(one)
    files = BL.read_files(spark, str(tmp_path), skip=["skip me.txt"])
    whole = BL.split_blocks(files)
    for blocks in (whole, BL.read_records(spark, str(tmp_path), skip=["skip me.txt"])):
        docs, rejects = BL.parse_blocks(blocks)
        got = {r["doc_id"]: r for r in docs.collect()}
        assert set(got) == {"D1", "D2"} and rejects.count() == 1
        assert got["D1"]["date"] == "Unknown" and got["D1"]["place"] == "Here" and got["D1"]["text"] == body
        assert {r["source_file"] for r in got.values()} == {"VF NEW one_cleaned.txt"}
        assert got["D2"]["text"].endswith("�")


def test_stream_without_its_progress_is_refused(spark, tmp_path):
    from lexigraph.streaming.ingest import stream_documents
    (tmp_path / "in").mkdir()
    body = " ".join(f"word{i}" for i in range(25))
    (tmp_path / "in" / "a.txt").write_text(f"DOCUMENT_ID: A1\n{body}\n")
    out = str(tmp_path / "out")
    stream_documents(spark, str(tmp_path / "in"), out).awaitTermination(120)
    (tmp_path / "in" / "b.txt").write_text(f"DOCUMENT_ID: B1\n{body}\n")
    with pytest.raises(ValueError):
        stream_documents(spark, str(tmp_path / "in"), out, checkpoint=str(tmp_path / "elsewhere"))
    stream_documents(spark, str(tmp_path / "in"), out).awaitTermination(120)
    assert {r["doc_id"] for r in spark.read.parquet(out).collect()} == {"A1", "B1"}
