"""Language-model scores, vector codes and hard negatives against brute force,
and their defined results on awkward rows."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import hard_negatives, ppm, vector_codes
from lexigraph.llm.queries import ORACLE, QUERIES

from ..oracle_check import compare
from .data import awkward_documents, write_embeddings

# -- PPM --------------------------------------------------------------------


class BrutePpm:
    """PPM with explicit sets of refused symbols, from counts by context."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            sym = [257] * order + list(t) + [256]
            for i in range(order, len(sym)):
                for k in range(order + 1):
                    self.seen[tuple(sym[i - k : i])][sym[i]] += 1

    def log10(self, context, symbol):
        refused, total = set(), 0.0
        for k in range(self.order, -1, -1):
            here = {s: n for s, n in self.seen.get(context[len(context) - k :], {}).items() if s not in refused}
            if not here:
                continue
            escape = len(here) if len(here) + len(refused) < 257 else 0
            whole = sum(here.values()) + escape
            if symbol in here:
                return total + math.log10(here[symbol] / whole)
            total += math.log10(escape / whole)
            refused |= set(here)
        return total - math.log10(257 - len(refused))

    def score(self, text):
        sym = [257] * self.order + list(text) + [256]
        return sum(self.log10(tuple(sym[i - self.order : i]), sym[i]) for i in range(self.order, len(sym)))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def brute_base(docs, learned):
    counts = Counter()
    split = lambda t: [w for w in bytes(t).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w] + [None]
    for d, ok in zip(docs, learned):
        if ok:
            counts.update(split(d))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for d in docs:
        w = split(d)
        out.append((len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)))
    return total, out


@pytest.mark.parametrize("piece_bytes", [1, 32 << 20])
def test_ppm_query_equals_brute_force(spark, awkward, piece_bytes, monkeypatch):
    monkeypatch.setattr(ppm.score_documents, "__defaults__", (3, None, piece_bytes))
    rows = awkward_documents()
    texts = [lowered(r[1]) for r in rows]
    learned = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 != 0 for r in rows]
    model = BrutePpm([t for t, ok in zip(texts, learned) if ok], 3)
    total, base = brute_base(texts, learned)
    want = sorted((r[0] is None, r[0] or 0, not ok, *b[:2], total, round(b[2], 4), round(model.score(t), 4)) for r, ok, t, b in zip(rows, learned, texts, base))
    got = QUERIES["op11_lm_score"](spark, awkward).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((r[0] is None, r[0] or 0, *r[1:5], round(r[5], 4), round(r[6], 4)) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6] and abs(g[6] - w[6]) < 0.01 and abs(g[7] - w[7]) < 0.01, (g, w)


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [bytes(range(256))]
    order = 2
    counts = Counter()
    for _, key in ppm.gram_slices(texts, order):
        counts.update(key.tolist())
    contexts = [(257, 257), (97, 98), (0, 1), (5, 99), (257, 100)]
    asked = {s | (c[1] << 9) | (c[0] << 18): counts.get(s | (c[1] << 9) | (c[0] << 18), 0) for c in contexts for s in range(257)}
    df = spark.createDataFrame(list((counts | asked).items()), "key long, n long")
    got = {r["key"]: r["logp"] for r in ppm.log_probabilities(df, order).collect()}
    model = BrutePpm(texts, order)
    for c in contexts:
        p = [got[s | (c[1] << 9) | (c[0] << 18)] for s in range(257)]
        assert abs(sum(10.0**x for x in p) - 1) < 1e-9
        assert all(abs(x - model.log10(c, s)) < 1e-9 for s, x in enumerate(p))


def test_ppm_long_texts_and_nothing_learned(spark):
    long = "ab " * 1_200_000  # beyond the steps of symbols and the pieces of words
    docs = spark.createDataFrame([(1, long), (2, None), (3, "ab ab"), (3, "ab ab")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score_documents(docs, F.lit(True), order=2).collect()}
    assert got[1]["n_tokens"] == 1_200_001 and got[2]["n_tokens"] == 1 and got[1]["train_tokens"] == 1_200_001 + 1 + 6
    model = BrutePpm([b"ab ab", b"ab ab", b"", long.encode()], 2)
    assert abs(got[3]["score"] - model.score(b"ab ab")) < 1e-9 and abs(got[1]["score"] - model.score(long.encode())) < 1e-3
    none = {r["doc_id"]: r for r in ppm.score_documents(docs, F.lit(None).cast("boolean"), order=2).collect()}
    assert abs(none[3]["score"] + 6 * math.log10(257)) < 1e-9 and none[3]["n_known"] == 0 and none[3]["train_tokens"] == 0
    assert none[3]["base_score"] == 0.0


def test_ppm_prefers_what_it_learned(spark):
    got = QUERIES["op11_lm_score"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.held_out.any() and (got.score < 0).all()
    held = got[got.held_out]
    assert held.score.sum() > 1.1 * held.base_score.sum()  # both below 0


# -- vectors ----------------------------------------------------------------


def awkward_vectors():
    rng = np.random.RandomState(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.randn(32).astype(np.float32).tolist(), int(rng.randint(3))) for i in range(0, 420)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]                 # equal vectors
    rows += [(500, None, 1), (501, [nan] + [0.0] * 31, 1), (502, [inf] + [0.0] * 31, 2), (503, [-inf] + [0.0] * 31, 2), (504, [None] + [0.5] * 31, 0)]
    rows += [(600, [0.0] * 32, 1), (601, [0.0] * 32, None), (700, rng.randn(32).tolist(), None)]
    return rows


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    return write_embeddings(tmp_path_factory.mktemp("vectors"), awkward_vectors())


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_hard_negatives"])
def test_awkward_vectors_against_sql(spark, vectors, name):
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{vectors}/embeddings.parquet')")
    ok, n, m, _, _, detail = compare(spark, con, name, QUERIES[name], ORACLE[name], vectors)
    assert ok and n >= 350, f"{n} {m} {detail}"


@pytest.mark.parametrize("d", [1, 3, 4])
def test_nearest_equals_brute_force(d):
    rng = np.random.RandomState(d)
    entries = np.concatenate([rng.randint(-9, 9, (40, d)), rng.randint(-9, 9, (4, d)).repeat(3, axis=0)])
    parts = rng.randint(-12, 12, (500, d))
    dist = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    at, best = vector_codes.nearest(parts, entries)
    assert (at == dist.argmin(axis=1)).all() and (best == dist.min(axis=1)).all()


def test_vectors_that_cannot_be_coded_stay_without_a_code(spark):
    rows = [(i, [float(i)] * 16, 1) for i in range(5)] + [(9, [1.0] * 8, 1), (10, [], 2), (11, [1e30] * 16, None), (None, [2.0] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(df)
    got = {r["vec_id"]: r for r in coded.collect()}
    assert len(got) == 9 and all(got[i]["code"] is None and got[i]["error"] is None for i in (9, 10, 11)) and got[None]["code"] is not None
    assert books.shape == (16, 6, 1) and got[10]["label_error"] == got[None]["error"] and got[11]["label_error"] is None
    none, books = vector_codes.compress(df.where("vec_id > 100"))
    assert none.count() == 0 and books.size == 0


def brute_negatives(rows, n_positives=5, k=10):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows]
    out = []
    for i, v, lab in {(i, tuple(v), lab) for i, v, lab in rows if i % 100 == 0}:
        score = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in rows if len(w) == len(v)]
        same = sorted((s, j) for s, j, m in score if m == lab and j != i)[:n_positives]
        for s, j in same:
            found = sorted((t, x) for t, x, m in score if m != lab and 30 * s >= 100 * t >= 90 * s)[:k]
            out += [(i, j, r + 1, x, -s, -t) for r, (t, x) in enumerate(found)]
    return sorted(out)


def test_hard_negatives_in_many_blocks_with_copies(spark):
    rng = np.random.RandomState(4)
    rows = [(i, rng.randint(-2, 4, 6).astype(float).tolist(), int(rng.randint(3))) for i in range(600)]
    rows += [rows[100], rows[100]] + [rows[41]] * 30 + [rows[42]] * 3   # repeated rows, one of them an anchor
    rows += [(800, [1.0, 2.0], 1), (801, [1.0, 1.0], 1), (802, [1.0, 0.5], 0), (900, [], 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, anchor_block=2, row_block=50).collect()
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in got) == want and len(want) > 200
    assert any(r["anchor_id"] == 800 for r in got)


def test_no_vectors(spark, tmp_path):
    folder = write_embeddings(tmp_path, [])
    for name in ("op12_vector_codes", "op13_hard_negatives"):
        assert QUERIES[name](spark, folder).count() == 0
