"""Language ID, fingerprints, importance weights: held-out accuracy, brute
force and defined results."""
import hashlib
import math
import random

import numpy as np

from lexigraph.llm import fingerprints as fp
from lexigraph.llm import importance, language_id
from lexigraph.llm.queries import QUERIES
from lexigraph.llm.words import word_hashes

from .data import awkward_documents


def test_language_of_awkward_rows(spark, awkward):
    got = {}
    rows = QUERIES["op2_language_id"](spark, awkward).collect()
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        assert 0.0 <= r["score"] <= 1.0
    assert len(rows) == len(awkward_documents())
    assert all(got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0 for i in (0, 1, 2, 4))
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "de", "fr"}
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items() if i is not None for r in x)


def test_held_out_accuracy_and_calibration(spark):
    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    m = got[got.held_out].merge(lang, on="doc_id")
    right = (m.lang_pred == m.lang).mean()
    assert right > 0.98
    assert abs(m.score.mean() - right) < 0.03


def test_ftrl_penalties_give_zeros_and_learn():
    rng = np.random.RandomState(0)
    state = language_id.Ftrl(np.zeros((40, 2)), np.zeros((40, 2)), l1=1.0)
    for _ in range(600):
        y = rng.randint(2)
        at = np.array([y, *rng.choice(np.arange(2, 40), 3, replace=False)])
        state.learn(at, np.ones(4), y)
    w = state.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[2:] == 0).mean() > 0.5


def test_no_language_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


# -- fingerprints -----------------------------------------------------------

def brute_entropy(window):
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in (window.count(b) for b in set(window)))


def test_entropy_levels():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdefgh \n\x00\xff") for _ in range(400)) + b"a" * 100
    got = fp.entropy_levels(np.frombuffer(data, dtype=np.uint8))
    for i in range(len(got)):
        assert abs(got[i] - 1000 * brute_entropy(data[i : i + 64]) / 6) <= 1


def test_digest_does_not_depend_on_parts(monkeypatch):
    rng = random.Random(2)
    rank = fp.rarity(np.array([rng.randint(0, 1000) for _ in range(fp.LEVELS)]))
    texts = [bytes(rng.choice(b"abcdefghijklmnop qrs") for _ in range(n)) for n in (0, 1, 63, 64, 100, 126, 127, 128, 5_000, 9_001)]
    whole = [fp.to_string(x) for x in fp.digests(texts, rank)]
    assert whole == [fp.to_string(fp.digests([t], rank)[0]) for t in texts]
    monkeypatch.setattr(fp, "_PART", 700)
    assert whole == [fp.to_string(x) for x in fp.digests(texts, rank)]


def test_fingerprints_of_awkward_rows(spark, awkward):
    rows = sorted(((r[0], r[1] or "") for r in awkward_documents()), key=lambda r: (0, -r[0], r[1]) if r[0] is not None else (1, 0, r[1]))
    want = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, t, nxt))
    for parts in (1, 4):
        got = fp.fingerprint(spark.read.parquet(awkward + "/documents.parquet"), parts=parts).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == sorted((w[0] is None, w[0] or 0, w[1], w[2]) for w in want)
        own = {}
        texts = {(w[0], w[1], w[2]): w for w in want}
        for r in got:
            w = texts[r["doc_id"], r["n_chars"], r["edited_sha256"]]
            assert own.setdefault(w[4], r["fingerprint"]) == r["fingerprint"]
            assert own.setdefault(w[3], r["edited_fingerprint"]) == r["edited_fingerprint"]
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if w[3] == w[4]:
                assert r["near_edited"] == 1.0
            if w[4] == w[5]:
                assert r["near_next"] == 1.0


def test_likeness_falls_with_edits():
    rng = random.Random(4)
    rank = fp.rarity(np.array([rng.randint(0, 1000) for _ in range(fp.LEVELS)]))
    t = bytes(rng.choice(b"abcdefghijklmnop qrstuvw") for _ in range(8_000))
    other = bytes(rng.choice(b"abcdefghijklmnop qrstuvw") for _ in range(8_000))
    d = [fp.digests([x], rank)[0] for x in (t, t[:7_000] + other[7_000:], t[:4_000] + other[4_000:], other)]
    near = [fp.likeness(d[0], x) for x in d]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.1


# -- importance resampling --------------------------------------------------

def test_importance_weights_by_brute_force(spark, awkward):
    docs, labels = (spark.read.parquet(f"{awkward}/{t}.parquet") for t in ("documents", "labels"))
    got = importance.resample(docs, labels, bits=10, share=0.5).collect()
    rows = [(r[0], r[1] or "") for r in awkward_documents()]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]} - {None}

    def grams(text):
        h, _ = word_hashes([text.encode()])
        pairs = [(int(a), int(b)) for a, b in zip(h, h[1:])]
        out = [int(x) >> 54 for x in h]
        for a, b in pairs:
            mixed = (a * 0x9E3779B97F4A7C15 + b) % 2**64
            for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ mixed >> shift) * mult % 2**64
            out.append((mixed ^ mixed >> 31) >> 54)
        return out

    raw, target = np.zeros(1024), np.zeros(1024)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    ratio = importance.log_ratio(target, raw)
    want = sorted(round(float(sum(ratio[g] for g in grams(t))), 6) for _, t in rows)
    assert np.allclose(sorted(r["log_weight"] for r in got), want, atol=1e-5)
    worded = [r for r in got if r["n_words"]]
    assert sum(r["kept"] for r in worded) in (round(len(worded) * 0.5), round(len(worded) * 0.5) + 1)
    assert not any(r["kept"] for r in got if not r["n_words"])


def test_largest_by_sorting(spark):
    rng = random.Random(6)
    rows = [(rng.choice([rng.random(), 0.5, 1e-300, -3.0]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key double, tie long")
    order = sorted(rows, reverse=True)
    for k in (1, 7, 250, 499, 500, 900):
        assert importance.largest(df, k, bins=4) == order[min(k, 500) - 1]


def test_quality_is_told_apart(spark):
    got = QUERIES["op8_importance_resampling"](spark, "/root/testdata/sf0.01").toPandas()
    m = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    clean = m[(m.quality == 1) & (m.toxic == 0)]
    assert clean.kept.mean() > 0.9 and m[m.quality == 0].kept.mean() < 0.3
