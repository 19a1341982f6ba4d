"""Texts longer than the pieces that operators cut them into."""
import hashlib

import numpy as np

from lexigraph.llm import batches, substring_dedup, words


def long_text(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"w{i}é" if i % 7 else f"{i}" for i in rng.integers(0, 5000, n)]


def test_words_of_texts_beyond_a_piece():
    toks = [long_text(1, 500_000), ["one"], [], long_text(2, 10), ["x" * (3 << 20), "end"]]
    texts = [" \t".join(t).encode() for t in toks]
    assert len(texts[0]) > 2 * words.PIECE
    hashes, offsets = words.word_hashes(texts)
    assert list(np.diff(offsets)) == [len(t) for t in toks]
    distinct = sorted({w for t in toks for w in t})
    alone, _ = words.word_hashes([w.encode() for w in distinct])
    assert len(set(alone.tolist())) == len(distinct)
    of = dict(zip(distinct, alone.tolist()))
    assert [of[w] for t in toks for w in t] == hashes.tolist()


def test_slices_hold_every_text_once():
    texts = [b"a" * n for n in (10, batches.SLICE + 5, 0, 3 * batches.SLICE, 7, 7)]
    got = list(batches.slices(texts))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))


def test_repeats_across_a_cut(spark):
    """A passage that lies over the border of two pieces is found in both."""
    a, b = long_text(3, 260_000), [f"b{i}" for i in range(260_000)]
    assert len(" ".join(a[:200_000]).encode()) > words.PIECE
    at = 0
    size = 0
    while size < words.PIECE - 200:  # the passage starts 200 bytes before the border
        size += len(a[at].encode()) + 1
        at += 1
    passage = [f"p{i}" for i in range(80)]
    a[at:at + 80] = passage
    b[1000:1080] = passage
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 80 and got[3]["n_removed"] == 260_000
    left = b[:1000] + b[1080:]
    assert got[2]["kept_sha256"] == hashlib.sha256(" ".join(left).encode()).hexdigest()
