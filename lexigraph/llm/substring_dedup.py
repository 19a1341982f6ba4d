"""Removal of word windows that an earlier document holds, by super-k-mers.

The minimiser of a window is the smallest hash among its runs of
``m`` words.  Equal windows have equal minimisers, so a window need only be
held against those of its minimiser's bucket.  Consecutive windows with one
minimiser (a super-k-mer) travel to its bucket as one packed string; there
the windows are sorted and equal ones counted, and each learns whether a
smaller doc_id holds it.

Buckets that only one doc_id reaches can't hold a repeat: a first pass over
minimisers alone finds those that two or more reach, and only their
super-k-mers travel.  A bucket with more super-k-mers than ``hot`` is split:
its windows travel singly, by their own 128-bit hash, and are combined
before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .batches import map_arrow, slices, values
from .words import long_window_hashes, mix64, word_hashes

WINDOW = 50
MINIMISER = 8


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def super_kmers(texts: list[bytes], k: int, m: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimiser) of each super-k-mer, and the
    word hashes with their offsets."""
    h, at = word_hashes(texts)
    low = sliding_min(long_window_hashes(h, m), k - m + 1).view(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    inside = doc[: len(low)] == doc[k - 1 :] if len(low) else np.zeros(0, dtype=bool)
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~inside[:-1] | (doc[1 : len(low)] != doc[: len(low) - 1])
    cut = np.flatnonzero(new | ~inside)
    start = cut[inside[cut]]
    end = np.append(cut, len(low))[np.searchsorted(cut, start) + 1]
    d = doc[start]
    return d, start - at[d], end - start, low[start], h, at


def _minimisers(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, mh): each document's minimisers."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("mh", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = values(batch, "text", b"")
            for i, j in slices(texts):
                d, _, _, mh, _, _ = super_kmers(texts[i:j], k, m)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(d + i)), "mh": pa.array(mh)})

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _travellers(docs: DataFrame, k: int, m: int, single: bool) -> DataFrame:
    """What travels from documents with ``shared`` (array of mh): rows of
    doc_id, mark, at (first window) and (mh, packed), or with ``single``
    one row per window with its hash (w1, w2)."""
    own = [("w1", T.LongType()), ("w2", T.LongType())] if single else [("mh", T.LongType()), ("packed", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("at", T.LongType()), *[T.StructField(*c) for c in own]])

    def rows(texts, shared):
        d, start, n, mh, h, offset = super_kmers(texts, k, m)
        shared = [set(x) for x in shared]
        runs = [r for r in zip(d.tolist(), start.tolist(), n.tolist(), mh.tolist()) if r[3] in shared[r[0]]]
        if not runs:
            return [], {}
        if single:
            t, s, c, _ = (np.array(x, dtype=np.int64) for x in zip(*runs))
            row = np.repeat(t, c)
            pos = np.repeat(s, c) + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            w1, w2 = (long_window_hashes(x, k).view(np.int64)[offset[row] + pos] for x in (h, mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A))))
            return row, {"at": pos, "w1": w1, "w2": w2}
        packed, words, last = [], [], -1
        for t, s, c, _ in runs:
            if t != last:
                words, last = texts[t].split(), t
            packed.append(b" ".join(words[s : s + c + k - 1]))
        return [r[0] for r in runs], {"at": [r[1] for r in runs], "mh": [r[3] for r in runs], "packed": packed}

    def run(batches):
        for batch in batches:
            texts, shared = values(batch, "text", b""), batch.column("shared").to_pylist()
            for i, j in slices(texts):
                row, cols = rows(texts[i:j], shared[i:j])
                take = pa.array(np.asarray(row, dtype=np.int64) + i)
                cols = {"doc_id": batch.column("doc_id").take(take), "mark": batch.column("mark").take(take)} | {c: pa.array(v) for c, v in cols.items()}
                for a in range(0, len(take), 20_000):
                    yield pa.RecordBatch.from_pydict({c: v.slice(a, 20_000) for c, v in cols.items()})

    return map_arrow(docs.select("doc_id", "text", "mark", "shared"), run, schema)


def _bucket(rows: list[tuple], k: int) -> list[list[int]]:
    """For rows (doc_id, packed) of one bucket: the windows of each that a
    smaller doc_id holds.  Windows are sorted; a run of equal ones is one
    sequence, its first holder the smallest doc_id in the run."""
    windows, own, pos = [], [], []
    for r, (_, packed) in enumerate(rows):
        ends = [i for i, b in enumerate(packed) if b == 32] + [len(packed)]
        begin = 0
        for w in range(len(ends) - k + 1):
            windows.append(packed[begin : ends[w + k - 1]])
            own.append(r), pos.append(w)
            begin = ends[w] + 1
    out: list[list[int]] = [[] for _ in rows]
    run: list[int] = []

    def close() -> None:
        if len(run) > 1:
            first = min(rows[own[i]][0] for i in run)
            for i in run:
                if rows[own[i]][0] > first:
                    out[own[i]].append(pos[i])

    for i in sorted(range(len(windows)), key=windows.__getitem__):
        if run and windows[i] != windows[run[0]]:
            close()
            run = []
        run.append(i)
    close()
    return out


def _count_buckets(packed: DataFrame, k: int) -> DataFrame:
    """(doc_id, mark, a, b): runs of windows a..b that a smaller doc_id holds."""
    schema = T.StructType([packed.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("mark", "a", "b")]])

    def runs(pos: list[int], at: int):
        pos.sort()
        begin = 0
        for i in range(1, len(pos) + 1):
            if i == len(pos) or pos[i] != pos[i - 1] + 1:
                yield at + pos[begin], at + pos[i - 1]
                begin = i

    def judge(rows: list[tuple]):
        if rows[0][1] == rows[-1][1]:  # sorted by doc_id: one document
            return
        for (_, doc, mark, at, _), pos in zip(rows, _bucket([(r[1], r[4]) for r in rows], k)):
            for a, b in runs(pos, at):
                yield doc, mark, a, b

    def run(batches):
        bucket, found, kind = [], [], None

        def batch_of(found):
            cols = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind] + 3 * [pa.int64()])], names=["doc_id", "mark", "a", "b"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*[batch.column(c).to_pylist() for c in ("mh", "doc_id", "mark", "at", "packed")]):
                if bucket and row[0] != bucket[0][0]:
                    found += judge(bucket)
                    bucket = []
                bucket.append(row)
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        if bucket:
            found += judge(bucket)
        if found:
            yield batch_of(found)

    n = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return map_arrow(packed.repartition(n, "mh").sortWithinPartitions("mh", "doc_id", "mark", "at").select("mh", "doc_id", "mark", "at", "packed"), run, schema)


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot: int = 2_000, with_text: bool = True) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed,
    kept_sha256 and, with ``with_text``, kept_text (kept words joined by one
    space).

    Removed is every word covered by a k-word window whose sequence also
    starts in a document of smaller doc_id, judged on the input.  Null text:
    no words.  Null doc_id: neither removes nor is removed.  Rows of one
    doc_id don't remove from each other.  Texts under k words stay whole.
    An empty table gives no row.  Very long texts are read whole; of a long run
    of one word that several documents share, a task holds every window (about
    1.2 KB a word).  Further columns, whatever their names, aren't looked at.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    d = d.withColumn("mark", F.xxhash64("text")).where(F.col("doc_id").isNotNull())
    mins = _minimisers(d, k, m)
    shared = mins.groupBy("mh").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = shared.where(F.col("lo") < F.col("hi")).select("mh", (F.col("n") > hot).alias("hot"))
    # document by document, the minimisers to travel by bucket and those to travel singly
    own = cut_lineage(mins.join(shared, "mh").groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("mh"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("mh"))).alias("warm")))
    of = lambda c: d.join(own.where(F.size(c) > 0).select("doc_id", F.col(c).alias("shared")), "doc_id")
    cold = _count_buckets(_travellers(of("cold"), k, m, False), k)
    single = _travellers(of("warm"), k, m, True)
    first = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
    again = single.join(first, ["w1", "w2"]).where(F.col("first") < F.col("doc_id")).select("doc_id", "mark", F.col("at").alias("a"), F.col("at").alias("b"))
    gone = cold.unionByName(again).groupBy("doc_id").agg(F.collect_list(F.struct("mark", "a", "b")).alias("gone"))
    kept = _keep(d.join(gone, "doc_id", "left"), k, with_text)
    nulls = docs.where(F.col("doc_id").isNull()).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    nulls = _keep(nulls.select("*", F.lit(0).cast("long").alias("mark"), F.expr("cast(null as array<struct<mark:bigint,a:bigint,b:bigint>>)").alias("gone")), k, with_text)
    return kept.unionByName(nulls)


def _keep(d: DataFrame, k: int, with_text: bool) -> DataFrame:
    fields = [d.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] * with_text

    def run(batches):
        for batch in batches:
            texts = values(batch, "text", b"")
            for i, j in slices(texts):
                n, removed, sha, out = [], [], [], []
                for t, mark, gone in zip(texts[i:j], batch.column("mark").slice(i, j - i).to_pylist(), batch.column("gone").slice(i, j - i).to_pylist()):
                    words = t.split()
                    n.append(len(words))
                    gone = [g for g in gone or () if g["mark"] == mark]
                    if gone:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, [g["a"] for g in gone], 1)
                        np.add.at(edge, [g["b"] + k for g in gone], -1)
                        words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    removed.append(n[-1] - len(words))
                    kept = b" ".join(words)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        out.append(kept.decode("utf-8", "replace"))
                cols = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha)}
                yield pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(out)} if with_text else {}))

    return map_arrow(d.select("doc_id", "text", "mark", "gone"), run, T.StructType(fields))
