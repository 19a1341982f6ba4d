"""Quality selection by importance resampling.

Two generative models of hashed word 1- and 2-grams, of target text and of
all raw text; a document's log weight is the log ratio of its likelihoods.
Resampling without replacement with these weights is a top-k of log weight
plus Gumbel noise, drawn from the document's id.

The raw model counts every document.  The target model is fitted on a
sample of labelled rows of about ``target_docs`` documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .batches import map_arrow, row_function, slices, values
from .words import window_hashes, word_hashes


def _buckets(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of all 1- and 2-grams, and words per text."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    two = window_hashes(h, 2)
    inside = doc[: len(two)] == doc[1:] if len(two) else np.zeros(0, dtype=bool)
    shift = np.uint64(64 - bits)
    return np.concatenate([doc, doc[: len(two)][inside]]), np.concatenate([h >> shift, two[inside] >> shift]).astype(np.int64), n


def gram_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """Corpus counts by bucket: a sum per task, then over tasks."""
    def run(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            texts = values(batch, "_text", b"")
            for i, j in slices(texts):
                total += np.bincount(_buckets(texts[i:j], bits)[1], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    got = map_arrow(docs.select(F.col("text").cast("binary").alias("_text")), run, "bucket long, n long")
    got = got.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def largest(scored: DataFrame, k: int, bins: int = 4096) -> tuple | None:
    """The k-th largest (key, tie) of rows (key double, tie long): counts by
    bin, then by finer bins inside the one that holds it, until one key is
    left there; then the same over ties."""
    found = []
    rest = scored
    for column in ("key", "tie"):
        while True:
            ends = rest.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(F.lit(1)).alias("n")).first()
            a, b, n = ends["a"], ends["b"], ends["n"]
            if not n or k < 1:
                return None
            k = min(k, n)
            if a == b:
                break
            width = (b - a) / bins if column == "key" else -(-(b - a + 1) // bins)
            at = F.least(F.floor((F.col(column) - F.lit(a)) / F.lit(width)).cast("long"), F.lit(bins - 1)) if width > 0 else F.lit(0)
            rest = rest.withColumn("_bin", at)
            upto, hit = 0, None
            for r in rest.groupBy("_bin").count().orderBy(F.col("_bin").desc()).collect():
                if upto + r["count"] >= k:
                    hit = r["_bin"]
                    break
                upto += r["count"]
            k -= upto
            narrowed = rest.where(F.col("_bin") == hit).drop("_bin")
            inner = narrowed.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
            if (inner["a"], inner["b"]) == (a, b):  # the floats can't be told apart any finer
                keys = sorted((r for r in narrowed.groupBy(column).count().collect()), key=lambda r: -r[column])
                for r in keys:
                    if r["count"] >= k:
                        narrowed = narrowed.where(F.col(column) == r[column])
                        break
                    k -= r["count"]
            rest = narrowed
        found.append(a)
        rest = rest.where(F.col(column) == F.lit(a))
    return tuple(found)


def resample(docs: DataFrame, labels: DataFrame, bits: int = 14, target_docs: int = 10_000, share: float | None = None, seed: int = 11,
             keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, log_weight, kept): importance resampling of ``docs``
    (doc_id, text), target: the rows that ``labels`` (doc_id, quality,
    toxic) call good (quality 1, not toxic).

    kept: the document is among the k drawn, k being ``share`` of all
    documents with a word (default: the share of quality 1 among the
    labelled).  Null, empty or blank text: weight 0, never kept.  Null
    doc_id: one draw for all of them.  Null labels count as not good.
    Equal draws are told apart by the id's hash, repeated rows are kept or
    not together, so that kept may exceed k by rows equal to the last one.
    No good label: every document with a word is kept.  An empty table
    gives no row.  Very long texts are weighed whole, in slices cut between
    words.  Further columns aren't looked at; those named in ``keep`` are
    carried and must not have the name of a result.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.agg(F.count("quality").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("fine"), F.count(F.when(good, 1)).alias("good")).first()
    share = share if share is not None else known["fine"] / max(1, known["n"])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, target_docs / max(1, known["good"])))
    ids = labels.where(good & draw).select("doc_id").distinct()
    # about target_docs ids by construction, whatever the size of the tables
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    ratio = log_ratio(gram_counts(sample, bits), gram_counts(docs, bits)) if known["good"] else np.zeros(1 << bits)
    cols = ["doc_id", *(keep or [])]
    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField("n_words", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def weigh(texts):
        doc, bucket, n = _buckets(texts, bits)
        return {"n_words": n, "log_weight": np.bincount(doc, weights=ratio[bucket], minlength=len(texts))}

    scored = map_arrow(docs.select(*cols, F.col("text").cast("binary").alias("_text")), row_function(weigh, "_text", cols), schema)
    scored = cut_lineage(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)).withColumn("tie", F.xxhash64("doc_id")))
    worded = scored.where(F.col("n_words") > 0)
    cut = largest(worded.select("key", F.col("tie")), round(worded.count() * share)) if known["good"] else None
    if cut is None:
        kept = F.lit(not known["good"])
    else:
        kept = (F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & (F.col("tie") >= cut[1]))
    return scored.select(*cols, "n_words", "log_weight", (kept & (F.col("n_words") > 0)).alias("kept"))
