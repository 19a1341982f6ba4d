"""Vector codes by product quantisation with equal-average search.

Components become integers (floor of ``scale`` times the component), vectors
are cut into equal consecutive parts, and each part position has a codebook
that a few k-means rounds fit to all vectors.  The nearest entry of a part is
found among the entries sorted by their component sum, outward from the
part's own sum: for d components, two vectors whose sums differ by g are at
least g * g / d apart (squared), so a search ends once that is strictly more
than the best distance found.  All arithmetic is on integers and exact.

A task adds up its parts by entry; a round sends at most parts * entries rows
from each task, and that many to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded, cut_lineage
from .batches import map_arrow

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Integer components reach this at most: sums of squares stay exact.
LARGEST = 1 << 26


def finite(vector: str):
    """Condition: the vector holds no null, NaN or infinite component."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(column, scale: int) -> np.ndarray:
    """Rows of a list column of equal lengths as an integer matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(len(column), -1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry, ties to the
    lower index: equal-average search for all rows of (n, d) at once."""
    n, d = parts.shape
    if not d:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    total = entries.sum(axis=1)
    order = np.argsort(total, kind="stable")
    ranked, sums = entries[order], total[order]
    own = parts.sum(axis=1)
    up = np.searchsorted(sums, own)
    down = up - 1
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    live = np.arange(n)
    far = np.iinfo(np.int64).max
    while len(live):
        u, w, s = up[live], down[live], own[live]
        gap_up = np.where(u < len(sums), np.abs(sums[np.minimum(u, len(sums) - 1)] - s), far)
        gap_down = np.where(w >= 0, np.abs(s - sums[np.maximum(w, 0)]), far)
        upward = gap_up < gap_down
        gap = np.where(upward, gap_up, gap_down)
        # strictly: an equal bound may still hide an equal distance of lower index
        go = (gap < far) & (np.where(gap < far, gap, 0) ** 2 <= np.minimum(best[live], far // d) * d)
        live, upward = live[go], upward[go]
        pick = np.where(upward, up[live], down[live])
        up[live[upward]] += 1
        down[live[~upward]] -= 1
        diff = parts[live] - ranked[pick]
        dist = (diff * diff).sum(axis=1)
        index = order[pick]
        better = (dist < best[live]) | ((dist == best[live]) & (index < at[live]))
        best[live[better]], at[live[better]] = dist[better], index[better]
    return at, best


def _assign(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) entry indexes and squared distances; books (parts, entries, d)."""
    d = books.shape[2]
    got = [nearest(rows[:, p * d : (p + 1) * d], books[p]) for p in range(len(books))]
    return np.stack([g[0] for g in got], axis=1), np.stack([g[1] for g in got], axis=1)


def refine(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: each entry becomes the floored mean of the parts nearest to
    it; unused entries stay."""
    parts, entries, d = books.shape

    def add_up(batches):
        total, count = np.zeros((parts * entries, d), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            rows = integers(batch.column("vector"), scale)
            at, _ = _assign(rows, books)
            for p in range(parts):
                place = p * entries + at[:, p]
                count += np.bincount(place, minlength=len(count))
                np.add.at(total, place, rows[:, p * d : (p + 1) * d])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"place": pa.array(used), "n": pa.array(count[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    got = map_arrow(vectors.select("vector"), add_up, "place long, n long, total array<long>")
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(d)]
    out = books.copy().reshape(parts * entries, d)
    for r in got.groupBy("place").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows at most
        out[r["place"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return out.reshape(books.shape)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks).

    Rows of ``embeddings`` (vec_id, embedding, label) whose vector is null or
    holds a null, NaN or infinite component are dropped.  The codebooks start
    as the parts of the ``entries`` rows of smallest vec_id (null ids last;
    rows of one id by their components).  code: entry indexes, two hex digits
    each (entries <= 256); error: squared distance to the coded vector, in
    integer components; label_error: errors summed over equal labels, nulls
    together.  codebooks: (parts, entries, components) integers.

    The table's vector length is that of its smallest id.  Rows of another
    length, of a length that ``parts`` doesn't divide, or with an integer
    component beyond 2**26 can't be coded: code and error null.  Repeated rows
    weigh as often as they occur and are coded alike; ties go to the lower
    entry.  Fewer rows than entries: so many entries.  An empty table gives no
    row and empty codebooks.  Further columns are ignored.
    """
    kind = T.ArrayType(T.DoubleType())
    kept = embeddings.where(finite("embedding")).select("vec_id", "label", F.col("embedding").cast(kind).alias("vector"))
    lead = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").first()
    width = len(lead["vector"]) if lead else 0
    small = F.forall("vector", lambda x: F.abs(x) < float(LARGEST // scale))
    fits = (F.size("vector") == width) & F.lit(width % parts == 0) & small
    coded = kept.where(fits)
    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = np.floor(scale * np.array([r["vector"] for r in first], dtype=np.float64).reshape(len(first), width)).astype(np.int64)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if first else np.zeros((parts, 0, 0), dtype=np.int64)
    for _ in range(rounds if first else 0):
        books = refine(coded, books, scale)

    def encode(batches):
        for batch in batches:
            at, far = _assign(integers(batch.column("vector"), scale), books)
            code = [bytes(r).hex() for r in at.astype(np.uint8)]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"),
                                              "code": pa.array(code, pa.string()), "error": pa.array(far.sum(axis=1))})

    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    done = map_arrow(coded, encode, schema)
    odd = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = cut_lineage(done.unionByName(odd))
    by_label = bounded(done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = done.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books
