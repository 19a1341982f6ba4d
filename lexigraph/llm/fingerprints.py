"""Document fingerprints from improbable features.

A feature is a window of 64 bytes.  Its entropy is ranked by how rare that
entropy is among all windows of the corpus; in every run of 64 consecutive
windows the leftmost one of the lowest rank gains a point, and windows with
enough points are selected.  Their hashes are inserted into chained Bloom
filters of 2048 bits, 160 features each.  Two fingerprints are compared
filter by filter: overlap of set bits, between what chance gives (0) and
the most possible (1).

The fingerprint reads ``<features>:<filters in base64>``.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_arrow, slices, values
from .substring_dedup import sliding_min
from .words import byte_sums, span_hashes

FEATURE = 64
RUN = 64
POINTS = 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
LEVELS = 1001
#: Entropies below this level (of 1000) are padding-like and never preferred.
LOW = 100
_LAST = 1023
_SCALE = 1 << 16
#: Part of a text that is worked on at once.
_PART = 1 << 19


def _gain() -> np.ndarray:
    """c log2 c - (c-1) log2 (c-1), in fixed point, for counts c."""
    c = np.arange(FEATURE + 1, dtype=np.float64)
    f = np.rint(c * np.log2(np.maximum(c, 1)) * _SCALE).astype(np.int64)
    return np.concatenate([[0], np.diff(f)])


_GAIN = _gain()
_FULL = int(np.log2(FEATURE) * FEATURE * _SCALE)


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """Entropy of each 64-byte window, in 0..1000 of the most possible.

    The sum over byte values of c log c changes by what the byte that enters
    and the byte that leaves count for; both counts come from comparing the
    buffer with itself at 63 distances.
    """
    n = len(buf) - FEATURE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ahead, behind = np.ones(len(buf), dtype=np.uint8), np.ones(len(buf), dtype=np.uint8)
    for a in range(0, len(buf), 1 << 16):  # blocks that stay in cache
        b = buf[a : a + (1 << 16) + FEATURE - 1]
        for j in range(1, min(FEATURE, len(b))):
            k = min(1 << 16, len(b) - j)
            same = b[:k] == b[j : j + k]
            ahead[a : a + k] += same
            behind[a + j : a + j + k] += same
    enter, leave = np.zeros(len(buf) + 1, dtype=np.int64), np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(_GAIN[behind], out=enter[1:])
    np.cumsum(_GAIN[ahead], out=leave[1:])
    s = enter[FEATURE:] - leave[:n]
    return np.clip((_FULL - s) * 1000 // _FULL, 0, LEVELS - 1)


def _groups(texts: list[bytes]):
    """Lists of (text index, offset, part) of about _PART bytes; the parts of
    a long text overlap so that each run of windows lies in one of them."""
    group, total = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - FEATURE - RUN + 2), _PART):
            part = t[a : a + _PART + FEATURE + RUN - 2]
            if group and total + len(part) > _PART:
                yield group
                group, total = [], 0
            group.append((i, a, part))
            total += len(part)
    if group:
        yield group


def level_counts(docs: DataFrame) -> np.ndarray:
    """Windows of the whole corpus by entropy level."""
    def run(batches):
        total = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            texts = values(batch, "_text", b"")
            for i, j in slices(texts, _PART):
                for t in texts[i:j]:
                    if len(t) > _PART:
                        for a in range(0, len(t) - FEATURE + 1, _PART):
                            total += np.bincount(entropy_levels(np.frombuffer(t[a : a + _PART + FEATURE - 1], dtype=np.uint8)), minlength=LEVELS)
                small = [t for t in texts[i:j] if len(t) <= _PART]
                buf = np.frombuffer(b"".join(small), dtype=np.uint8)
                own = np.repeat(np.arange(len(small)), [len(t) for t in small])
                level = entropy_levels(buf)
                total += np.bincount(level[own[: len(level)] == own[FEATURE - 1 :]] if len(level) else level, minlength=LEVELS)
        yield pa.RecordBatch.from_pydict({"level": pa.array(np.arange(LEVELS)), "n": pa.array(total)})

    got = map_arrow(docs.select(F.col("text").cast("binary").alias("_text")), run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LEVELS, dtype=np.int64)
    out[got["level"].to_numpy()] = got["n"].to_numpy()
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy level, the rarest first (0)."""
    order = np.lexsort((np.arange(LEVELS), counts))
    rank = np.empty(LEVELS, dtype=np.int32)
    rank[order] = np.arange(LEVELS)
    rank[:LOW] = _LAST
    return rank


def _points(group, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, position, points, hash) of the windows of a group that gain."""
    buf = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(group)), sizes)
    score = rank[entropy_levels(buf)]
    key = (score.astype(np.int32) << 20) | np.arange(len(score), dtype=np.int32)
    low = sliding_min(key, RUN)
    reach = FEATURE + RUN - 2
    gained = (low[own[: len(low)] == own[reach:]] & 0xFFFFF) if len(low) else np.zeros(0, dtype=np.int64)
    short = [int(b + np.argmin(score[b : b + n - FEATURE + 1])) for b, n in zip(begin.tolist(), sizes.tolist()) if FEATURE <= n <= reach]
    points = np.bincount(np.concatenate([gained, np.repeat(np.array(short, dtype=np.int64), POINTS)]).astype(np.int64), minlength=len(buf) + 1)
    at = np.flatnonzero(points)
    sums = byte_sums(buf)
    text, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    h = span_hashes(sums, at, at + FEATURE)
    out = [text[own[at]], at - begin[own[at]] + offset[own[at]], points[at], h, score[at]]
    tiny = np.flatnonzero((sizes > 0) & (sizes < FEATURE) & (offset == 0))
    whole = span_hashes(sums, begin[tiny], begin[tiny] + sizes[tiny])
    return tuple(np.concatenate([a, b]) for a, b in zip(out, (text[tiny], np.zeros(len(tiny), dtype=np.int64), np.full(len(tiny), POINTS), whole, np.zeros(len(tiny), dtype=np.int32))))


def digests(texts: list[bytes], rank: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(features, filters as rows of 256 bytes) of each text."""
    found = [_points(g, rank) for g in _groups(texts)]
    text, pos, points, h, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 5
    order = np.lexsort((pos, text))
    text, pos, points, h, score = (x[order] for x in (text, pos, points, h, score))
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])
    start = np.flatnonzero(first)
    points = np.add.reduceat(points, start) if len(start) else points
    text, h, score = text[start], h[start], score[start]
    chosen = (points >= POINTS) & (score < _LAST)
    out = []
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        own = h[a:b][chosen[a:b]]
        if not len(own) and b > a:  # nothing popular, or low entropy throughout: the most popular
            own = h[a:b][[int(np.argmax(points[a:b]))]]
        _, seen = np.unique(own, return_index=True)
        own = own[np.sort(seen)]
        n = len(own)
        bits = np.zeros((-(-n // PER_FILTER), BITS), dtype=bool)
        for k in range(HASHES):
            bits[np.arange(n) // PER_FILTER, (own >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
        out.append((n, np.packbits(bits, axis=1)))
    return out


def to_string(digest: tuple[int, np.ndarray]) -> str:
    return f"{digest[0]}:" + base64.b64encode(digest[1].tobytes()).decode("ascii")


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1.  Each filter of the shorter chain against its best match in the
    other, weighted by features; two empty fingerprints are alike."""
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    if (len(a[1]), a[0]) > (len(b[1]), b[0]):
        a, b = b, a
    ones = [np.bitwise_count(x[1]).sum(axis=1).astype(np.float64) for x in (a, b)]
    features = np.minimum(a[0] - PER_FILTER * np.arange(len(a[1])), PER_FILTER)
    total = 0.0
    for bits, n, weight in zip(a[1], ones[0], features):
        both = np.bitwise_count(bits[None, :] & b[1]).sum(axis=1)
        most, chance = np.minimum(n, ones[1]), n * ones[1] / BITS
        total += weight * float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0).max())
    return min(1.0, total / float(features.sum()))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) in ``parts`` partitions by descending doc_id,
    sorted; each ends with copies (``copy`` 1) of the document that follows
    its last, the last partition's being the first document's.

    Borders are quantiles of the ids; heads are one id per partition.
    """
    lowest = -(1 << 63)
    d = docs.withColumn("_at", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    points = [i / parts for i in range(1, parts)]
    borders = sorted(set(d.agg(F.percentile_approx("_at", points, 100 * parts).alias("b")).first()["b"] or [])) if points else []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b >= F.col("_at"))) if borders else F.lit(0)
    d = d.withColumn("part", above.cast("int"))
    heads = {r["part"]: r["head"] for r in d.groupBy("part").agg(F.max("_at").alias("head")).collect()}
    used = sorted(heads)
    copies = F.create_map(*[F.lit(x) for i, p in enumerate(used) for x in (heads[p], used[i - 1])]) if used else F.create_map(F.lit(0).cast("long"), F.lit(0))
    to = F.element_at(copies, F.col("_at"))
    sent = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("copy")), F.when(to.isNotNull(), F.struct(to.alias("part"), F.lit(1).alias("copy")))))
    d = d.withColumn("_sent", F.explode(sent)).select(*docs.columns, "_at", "_sent.part", "_sent.copy")
    return d.repartitionById(max(1, len(borders) + 1), F.col("part")).sortWithinPartitions("copy", F.col("_at").desc(), "text").drop("_at", "part")


def fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs`` (doc_id, text).

    The edited text: the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by descending doc_id, after
    the last the first.  Null text: empty.  Null doc_id: last in order.
    Rows of one doc_id follow each other by text.  A single document is its
    own next.  An empty table gives no row.  Very long texts are digested
    whole.  Repeated rows are rows of their own, with equal fingerprints.
    Further columns, whatever their names, aren't looked at.
    """
    import hashlib

    rank = rarity(level_counts(docs))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = with_next(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), n)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                           *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])

    def judge(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """texts has one more than ids: the next of the last."""
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts, texts[1:])]
        raw = [t.encode("utf-8", "replace") for t in edited]
        own, new = digests([t.encode("utf-8", "replace") for t in texts], rank), digests(raw, rank)
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            pa.array([to_string(x) for x in own[:-1]], pa.string()), pa.array([to_string(x) for x in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())], names=[f.name for f in schema.fields])

    def run(batches):
        held_id, held, closed = None, None, False
        for batch in batches:
            copy = batch.column("copy").to_pylist()
            real = batch.num_rows - sum(copy)
            texts = values(batch, "text", "")
            ids = batch.column("doc_id").slice(0, real)
            if held is not None and batch.num_rows and not closed:
                ids = pa.concat_arrays([held_id, ids])
                texts, real = [held, *texts], real + 1
            if closed:
                continue
            last = len(texts) > real  # the first copy: what follows the last row
            upto = real if last else real - 1
            for i, j in slices(texts[:upto]):
                yield judge(ids.slice(i, j - i), texts[i : j + 1])
            closed = last
            held_id, held = ids.slice(upto, 1), None if last else texts[upto]

    return map_arrow(d.select("doc_id", "text", "copy"), run, schema)
