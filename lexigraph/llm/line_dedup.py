"""Removal of repeated and nearly repeated lines over the whole corpus.

Equal lines: the earliest stays.  Lines within ``edits`` edits (code points; 1
or 2): each line gives its deletion neighbourhood as hashed keys, variants with
code points left out or, for a substitution, with the place of the gap kept.
Two lines are within the bound just if they share a key of one kind: a gap in
both at the same place for each substitution, one left out of the longer for
each insertion.  So the earliest partner of a line is the minimum over its
keys, without any pair of lines being formed.  The partner found is verified
by edit distance.

Edits leave one of ``edits + 1`` parts of the shorter line as it is.  Only
lines that share a part (and its length) with another line emit their variants,
and only those with the gaps in the other parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import as_table, cut_lineage
from .batches import map_arrow, slices, values
from .words import mix64, powers, prefix_sums, span_hashes

_SPACE_POINTS = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_POINT = mix64(np.arange(1, 65537, dtype=np.uint64) * _OTHER)
#: Stands for a code point at a place that is left open.
_OPEN = np.uint64(0xD6E8FEB86659FD93)
#: Keys made at once for a line.
_AT_ONCE = 1 << 18


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _marks(points: np.ndarray) -> np.ndarray:
    """A 64-bit value per code point."""
    out = _POINT[points & np.uint32(0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    out[high] = mix64(points[high].astype(np.uint64) * _OTHER)
    return out


def _pieces(texts: list[str], limit: int = 1 << 18):
    """Lists of (text index, first line, part), parts cut between lines, of
    about ``limit`` code points together."""
    group, total = [], 0
    for i, t in enumerate(texts):
        line, at = 0, 0
        while True:
            end = t.find("\n", at + limit) if len(t) - at > limit else -1
            part = t[at:] if end < 0 else t[at:end]
            group.append((i, line, part))
            total += len(part) + 1
            if total > limit:
                yield group
                group, total = [], 0
            if end < 0:
                break
            line += part.count("\n") + 1
            at = end + 1
    if group:
        yield group


def _lines_of(group) -> tuple[np.ndarray, ...]:
    """(text, line number, start, end, with a word) of the lines of a group,
    and the code points that the offsets refer to."""
    points = _points("\n".join(p for _, _, p in group))
    cut = np.flatnonzero(points == 10)
    start, end = np.concatenate([[0], cut + 1]), np.append(cut, len(points))
    n = [p.count("\n") + 1 for _, _, p in group]
    text = np.repeat([i for i, _, _ in group], n)
    number = np.concatenate([np.arange(first, first + k) for (_, first, _), k in zip(group, n)])
    solid = np.concatenate([[0], np.cumsum(~np.isin(points, _SPACE_POINTS))])
    return text, number, start, end, solid[end] > solid[start], points


def line_table(docs: DataFrame, least: int = 0, edits: int = 1) -> DataFrame:
    """(doc_id, mark, line, h1, h2, n, parts): the lines that have a word,
    their hashes and length, and keys of their parts, for the line as the
    shorter of two and as longer by 1 to ``edits`` (none for lines under
    ``least`` code points)."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("mark", "line", "h1", "h2", "n")], T.StructField("parts", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            texts = values(batch, "text", "")
            for group in _pieces(texts):
                text, number, s, e, ok, points = _lines_of(group)
                text, number, s, e = text[ok], number[ok], s[ok], e[ok]
                m, n, take = _marks(points), e - s, pa.array(text)
                sums, other = prefix_sums(m), prefix_sums(m * _OTHER ^ m >> np.uint64(29))
                long_ = n >= least
                keys = np.stack([key for more in range(edits + 1) for key in _part_keys(sums, s[long_], e[long_], n[long_] - more, edits)], axis=1).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(long_, keys.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(take), "mark": batch.column("mark").take(take), "line": pa.array(number.astype(np.int64)),
                    "h1": pa.array(span_hashes(sums, s, e).view(np.int64)), "h2": pa.array(span_hashes(other, s, e).view(np.int64)),
                    "n": pa.array(n.astype(np.int64)), "parts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))})

    return map_arrow(docs.select("doc_id", "text", "mark"), run, schema)


def _part_keys(sums, s, e, length, edits):
    """Keys of the parts of lines held against a shorter line's ``length``: the
    first, the last and, for two edits, the middle, which one edit before it
    moves by a place at most."""
    length = np.maximum(length, 0)
    own = length // (edits + 1)
    spans = [(s, s + own), (e - own, e)]
    if edits == 2:
        spans += [(np.clip(s + own + move, s, e), np.clip(s + length - own + move, s, e)) for move in (-1, 0, 1)]
    for slot, (a, b) in enumerate(spans):
        yield mix64(span_hashes(sums, a, np.maximum(a, b)) ^ ((3 * length + min(slot, 2)).astype(np.uint64) * _GOLD))


def _slots(edits: int) -> int:
    """Part keys of a line for one length: :func:`_part_keys`."""
    return 2 if edits == 1 else 5


def _zones(n: int, length: int, side: int, edits: int):
    """Places where a line may have gaps: (first gap from, to, second gap from,
    to); the second follows the first."""
    own = length // (edits + 1)
    if side == 0:
        return own, n, own, n
    if side == 1:
        return 0, n - own, 0, n - own
    return 0, min(own + 1, n), max(length - own - 1, 0), n


def _pairs(zones):
    """(i, j) with i < j, i and j in their zones, some at a time."""
    a, b, c, d = zones
    step = max(_AT_ONCE // max(d - c, 1), 1)
    for lo in range(a, b, step):
        i, j = np.meshgrid(np.arange(lo, min(lo + step, b)), np.arange(c, d), indexing="ij")
        ok = i < j
        yield i[ok], j[ok]


def _gaps(sums, zones, cut: int, opened: int):
    """Unmixed hashes of a line with ``cut`` code points left out and ``opened``
    places kept open, in all ways that the zones allow, some at a time."""
    pw, inv = powers(len(sums) + 2)
    n = len(sums) - 1
    fill = _OPEN * pw[:n] - (sums[1:] - sums[:-1])   # what opening a place adds
    if cut + opened == 0:
        yield sums[n:]
    elif cut + opened == 1:
        i = np.unique(np.concatenate([np.arange(zones[0], zones[1]), np.arange(zones[2], zones[3])]))
        yield sums[i] + (sums[n] - sums[i + 1]) * inv[1] if cut else sums[n] + fill[i]
    elif cut == 1:
        for i, j in _pairs(zones):
            yield sums[i] + (sums[n] - sums[i + 1] + fill[j]) * inv[1]
            yield sums[j] + fill[i] + (sums[n] - sums[j + 1]) * inv[1]
    else:
        for i, j in _pairs(zones):
            yield sums[i] + (sums[j] - sums[i + 1]) * inv[1] + (sums[n] - sums[j + 1]) * inv[2] if cut else sums[n] + fill[i] + fill[j]


def _kinds(more: int, n: int, edits: int):
    """(kind, role, cut, opened) of the variants of a line longer by ``more``.
    Lines meet in one kind; role 0 is the shorter, 1 the longer, 2 an equal."""
    if more:
        return [(more, 1, more, edits - more)]
    found = [(edits, 0, 0, 0), (0, 2, 0, min(edits, n))]
    if edits == 2:
        found += [(1, 0, 0, 1), (3, 2, 1, 0)]
    return found


def _line_keys(points, length: int, side: int, edits: int):
    """(v1, v2, role) of a line's variants, some at a time."""
    n, m = len(points), _marks(points)
    sums = [prefix_sums(x) for x in (m, m * _OTHER ^ m >> np.uint64(29))]
    zones = _zones(n, length, side, edits)
    for kind, role, cut, opened in _kinds(n - length, n, edits):
        tag = np.uint64((4 * (n - cut) + kind) * int(_GOLD) % (1 << 64))
        for both in zip(*(_gaps(x, zones, cut, opened) for x in sums)):
            v1, v2 = (mix64(v + tag).view(np.int64) for v in both)
            yield v1, v2, role


def _variants(docs: DataFrame, edits: int) -> DataFrame:
    """Variants of the lines named in ``near`` (array of mark, line, length,
    side): (v1, v2, role, doc_id, mark, line)."""
    fields = [T.StructField("v1", T.LongType()), T.StructField("v2", T.LongType()), T.StructField("role", T.IntegerType()),
              docs.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("line", T.LongType())]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = values(batch, "text", "")
            for i, (t, near) in enumerate(zip(texts, batch.column("near").to_pylist())):
                own = [x for x in near if x["mark"] == batch.column("mark")[i].as_py()]
                lines = t.split("\n") if own else []
                for x in own:
                    for v1, v2, role in _line_keys(_points(lines[x["line"]]), x["length"], x["side"], edits):
                        k = len(v1)
                        same = pa.array(np.full(k, i))
                        yield pa.RecordBatch.from_arrays([pa.array(v1), pa.array(v2), pa.array(np.full(k, role, dtype=np.int32)), batch.column("doc_id").take(same),
                                                          batch.column("mark").take(same), pa.array(np.full(k, x["line"], dtype=np.int64))], names=names)

    return map_arrow(docs.select("doc_id", "text", "mark", "near"), _merged(run), T.StructType(fields))


def _merged(run, rows: int = 50_000):
    """Gathers small batches that a mapInArrow function yields."""
    def gather(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gather


def _sized(small: DataFrame, bound: int) -> DataFrame:
    """A checkpointed table, marked for broadcast if it has ``bound`` rows at
    most (rows of a few numbers); joined as Spark sees fit beyond."""
    small = cut_lineage(small)
    return F.broadcast(small) if small.count() <= bound else small


def _texts_of(docs: DataFrame, lists: DataFrame, bound: int) -> DataFrame:
    """``docs`` joined to ``lists`` (one row per doc_id); if these are few,
    the others are dropped before the shuffle."""
    ids = _sized(lists.select("doc_id"), bound)
    return docs.join(ids, "doc_id", "left_semi").join(lists, "doc_id")


def near_lines(docs: DataFrame, lines: DataFrame, edits: int = 1, bound: int = 500_000) -> DataFrame:
    """(doc_id, mark, line): first occurrences of lines that an earlier line
    of the corpus resembles by ``edits`` edits or fewer.  ``lines`` is the line
    table of ``docs``, with parts for this bound."""
    place, slots = F.struct("doc_id", "line", "mark"), _slots(edits)
    keyed = lines.where(F.size("parts") > 0).select("doc_id", "mark", "line", "h1", "h2", "n", F.posexplode("parts").alias("i", "part"))
    keyed = keyed.withColumn("length", F.col("n") - F.floor(F.col("i") / slots)).withColumn("side", F.least(F.col("i") % slots, F.lit(2)))
    shared = keyed.groupBy("part").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("n").alias("n0"), F.min("length").alias("length"))
    shared = _sized(shared.where((F.col("lo") != F.col("hi")) & (F.col("n0") == F.col("length"))).select("part"), bound)
    first = keyed.join(shared, "part").groupBy("h1", "h2", "side", "length").agg(F.min(place).alias("p"))
    near = first.select("p.doc_id", F.struct("p.mark", "p.line", "length", "side").alias("x"))
    near = cut_lineage(near.groupBy("doc_id").agg(F.collect_list("x").alias("near")))
    if near.isEmpty():
        return docs.where(F.lit(False)).select("doc_id", "mark", F.lit(0).cast("long").alias("line"))
    keys = _variants(_texts_of(docs, near, bound), edits).withColumn("p", place)
    best = keys.groupBy("v1", "v2").agg(*[F.min(F.when(F.col("role") == r, F.col("p"))).alias(f"p{r}") for r in range(3)], F.count(F.lit(1)).alias("k")).where("k > 1")
    partner = F.when(F.col("role") == 0, F.col("p1")).when(F.col("role") == 1, F.col("p0")).otherwise(F.col("p2"))
    pairs = keys.join(best, ["v1", "v2"]).withColumn("q", partner).where(F.col("q") < F.col("p"))
    pairs = cut_lineage(pairs.groupBy("p").agg(F.min("q").alias("q")))
    ends = pairs.select(F.explode(F.array("p", "q")).alias("p")).distinct()
    lists = cut_lineage(ends.groupBy("p.doc_id").agg(F.collect_list("p").alias("at")))
    split = _texts_of(docs, lists, bound).withColumn("lines", F.split("text", "\n"))
    said = split.select("lines", "mark", F.explode("at").alias("p")).where(F.col("p.mark") == F.col("mark")).select("p", F.get("lines", F.col("p.line").cast("int")).alias("said"))
    both = pairs.join(said, "p").join(said.select(F.col("p").alias("q"), F.col("said").alias("before")), "q")
    return both.where(F.levenshtein("said", "before", edits).between(1, edits)).select("p.doc_id", "p.mark", "p.line").distinct()


def remove_lines(docs: DataFrame, edits: int = 1, least: int = 0, bound: int = 500_000, keep: list[str] | None = None) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed,
    kept_sha256, kept_text and the columns ``keep``.

    A line (split at \\n) goes if an equal line stands earlier in the corpus,
    by doc_id, then line number; or if such a line within ``edits`` edits (1 or
    2) does, both of ``least`` code points or more (0: lines of any length).
    Judged on the input.  Lines without a word stay.  Two edits cost keys as
    the square of a near line's length, one edit as its length.  Null text: no lines, kept_text null.  Null doc_id: stays
    whole and removes nothing.  Repeated rows (equal doc_id and text) are
    one document; rows of one doc_id with different texts follow each other
    by line number, then hash.  An empty table gives no row.  Very long texts
    and lines are read whole.  Further columns aren't looked at; those named in
    ``keep`` are carried and must not have the name of a result.
    """
    if edits not in (1, 2):
        raise ValueError("edits is 1 or 2")
    d = docs.select("doc_id", "text", *(keep or [])).withColumn("mark", F.xxhash64("text"))
    own = d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "mark")
    # read four times: as a table, texts are split and hashed once
    lines = as_table(line_table(own, least, edits), "lines")
    place = F.struct("doc_id", "line", "mark")
    first = lines.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2", "p")
    equal = lines.join(_sized(first, bound), ["h1", "h2"]).where(place != F.col("p")).select("doc_id", "mark", "line")
    gone = equal.unionByName(near_lines(own, lines, edits, bound))
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("mark", "line")).alias("gone"))
    return _kept(d.join(gone, "doc_id", "left"), keep or [])


def _kept(d: DataFrame, keep: list[str]) -> DataFrame:
    fields = [d.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()), *[d.schema[c] for c in keep]]

    def run(batches):
        for batch in batches:
            texts = values(batch, "text", "")
            for i, j in slices(texts):
                own = batch.slice(i, j - i)
                n, removed, out = [], [], []
                for t, mark, gone in zip(own.column("text").to_pylist(), own.column("mark").to_pylist(), own.column("gone").to_pylist()):
                    lines = [] if t is None else t.split("\n")
                    drop = {g["line"] for g in gone or () if g["mark"] == mark}
                    n.append(len(lines)), removed.append(len(drop))
                    out.append(t if t is None or not drop else "\n".join(x for k, x in enumerate(lines) if k not in drop))
                sha = [hashlib.sha256((t or "").encode("utf-8", "replace")).hexdigest() for t in out]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(out, pa.string()),
                                                  *[own.column(c) for c in keep]], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text", *keep])

    return map_arrow(d.select("doc_id", "text", "mark", "gone", *keep), run, T.StructType(fields))
