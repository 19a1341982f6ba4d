"""Hard negatives by slot-decomposed selection.

An anchor has several positives, and each asks for the best negatives in a
window of scores below its own.  The windows overlap; their upper limits cut
the scores into disjoint slots.  For each slot the best k negatives are kept
(partial lists can be merged, so each block of rows gives its own first).
The best k below a positive's limit are then the best k of its slot and the
lower ones: merging the slots from the lowest up answers every
window at once, and the lower limit only cuts the end of a list.

Anchors meet all rows in blocks: ``anchor_block`` anchors times
``row_block`` rows are scored in one group, whatever the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import as_table, cut_lineage
from .vector_codes import finite, integers

SCALE = 256
ANCHOR_BLOCK, ROW_BLOCK = 4096, 8192
#: Anchors scored at once in a group.
TILE = 256

def _matrix(t: pa.Table, scale: int) -> np.ndarray:
    return integers(t.column("vector"), scale).astype(np.float64)


def _grid(anchors: DataFrame, rows: DataFrame, anchor_block: int, row_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers (dim, ab, rb) of their pairs of blocks.
    Blocks are dealt by hash, so labels or repeated rows make none larger."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("nr")).join(anchors.groupBy("dim").agg(F.count(F.lit(1)).alias("na")), "dim")
    # one row for each vector length
    blocks = {r["dim"]: (-(-r["na"] // anchor_block), -(-r["nr"] // row_block)) for r in sizes.collect()}
    if not blocks:
        blocks = {0: (1, 1)}

    def number(which: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for d, b in blocks.items() for x in (d, b[which])]), F.col("dim"))

    deal = lambda n: F.pmod(F.xxhash64("vec_id", "mark"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here = F.col("dim").isin(list(blocks))
    left = anchors.where(here).withColumn("ab", deal(number(0))).withColumn("rb", every(number(1)))
    right = rows.where(here).withColumn("rb", deal(number(1))).withColumn("ab", every(number(0)))
    return left, right


def _best(score: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by smaller id, in order; a row's
    place as often as it has copies."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
    else:
        some = np.arange(len(score))
    some = some[np.lexsort((ids[some], -score[some]))][:k]
    return np.repeat(some, np.minimum(copies[some], k))[:k]


def positives(anchors: DataFrame, rows: DataFrame, k: int, scale: int, anchor_block: int, row_block: int) -> DataFrame:
    """(anchor_id, mark, positive_id, positive_score, place): each anchor's k
    best rows of its label, other than rows of its own id."""
    left, right = _grid(anchors, rows, anchor_block, row_block)

    def search(a: pa.Table, r: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "mark": [], "positive_id": [], "positive_score": []}
        if a.num_rows and r.num_rows:
            x, y = _matrix(a, scale), _matrix(r, scale).T
            ids, labels, copies = (r.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
            own, own_label, mark = (a.column(c).to_numpy() for c in ("vec_id", "label", "mark"))
            for i in range(0, len(x), TILE):
                for j, score in enumerate(x[i : i + TILE] @ y, i):
                    at = np.flatnonzero((labels == own_label[j]) & (ids != own[j]))
                    at = at[_best(score[at], ids[at], copies[at], k)]
                    for c, v in zip(out, (np.full(len(at), own[j]), np.full(len(at), mark[j]), ids[at], score[at].astype(np.int64))):
                        out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64), pa.int64()) for c, v in out.items()})

    found = left.groupBy("dim", "ab", "rb").cogroup(right.groupBy("dim", "ab", "rb")).applyInArrow(search, "anchor_id long, mark long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "mark").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def slot_lists(anchors: DataFrame, rows: DataFrame, k: int, scale: int, anchor_block: int, row_block: int) -> DataFrame:
    """(anchor_id, mark, slot, negative_id, negative_score): the k best
    negatives of each slot of each anchor; ``limits`` (descending, distinct)
    cut the slots, slot i holding the scores of limits[i] down to, but not
    including, limits[i + 1]; none below ``floor``."""
    left, right = _grid(anchors, rows, anchor_block, row_block)

    def search(a: pa.Table, r: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "mark": [], "slot": [], "negative_id": [], "negative_score": []}
        if a.num_rows and r.num_rows:
            x, y = _matrix(a, scale), _matrix(r, scale).T
            ids, labels, copies = (r.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
            own, own_label, mark, floor = (a.column(c).to_numpy() for c in ("vec_id", "label", "mark", "floor"))
            limits = [np.array(v, dtype=np.float64) for v in a.column("limits").to_pylist()]
            for i in range(0, len(x), TILE):
                for j, score in enumerate(x[i : i + TILE] @ y, i):
                    inside = np.flatnonzero((score <= limits[j][0]) & (score >= floor[j]) & (labels != own_label[j]))
                    slot = len(limits[j]) - 1 - np.searchsorted(limits[j][::-1], score[inside])
                    for s in np.unique(slot):
                        at = inside[slot == s]
                        at = at[_best(score[at], ids[at], copies[at], k)]
                        n = len(at)
                        for c, v in zip(out, (np.full(n, own[j]), np.full(n, mark[j]), np.full(n, s), ids[at], score[at].astype(np.int64))):
                            out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64), pa.int64()) for c, v in out.items()})

    found = left.groupBy("dim", "ab", "rb").cogroup(right.groupBy("dim", "ab", "rb")).applyInArrow(
        search, "anchor_id long, mark long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "mark", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def mine(embeddings: DataFrame, anchor: Column, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = SCALE,
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) of ``embeddings`` (vec_id, embedding, label).

    Components become floor(scale * x); a score is the inner product of these
    integers.  Anchors: the rows that meet ``anchor``, a condition on vec_id.
    Positives: an anchor's ``n_positives`` best rows of its label with another
    vec_id.  For each, the ``k`` best rows of another label whose score is
    ``low`` to ``high`` percent of the positive's.  Equal scores: smaller
    vec_id first; a window without a negative gives no row (a positive of
    negative score has an empty window).

    Rows with a null vec_id, label or vector, or with a null, NaN or infinite
    component take no part.  Vectors meet only vectors of their length.
    Repeated rows count each; anchors that are equal rows are one anchor.
    Scores are exact below 2**53.  An empty table gives no row.  Further
    columns are ignored.
    """
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    rows = rows.select(F.size("embedding").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("vector"))
    # equal rows travel as one, however many they are
    rows = rows.where("dim > 0").withColumn("mark", F.xxhash64("label", "vector")).groupBy("vec_id", "mark").agg(
        F.first("dim").alias("dim"), F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    rows = as_table(rows, "negatives-rows")
    anchors = cut_lineage(rows.where(anchor))
    good = cut_lineage(positives(anchors, rows, n_positives, scale, anchor_block, row_block))
    # whole scores s with low * p <= 100 * s <= high * p
    top = F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100")
    least = F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100")
    wanted = good.withColumn("top", top).withColumn("least", least).where("least <= top")
    asks = wanted.groupBy(F.col("anchor_id").alias("vec_id"), "mark").agg(
        F.sort_array(F.collect_set("top"), asc=False).alias("limits"), F.min("least").alias("floor"))  # n_positives limits at most
    asking = cut_lineage(anchors.join(asks, ["vec_id", "mark"]))
    slots = slot_lists(asking, rows, k, scale, anchor_block, row_block)
    lists = slots.groupBy("anchor_id", "mark", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("s"), F.col("negative_id").alias("id")))).alias("best"))
    # from the lowest slot up: a slot's own list, then what lies below it
    below = Window.partitionBy("anchor_id", "mark").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = lists.withColumn("best", F.slice(F.flatten(F.reverse(F.collect_list("best").over(below))), 1, k))
    own = asking.select(F.col("vec_id").alias("anchor_id"), "mark", "limits")
    # a positive's list: that of the first slot, from its limit down, that has any
    asked = wanted.join(own, ["anchor_id", "mark"]).select("anchor_id", "mark", "positive_id", "positive_score", "least", "place", (F.array_position("limits", F.col("top")) - 1).alias("from_slot"))
    hit = asked.join(merged, ["anchor_id", "mark"]).where(F.col("slot") >= F.col("from_slot"))
    hit = hit.groupBy("anchor_id", "mark", "positive_id", "positive_score", "least", "place").agg(F.min_by("best", "slot").alias("best"))
    inside = hit.select("anchor_id", "positive_id", "positive_score", F.filter("best", lambda b: -b["s"] >= F.col("least")).alias("best"))
    out = inside.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("pos", "b"))
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", (-F.col("b.s")).alias("negative_score"))
