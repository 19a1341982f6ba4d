"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, run through
up to ``max_repeats`` times.  A queued copy gets a virtual finish time:
the tokens of its source up to and with it, divided by the source's
target.  All copies are ordered by finish time over all sources and the
order is cut where the total budget is used up.

No group is held whole: running sums are taken inside (source, bucket)
groups of a bounded number of rows, plus the sums of the buckets before;
the cut is found from sums by finish-time bin, and only the bin that the
budget ends in is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import word_count

#: Source weights by code point order of the source name, repeating.
WEIGHTS = (5, 2, 1)
_SPAN = 1 << 60


def _key(source: Column) -> Column:
    """A join key that keeps null apart from every name."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = 2) -> DataFrame:
    """(skey, source_size, target) from rows (source, skey, source_size):
    150 % of all sizes shared by weight, filled up to ``max_repeats`` times
    a source's size, the excess shared again among the rest.

    Sources are ordered by the share at which they fill up; those before
    the first that stays open are full.  One row per source is all that
    this holds in a task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     (F.row_number().over(by_name) - 1) % len(weights) + 1)
    d = sizes.withColumn("w", w.cast("long"))
    cap = F.col("source_size") * max_repeats
    by_fill = Window.orderBy((cap / F.col("w")), F.col("source").isNull(), "source")
    d = (d.withColumn("cap", cap)
         .withColumn("full_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("open_w", F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy())))
    # twice the words left for the open sources: 2 * (1.5 * total - full_before)
    left = F.col("total") * 3 - F.col("full_before") * 2
    d = d.withColumn("left2", left).withColumn("is_open", F.col("left2") * F.col("w") <= F.col("cap") * F.col("open_w") * 2)
    first = Window.partitionBy()
    rank = F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"),
                    F.col("left2").alias("left2"), F.col("open_w").alias("open_w"))
    d = d.withColumn("at", F.min(F.when(F.col("is_open"), rank)).over(first))
    share = F.col("w") * F.col("at.left2") / (F.lit(2.0) * F.col("at.open_w"))
    return d.select("skey", "source_size", "w",
                    F.least(F.col("cap").cast("double"), F.coalesce(share, F.col("cap").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = 2, seed: str = "",
                rows_per_group: int = 2_000, rows_per_bin: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """The mix's verdict on every row of ``docs`` (doc_id, text, source).

    Returns doc_id, size (words), source_size, target (of the source),
    copies (times the mix takes the row, 0..max_repeats), taken (copies *
    size) and finish (virtual finish time of the first copy).  ``keep``
    names further columns of ``docs`` to carry.

    Null text: size 0, never taken.  Null source: a source of its own, last
    in order.  Null doc_id: an id like any other.  Repeated rows: each is
    queued.  An empty table, or one without words: nothing is taken.  Very
    long texts are counted whole.  Equal places in the queue: by doc_id, then
    size.  Further columns aren't looked at; those in ``keep`` must not have
    the name of a result (use :func:`apply_mix` for rows with any columns).
    Shuffle order depends on doc_id and ``seed`` only, so reruns agree.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    slim = cut_lineage(docs.select("doc_id", "source", _key(F.col("source")).alias("skey"),
                                   word_count(F.col("text")).alias("size"), h.alias("h"), *(keep or [])))
    stat = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    n, total = stat["n"], stat["s"] or 0
    groups = max(1, n // rows_per_group)
    slim = slim.withColumn("bucket", F.floor(F.col("h") / F.lit(_SPAN // groups)).cast("long"))

    sizes = slim.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats)
    before = slim.groupBy("skey", "bucket").agg(F.sum("size").alias("b")).select(
        "skey", "bucket", F.coalesce(F.sum("b").over(
            Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = (slim.withColumn("inside", F.sum("size").over(inside))
            .join(before, ["skey", "bucket"]).join(targets, "skey")
            .withColumn("cum", F.col("before") + F.col("inside")))
    times = [F.try_divide((F.col("cum") + F.col("source_size") * c).cast("double"), F.col("target")) for c in range(max_repeats)]
    place = [F.struct(t.alias("finish"), F.col("skey").alias("skey"), F.col("h").alias("h"), F.col("doc_id").alias("doc_id"),
                      F.lit(c).alias("copy")) for c, t in enumerate(times)]
    rows = rows.withColumn("places", F.array(*place))

    cut = _cut(rows, (3 * total) // 2, max(64, n // rows_per_bin)) if total else None
    taken = F.lit(0)
    for c in range(max_repeats):
        ok = F.lit(False) if cut is None else _before(F.col("places")[c], cut)
        taken = taken + F.coalesce(ok, F.lit(False)).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("copies"),
                       (F.col("size") * taken).alias("taken"), F.col("places")[0]["finish"].alias("finish"), "source", *(keep or []))


def _before(place: Column, cut) -> Column:
    """place <= cut in the order (finish, skey, h, doc_id, copy)."""
    out = F.lit(True)
    for name in ("copy", "doc_id", "h", "skey", "finish"):
        v = cut[name]
        if v is None:  # null sorts first
            out = place[name].isNull() & out
        else:
            out = (place[name] < F.lit(v)) | (place[name].eqNullSafe(F.lit(v)) & out)
            if name == "doc_id":
                out = place[name].isNull() | out
    return out & place["finish"].isNotNull()


def _cut(rows: DataFrame, budget: int, bins: int):
    """The last place that the budget covers, as one Row (None: none).

    Finish time runs evenly over the words taken, so bins of equal width
    hold equally many words; what finishes after time 2 shares one bin.
    """
    queued = rows.where(F.col("size") > 0).select("size", F.explode_outer("places").alias("p")).where(F.col("p.finish").isNotNull())
    queued = queued.withColumn("bin", F.floor(F.least(F.col("p.finish"), F.lit(2.0)) * bins).cast("long"))
    sums = queued.groupBy("bin").agg(F.sum("size").alias("s"))
    upto = sums.withColumn("upto", F.sum("s").over(Window.orderBy("bin")))
    last = upto.where(F.col("upto") > budget).orderBy("bin").select("bin", (F.col("upto") - F.col("s")).alias("off")).first()
    if last is None:
        return queued.agg(F.max("p").alias("p")).first()["p"]
    run = F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    inside = queued.where(F.col("bin") == last["bin"]).withColumn("run", run + last["off"]).where(F.col("run") <= budget)
    cut = inside.agg(F.max("p").alias("p")).first()["p"]
    return cut or queued.where(F.col("bin") < last["bin"]).agg(F.max("p").alias("p")).first()["p"]


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: a row of ``docs`` (doc_id, text, source and any other
    columns, whatever their names) per copy that the mix takes.

    Nulls, empty and very long texts, repeated rows and ties: as in
    :func:`mix_sources`; rows that share doc_id, source and size are told apart
    by text.  An empty table gives no row."""
    key = ["doc_id", "source", "size"]
    taken = cut_lineage(mix_sources(docs, **options).select(*key, "copies"))
    # the row is one column: no other column's name can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select("doc_id", "source", "text", whole).withColumn("size", word_count(F.col("text")))
    taken = taken.where(F.col("copies") > 0)
    twins = not taken.groupBy(*key).count().where("count > 1").isEmpty()
    if twins:  # rows that share a key are told apart by a number; else it is 1
        nth = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        rows, taken = rows.withColumn("_nth", nth("text")), taken.withColumn("_nth", nth(F.col("copies").desc()))
        key = [*key, "_nth"]
    right = taken.select(*[F.col(c).alias(f"_r_{c}") for c in key], "copies")
    both = rows.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in key])
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
