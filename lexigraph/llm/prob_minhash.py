"""Near-duplicate classes by ProbMinHash.

A document is a weighted set of five-word shingles (weight 1 + ln count).
Each shingle is a Poisson process with a rate of its weight, seeded by the
shingle alone; its arrivals fall into random registers, a register keeps
the shingle that arrives first, and a document's processes end as soon as
the next arrival comes after the latest register's time.  Two documents
agree in a register with the probability Jaccard similarity of their sets.
A second set of registers, all weights 1, does so with the plain Jaccard.

Texts of equal words are one item from the start.  Items whose registers of
either set agree in a whole band share a bucket.  In each bucket all items are held
against its first one; the verified links make components.  Buckets that
still hold several components are searched in blocks: a first pass over
registers finds the items that have a partner in another component, a second
one, to which only the texts of these travel, verifies such pairs on the full
shingle sets, most alike first, until each hangs together or has been
verified.  Pairs never leave a block, only links do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..session import cut_lineage
from .batches import map_arrow, slices, values
from .words import mix64, prefix_sums, span_hashes, window_hashes, word_hashes

K = 5
REGISTERS = 128
BAND = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count) sorted by text, and a 2 x 64-bit mark of
    each text's words.  A text of fewer than k words is one shingle; a text
    without words has none."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    marks = [span_hashes(prefix_sums(x), at[:-1], at[1:]) for x in (h, mix64(h ^ np.uint64(0x5851F42D4C957F2D)))]
    doc = np.repeat(np.arange(len(texts)), n)
    win = window_hashes(h, k)
    inside = doc[: len(win)] == doc[k - 1 :] if len(win) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((n > 0) & (n < k))
    d = np.concatenate([doc[: len(win)][inside], short])
    s = np.concatenate([win[inside], marks[0][short]])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(d)))
    return d[start], s[start], count, marks[0], marks[1]


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n_docs x m uint16) of weighted sets given as sorted rows."""
    time = np.full((n_docs, m), np.inf)
    held = np.zeros((n_docs, m), dtype=np.uint16)
    ft, fh = time.reshape(-1), held.reshape(-1)
    last = np.full(n_docs, np.inf)  # the latest register's time
    at, step, done = np.zeros(len(item)), 1, 0
    live = np.arange(len(item))
    while len(live):
        for a in range(0, len(live), max(1, (1 << 18) // step)):
            own = live[a : a + max(1, (1 << 18) // step)]
            draw = mix64(item[own][:, None] + (np.arange(done + 1, done + step + 1, dtype=np.uint64) * _GOLD)[None, :])
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[own][:, None]
            when = at[own][:, None] + np.cumsum(gap, axis=1)
            at[own] = when[:, -1]
            ok = when < last[doc[own]][:, None]
            r, c = np.nonzero(ok)
            place = doc[own][r] * m + (mix64(draw[r, c] ^ _GOLD) % np.uint64(m)).astype(np.int64)
            t = when[r, c]
            np.minimum.at(ft, place, t)
            won = ft[place] == t
            fh[place[won]] = (item[own][r[won]] >> np.uint64(48)).astype(np.uint16)
        seen = np.unique(doc[live])
        last[seen] = time[seen].max(axis=1)
        live = live[at[live] < last[doc[live]]]
        done += step
        step = min(2 * step, 64)
    return held


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard (over weights) and plain Jaccard of two sets given
    as (sorted items, counts)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(ia)
    if not len(ia):
        return 0.0, 0.0
    wa, wb = weights(a[1]), weights(b[1])
    x, y = wa[ia], wb[ib]
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # for each common item: sum over all items of max(wa / x, wb / y)
    over = np.searchsorted(-ratio, -ratio, side="right")  # items of at least this ratio
    sx, sy = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    total = (only_a + sx[over]) / x + (only_b + sy[-1] - sy[over]) / y
    return float((1.0 / total).sum()), len(ia) / union


def signatures(docs: DataFrame, m: int = REGISTERS) -> DataFrame:
    """(doc_id, k1, k2, sig): mark of the words, and the weighted and the plain
    registers, once where no shingle is repeated (they are the same); sig is
    null where the text has no word."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts = values(batch, "_text", b"")
            for i, j in slices(texts):
                d, s, c, k1, k2 = shingles(texts[i:j])
                reg = prob_minhash(d, s, weights(c), j - i, m)
                full = np.bincount(d, minlength=j - i) > 0
                twice = np.bincount(d[c > 1], minlength=j - i) > 0
                part, place = twice[d], np.cumsum(twice) - 1
                plain = prob_minhash(place[d[part]], s[part], np.ones(part.sum()), int(twice.sum()), m)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)),
                    "sig": pa.array([reg[x].tobytes() + (plain[place[x]].tobytes() if twice[x] else b"") if full[x] else None for x in range(j - i)], pa.binary())})

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("_text")), run, schema)


def _registers(sigs: list[bytes], m: int) -> np.ndarray:
    """(texts x 2 x m): weighted and plain registers of each signature."""
    return np.frombuffer(b"".join(x if len(x) == 4 * m else x + x for x in sigs), dtype=np.uint16).reshape(-1, 2, m)


def _estimates(pairs: DataFrame, m: int, least: float) -> DataFrame:
    """(a, b) of rows (a, b, sa, sb) whose registers of either set agree
    in ``least`` or more."""
    def run(batches):
        for t in batches:
            x, y = (_registers(t.column(c).to_pylist(), m) for c in ("sa", "sb"))
            yield t.select(["a", "b"]).filter(pa.array((x == y).mean(axis=2).max(axis=1) >= least))

    return map_arrow(pairs, run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, docs: DataFrame, least: float, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full shingle sets."""
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    # ids alone, and only up to broadcast_rows of them; Spark's own choice beyond
    small = ids.count() <= broadcast_rows
    texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("id"), "left_semi")
    texts = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for t in batches:
            ta, tb = values(t, "ta", b""), values(t, "tb", b"")
            for i, j in slices(ta):
                d, s, c, _, _ = shingles(ta[i:j] + tb[i:j])
                at = np.searchsorted(d, np.arange(2 * (j - i) + 1))
                own = lambda k: (s[at[k] : at[k + 1]], c[at[k] : at[k + 1]])  # noqa: E731, B023
                ok = [max(probability_jaccard(own(k), own(j - i + k))) >= least for k in range(j - i)]
                yield t.slice(i, j - i).select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, pairs.select("a", "b").schema)


def _estimated(t: pa.Table, m: int, band: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, agreement) of a block's pairs between different
    components (``now``), registers of either set agreeing in ``least`` or
    more.  A pair is found in the first band that it agrees in, not in others."""
    side = t.column("l").to_numpy(zero_copy_only=False)
    sig = _registers(t.column("sig").to_pylist(), m)
    now, ids = t.column("now").to_numpy(), t.column("id").to_numpy()
    lo, hi = np.flatnonzero(side), np.flatnonzero(~side)
    out = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
    for x in lo:
        share = (sig[hi] == sig[x]).mean(axis=2).max(axis=1)
        ok = np.flatnonzero((share >= least) & (now[hi] != now[x]) & (ids[hi] != ids[x]))
        both = sig[hi[ok]][:, :, None] == sig[x][None, None]  # a bucket holds bands of both sets
        ok = ok[both.reshape(len(ok), 4, m // band, band).all(axis=3).any(axis=1).argmax(axis=1) == t.column("band")[0].as_py()]
        out.append((np.full(len(ok), x), hi[ok], share[ok]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _blocks(unsettled: DataFrame, block: int) -> DataFrame:
    """Rows (h, band, id, now, sig, n, n_left, is_left) dealt to the pairs of
    blocks (bl, bb) of their bucket: items outside the head's component (l)
    meet all items."""
    nb = F.ceil(F.col("n") / block).cast("int")
    nl = F.ceil(F.col("n_left") / block).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    seq = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["h", "band", "id", "now", "sig"]
    left = unsettled.where("is_left").select(*cols, F.lit(True).alias("l"), deal(nl).alias("bl"), seq(nb).alias("bb"))
    right = unsettled.select(*cols, F.lit(False).alias("l"), seq(nl).alias("bl"), deal(nb).alias("bb"))
    return left.unionByName(right)


def _cross_links(unsettled: DataFrame, docs: DataFrame, m: int, band: int, similarity: float, slack: float, block: int, broadcast_rows: int) -> DataFrame:
    """(a, b): verified links between components of the same bucket, enough of
    them to connect whatever a link connects."""
    key, least = ["h", "bl", "bb"], similarity - slack
    dealt = _blocks(unsettled, block)

    def partnered(t: pa.Table) -> pa.Table:
        x, y, _ = _estimated(t, m, band, least)
        return t.take(pa.array(np.union1d(x, y).astype(np.int64)))

    open_ = cut_lineage(dealt.groupBy(*key).applyInArrow(partnered, dealt.schema))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    ids = cut_lineage(open_.select("id").distinct())
    # ids alone, and only up to broadcast_rows of them; Spark's own choice beyond
    texts = texts.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, F.col("doc_id") == F.col("id"), "left_semi")
    texts = open_.join(texts, F.col("doc_id") == F.col("id")).drop("doc_id")

    def verify(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, y, share = _estimated(t, m, band, least)
        now, low, sets = t.column("now").to_pylist(), values(t, "text", b""), []
        for i, j in slices(low):
            d, s, c, _, _ = shingles(low[i:j])
            at = np.searchsorted(d, np.arange(j - i + 1))
            sets += [(s[at[k] : at[k + 1]], c[at[k] : at[k + 1]]) for k in range(j - i)]
        root = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c] = root.get(root[c], root[c])
            return c

        links = []
        for n in np.argsort(-share, kind="stable"):
            a, b = find(now[x[n]]), find(now[y[n]])
            if a != b and max(probability_jaccard(sets[x[n]], sets[y[n]])) >= similarity:
                root[a] = b
                links.append(n)
        ids = t.column("id")
        return pa.table({"a": ids.take(pa.array(x[links])), "b": ids.take(pa.array(y[links]))})

    kind = unsettled.schema["id"].dataType
    return texts.groupBy(*key).applyInArrow(verify, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, m: int = REGISTERS, band: int = BAND, slack: float = 0.2,
                    block: int = 512, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, class_id): a row per row of ``docs``; class_id is the smallest
    doc_id of its near-duplicate class (chains of links).

    A link: probability Jaccard over weights, or plain Jaccard, of the
    shingle sets is ``similarity`` or more.  Each has its own registers: with
    32 bands of 4 a pair at 0.8 shares no band once in 2 * 10^7; pairs whose
    registers of both sets agree in less than similarity - ``slack`` (5 standard
    deviations) aren't verified.

    Texts without a word (null, empty, blank): each row is its own class.
    Fewer than five words: equal words only.  Null doc_id: class of its
    equal texts, else null.  Repeated rows, and rows of one doc_id: one class.  An empty table gives
    no row.  Very long texts count whole.  Equal members of a class: the
    smallest doc_id leads, so row order has no part.  Further columns, whatever
    their names, aren't looked at.
    """
    sig = cut_lineage(signatures(docs, m))
    worded = sig.where(F.col("sig").isNotNull())
    items = cut_lineage(worded.where(F.col("doc_id").isNotNull()).groupBy("k1", "k2", "sig").agg(F.min("doc_id").alias("id")))
    width = 2 * band
    bands = m // band
    own_band = lambda i: F.col("sig").substr(i * width + 1, F.lit(width))
    # plain bands follow the weighted ones; the same band of both is one bucket
    every = F.sequence(F.lit(0), F.when(F.length("sig") > 2 * m, 2 * bands - 1).otherwise(bands - 1))
    places = F.filter(every, lambda i: (i < bands) | (own_band(i) != own_band(i - bands)))
    keys = F.transform(places, lambda i: F.struct((i % bands).alias("band"), F.xxhash64(i % bands, own_band(i)).alias("h")))
    buckets = items.select("id", F.inline(keys))
    heads = buckets.groupBy("h").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(buckets.join(heads, "h"))  # buckets of several items only
    pairs = shared.where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    own = items.select("id", "sig")

    def with_registers(p: DataFrame) -> DataFrame:
        return p.join(own.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    near = cut_lineage(_estimates(with_registers(pairs), m, similarity - slack))
    links = cut_lineage(_verified(near, docs, similarity, broadcast_rows))
    nodes = items.select(F.col("id").alias("node"))
    comp = cut_lineage(connected_components(nodes, links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))

    # buckets of three and more that hold several components; items outside
    # the largest one look for links
    member = shared.where("n > 2").select("h", "band", "id").join(comp.select(F.col("node").alias("id"), F.col("component").alias("now")), "id")
    parts = member.groupBy("h", "now").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "now")).alias("f"))
    open_ = open_.where("parts > 1").select("h", "n", (F.col("n") - F.col("f.n")).alias("n_left"), F.col("f.now").alias("head"))
    rows = member.join(open_, "h").withColumn("is_left", F.col("now") != F.col("head")).join(own, "id")
    new = cut_lineage(_cross_links(rows, docs, m, band, similarity, slack, block, broadcast_rows))
    if not new.isEmpty():
        between = new.join(comp.select(F.col("node").alias("a"), F.col("component").alias("src")), "a").join(comp.select(F.col("node").alias("b"), F.col("component").alias("dst")), "b")
        merged = connected_components(between.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), between.select("src", "dst"))
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        comp = cut_lineage(comp.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    classes = items.select("k1", "k2", "id").join(comp, F.col("id") == F.col("node")).select("k1", "k2", "component")
    plain = sig.where(F.col("sig").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return worded.join(classes, ["k1", "k2"], "left").select("doc_id", F.col("component").alias("class_id")).unionByName(plain)



def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: the rows whose doc_id leads its
    class, repeated rows once.  Null doc_ids and texts without a word stay.
    Rows of a leading doc_id with other texts stay, each text once.  Very long
    texts count whole; an empty table gives no row.  Further columns are
    carried; none may be called ``_id``."""
    led = near_duplicates(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), **options)
    led = led.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_id")).distinct()
    out = docs.join(led, F.col("doc_id") == F.col("_id"), "left_anti")
    repeated = cut_lineage(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    if repeated.isEmpty():
        return out
    same = F.col("doc_id") == F.col("_id")
    return out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
