"""Document similarity: all-pairs cosine over TF-IDF, kNN graph, exact
percentile, thresholded edge list, cross-archive bridges, shared terms.

Documents are hashed into B blocks of bounded size, each stored once as one
row of a table; every pair of blocks (i <= j) is one row of this table's
product with itself, whose tasks read both sides from the table: a vector is
shuffled once, not once for each block that it meets.  The kernel multiplies
the two blocks (numpy: frequent terms as matrices, the others entry by entry)
and emits only what is asked for: counts of the pair similarities by bin, each
document's top-k of a task, or the pairs above a threshold with their top
shared terms.  Memory per task is
bounded by the block size, not by the corpus; no n x n matrix and no
all-pairs row set ever exists.

Ties everywhere use a total order: similarity rounded to 6 places
descending, then the neighbour's id ascending; shared terms: product
rounded to 12 places descending, then term ascending.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..session import as_table, bounded, cut_lineage, ship_package

SIM_FLOOR = 0.15
K_NEIGHBOURS = 5
N_SHARED = 4
HIST_BINS = 1 << 16
BLOCK_DOCS = 1500
#: Blocks in a row of the stored table at most.
TILES = 4
#: Terms that a larger share of two blocks' pairs have in common are multiplied as matrices.
DENSE_SHARE = 0.004
#: Products of single entries taken at a time.
LIGHT_PRODUCTS = 200_000
#: Rows of a frame of pairs, and distinct values that a task holds.
PAIR_ROWS, VALUE_ROWS = 200_000, 2_000_000
#: Pairs whose similarities are stored in the search for a percentile.
STORED_PAIRS = 20_000_000


# ---------------------------------------------------------------------------
# vectors
# ---------------------------------------------------------------------------

def doc_vectors(rows: DataFrame, vocabulary: DataFrame, doc: str = "doc_id",
                attrs: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx array<int>, val array<double>[, src]) unit TF-IDF rows.

    One ``groupBy(doc_id)``: each document contributes at most
    ``len(vocabulary)`` entries (bounded by max_features), normalised in the
    row.  ``attrs`` (doc_id, src) is attached for cross-archive flags.
    """
    v = bounded(vocabulary.select("term", "term_idx", "idf"))
    w = rows.join(v, "term").select(doc, "term_idx", (F.col("tf") * F.col("idf")).alias("w"))
    g = w.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("term_idx", "w"))).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    out = g.select(doc, F.col("e.term_idx").alias("idx"),
                   once(norm, lambda length: F.transform("e.w", lambda x: x / length)).alias("val"))
    if attrs is not None:
        out = out.join(attrs, doc, "left")
    return out


def n_blocks(n_docs: int, block_docs: int = BLOCK_DOCS, parallelism: int = 1) -> int:
    """Blocks of at most ``block_docs`` documents; more of them, down to 64
    documents, while the block pairs would not fill ``parallelism`` tasks."""
    fill = min(math.ceil(n_docs / 64), math.ceil(math.sqrt(2 * parallelism)))
    return max(1, math.ceil(n_docs / block_docs), fill)


def packed_blocks(vecs: DataFrame, n_docs: int, doc: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(blk, held): the vectors as a table in the shared folder, one row for
    each block, its documents in the order of their ids.  Where blocks of
    ``block_docs`` are many, a row holds up to ``TILES`` of them, so that they
    reach a Python worker once for as many partners."""
    ship_package(vecs.sparkSession)
    cores = vecs.sparkSession.sparkContext.defaultParallelism
    B = n_blocks(n_docs, block_docs, cores)
    B = math.ceil(B / max(1, min(TILES, B // math.ceil(math.sqrt(8 * cores)))))
    v = vecs.select(
        F.pmod(F.xxhash64(F.col(doc)), F.lit(B)).cast("int").alias("blk"), F.col(doc).cast("long").alias("doc"), "idx", "val",
        (F.col("src") if "src" in vecs.columns else F.lit(None).cast("string")).alias("src"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc").reset_index(drop=True)
        tiles = max(1, round(len(pdf) / block_docs))
        ends = [len(pdf) * i // tiles for i in range(tiles + 1)]
        held = [_held(pdf.iloc[s:e]) for s, e in zip(ends, ends[1:])]
        return pd.DataFrame({"blk": pdf["blk"].iloc[:1], "held": [pickle.dumps(held, protocol=5)]})

    # a file for each core, so that the product has as many tasks at least
    return as_table(v.repartition(min(B, cores), "blk").groupBy("blk").applyInPandas(pack, "blk int, held binary"), "blocks")


def _held(pdf: pd.DataFrame) -> tuple:
    """(ids, ends of the rows, terms, values, sources, order): what is stored of
    a block.  ``order`` has the entries by term and row; of a term that a row
    holds twice, the last."""
    rows = _rows(pdf)
    lengths = [len(i) for i, _ in rows]
    idx = np.concatenate([i for i, _ in rows]).astype(np.int32)
    row = np.repeat(np.arange(len(rows)), lengths)
    order = np.lexsort((row, idx))
    last = np.append((np.diff(idx[order]) != 0) | (np.diff(row[order]) != 0), True)[:len(order)]
    return pdf["doc"].to_numpy(), np.cumsum(lengths), idx, np.concatenate([x for _, x in rows]), pdf["src"].to_numpy(dtype=object), order[last].astype(np.int32)


class _Block:
    """A stored block, its entries by row and by term (``at``: where each of the
    V terms starts)."""

    def __init__(self, held: tuple, V: int):
        self.ids, self.ends, self.terms, self.values, self.src, order = held
        self.n, self.V = len(self.ids), V
        row = np.repeat(np.arange(self.n), np.diff(self.ends, prepend=0))
        kept = slice(None) if len(order) == len(row) else np.sort(order)
        self.row, self.idx, self.val = row[kept], self.terms[kept], self.values[kept]
        self.term_row, self.term_val = row[order], self.values[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.terms[order], minlength=V))])

    def dense(self, column: np.ndarray, columns: int) -> np.ndarray:
        """Rows of the terms that have a column (>= 0)."""
        X = np.zeros((self.n, columns))
        c = column[self.idx]
        has = c >= 0
        X[self.row[has], c[has]] = self.val[has]
        return X

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, values) of each row."""
        return list(zip(np.split(self.terms, self.ends[:-1]), np.split(self.values, self.ends[:-1])))


# ---------------------------------------------------------------------------
# the block kernel (runs inside Python workers on one block pair)
# ---------------------------------------------------------------------------

def _rows(part: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each row; a null or empty row has none."""
    none = (np.zeros(0, dtype=np.int64), np.zeros(0))
    return [none if idx is None or not len(idx) else (np.asarray(idx, dtype=np.int64), np.asarray(val, dtype=np.float64))
            for idx, val in zip(part["idx"], part["val"])]


def _product(L: _Block, R: _Block) -> np.ndarray:
    """Similarity of each row of L and each of R.  Terms that many of the pairs
    share are multiplied as dense matrices; of the others only the pairs that
    share them are visited."""
    left, right = np.diff(L.at), np.diff(R.at)
    dense = np.flatnonzero(left.astype(float) * right > DENSE_SHARE * L.n * R.n)
    column = np.full(L.V, -1)
    column[dense] = np.arange(len(dense))
    XL = L.dense(column, len(dense))
    S = XL @ (XL if L is R else R.dense(column, len(dense))).T
    light = np.flatnonzero((column[L.idx] < 0) & (right[L.idx] > 0))
    row, term, val = L.row[light], L.idx[light], L.val[light]
    partners = right[term]
    upto = np.cumsum(partners)
    flat, at = S.reshape(-1), 0
    while at < len(light):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + LIGHT_PRODUCTS, side="right")))
        m = partners[at:end]
        own = np.repeat(R.at[term[at:end]] - (upto[at:end] - m - base), m) + np.arange(upto[end - 1] - base)
        lo, hi = row[at] * R.n, (row[end - 1] + 1) * R.n
        cell = R.term_row[own] + np.repeat((row[at:end] - row[at]) * R.n, m)
        flat[lo:hi] += np.bincount(cell, R.term_val[own] * np.repeat(val[at:end], m), minlength=hi - lo)
        at = end
    return S


def _top_products(idx: np.ndarray, products: np.ndarray, n: int) -> list[list[int]]:
    """Per row of ``products``: the term indices of its n largest positive
    entries (12 places), ties by index.  ``idx`` ascends."""
    p = np.round(products, 12)
    order = np.argsort(-p, axis=1, kind="stable")[:, :n]
    ok = np.take_along_axis(p, order, axis=1) > 0
    return [idx[o[k]].astype(np.int32).tolist() for o, k in zip(order, ok)]


def _shared_terms(left: list, right: np.ndarray, ia: np.ndarray, ib: np.ndarray, n: int) -> list[list[int]]:
    """Top shared terms of the pairs (left row ia, right row ib).  Only the
    left row's own terms are looked at, for all its partners at once."""
    out: list = [None] * len(ia)
    order = np.argsort(ia, kind="stable")
    cuts = np.flatnonzero(np.diff(ia[order], prepend=-1))
    for at, end in zip(cuts, np.append(cuts[1:], len(order))):
        pairs = order[at:end]
        idx, val = left[ia[pairs[0]]]
        for s in range(0, len(pairs), 512):
            some = pairs[s:s + 512]
            for k, t in zip(some, _top_products(idx, right[np.ix_(ib[some], idx)] * val, n)):
                out[k] = t
    return out


def _pair_frame(a, b, sim, sa, sb, terms) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_a": np.asarray(a, dtype=np.int64), "doc_b": np.asarray(b, dtype=np.int64), "sim": np.asarray(sim, dtype=np.float64),
        "src_a": pd.Series(sa, dtype=object), "src_b": pd.Series(sb, dtype=object), "terms": pd.Series(terms, dtype=object)})


def _bins(v: np.ndarray, lo: float, hi: float, nbins: int) -> np.ndarray:
    return np.clip(((v - lo) * (nbins / (hi - lo))).astype(np.int64), 0, nbins - 1)


def _narrowed(path: tuple, lo: float, hi: float, nbins: int) -> tuple[float, float]:
    """The range of the bin that ``path`` leads to, bin by bin."""
    for b in path:
        width = (hi - lo) / nbins
        lo, hi = lo + b * width, lo + (b + 1) * width
    return lo, hi


class _Best:
    """The k best partners so far of each document of a block, over all block
    pairs of a task, so that a document leaves a task k times, not once for each
    block it met.  A pair below its document's k-th best is never looked at."""

    def __init__(self, block: _Block, k: int, floor: float):
        self.ids, self.src, self.k, self.floor = block.ids, block.src, k, floor
        self.least = np.full(block.n, floor)
        self.row, self.sim6, self.sim, self.other, self.other_src, self.terms = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object), np.zeros(0, dtype=object)

    def meet(self, S: np.ndarray, axis: int, block: _Block, terms) -> None:
        """Partners of ``block``; this block's documents are the rows (axis 0) or
        columns (1) of S.  ``terms`` gives the shared terms of (own row, other row)."""
        near = lambda least: S >= np.expand_dims(least - 1e-6, 1 - axis)
        found = near(self.least)
        if np.count_nonzero(found) > 8 * self.k * len(self.ids):  # little is known of these documents yet
            k = min(self.k, block.n)
            found = near(np.maximum(self.least, np.round(np.take(np.partition(S, block.n - k, axis=1 - axis), block.n - k, axis=1 - axis), 6)))
        at = np.nonzero(found)
        sim = S[at]
        sim6 = np.round(sim, 6)
        real = (sim6 >= self.least[at[axis]]) & np.isfinite(sim6)
        if not real.any():
            return
        row, other, sim, sim6 = at[axis][real], at[1 - axis][real], sim[real], sim6[real]
        ids = block.ids[other]
        fresh = np.concatenate([np.full(len(self.row), -1), other])
        row, sim6, sim, ids = np.concatenate([self.row, row]), np.concatenate([self.sim6, sim6]), np.concatenate([self.sim, sim]), np.concatenate([self.other, ids])
        src = np.concatenate([self.other_src, block.src[other]])
        order = np.lexsort((ids, -sim6, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        kept = order[place < self.k]
        known = np.concatenate([self.terms, np.full(len(other), None)])[kept]
        self.row, self.sim6, self.sim, self.other, self.other_src, fresh = row[kept], sim6[kept], sim[kept], ids[kept], src[kept], fresh[kept]
        new = np.flatnonzero(fresh >= 0)
        for i, t in zip(new, terms(self.row[new], fresh[new])):
            known[i] = t
        self.terms = known
        full = order[place == self.k - 1]
        self.least[row[full]] = sim6[full]

    def frame(self) -> pd.DataFrame:
        return _pair_frame(self.ids[self.row], self.other, self.sim, self.src[self.row], self.other_src, self.terms)


def _kernel(mode: str, V: int, k: int, floor: float, lo: float, hi: float, n_shared: int, nbins: int, path: tuple):
    def products(frames):
        """(names of the blocks, blocks, similarities) of each block pair; the
        left blocks of a row stay while their partners pass."""
        number, lefts = None, []
        for f in frames:
            for pi, pj, left, right in zip(f["pi"], f["pj"], f["left"], f["right"]):
                if pi != number:
                    number, lefts = pi, [_Block(x, V) for x in pickle.loads(left)]
                rights = lefts if pi == pj else [_Block(x, V) for x in pickle.loads(right)]
                for i, L in enumerate(lefts):
                    for j, R in enumerate(rights):
                        if pi != pj or i <= j:
                            yield (pi, i), (pj, j), L, R, _product(L, R)

    def shared(L: _Block, R: _Block):
        held: list = []

        def of(ia, ib):
            if not n_shared:
                return [[]] * len(ia)
            if not held:
                held.extend([L.rows(), R.dense(np.arange(V), V)])
            return _shared_terms(*held, ia, ib, n_shared)
        return of

    def sims(L: _Block, R: _Block, S: np.ndarray) -> np.ndarray:
        """The similarities on the path, each pair once."""
        v = np.clip(S[np.triu_indices(L.n, 1)] if L is R else S.reshape(-1), 0.0, None)
        for i, b in enumerate(path):
            v = v[_bins(v, *_narrowed(path[:i], lo, hi, nbins), nbins) == b]
        return v

    def counts(frames):
        total = np.zeros(nbins, dtype=np.int64)
        for _, _, L, R, S in products(frames):
            total += np.bincount(_bins(sims(L, R, S), *_narrowed(path, lo, hi, nbins), nbins), minlength=nbins)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bin": at.astype(np.int32), "n": total[at]})

    def values(frames):
        v, n = np.zeros(0), np.zeros(0, dtype=np.int64)
        held, fresh = [], 0

        def merged():
            at, where = np.unique(np.concatenate([v, *held]), return_inverse=True)
            return at, np.bincount(where, np.concatenate([n, np.ones(fresh)]), minlength=len(at)).astype(np.int64)

        for _, _, L, R, S in products(frames):
            held.append(sims(L, R, S))
            fresh += len(held[-1])
            if fresh > VALUE_ROWS:
                v, n = merged()
                held, fresh = [], 0
                if len(v) > VALUE_ROWS:
                    yield pd.DataFrame({"v": v, "n": n})
                    v, n = np.zeros(0), np.zeros(0, dtype=np.int64)
        v, n = merged()
        yield pd.DataFrame({"v": v, "n": n})

    def pairs(frames):
        for _, _, L, R, S in products(frames):
            terms, step = shared(L, R), max(1, PAIR_ROWS // R.n)
            for s in range(0, L.n, step):
                ii, jj = np.nonzero(S[s:s + step] >= lo)
                ii += s
                if L is R:
                    ii, jj = ii[jj > ii], jj[jj > ii]
                if not len(ii):
                    continue
                a, b = L.ids[ii], R.ids[jj]
                swap = a > b
                a, b, sim = np.where(swap, b, a), np.where(swap, a, b), S[ii, jj]
                if mode == "sims":
                    yield pd.DataFrame({"doc_a": a, "doc_b": b, "sim": sim})
                else:
                    yield _pair_frame(a, b, sim, np.where(swap, R.src[jj], L.src[ii]), np.where(swap, L.src[ii], R.src[jj]), terms(ii, jj))

    def topk(frames):
        best: dict[tuple, _Best] = {}
        for left, right, L, R, S in products(frames):
            if L is R:
                np.fill_diagonal(S, -np.inf)
            for name, own, other, axis in [(left, L, R, 0), (right, R, L, 1)][:1 if L is R else 2]:
                if name not in best:
                    best[name] = _Best(own, k, floor)
                best[name].meet(S, axis, other, shared(own, other))
        for b in best.values():
            yield b.frame()

    return {"hist": counts, "values": values, "pairs": pairs, "sims": pairs, "topk": topk}[mode]


PAIR_SCHEMA = ("doc_a long, doc_b long, sim double, src_a string, src_b string, "
               "terms array<int>")
#: What each mode returns; ``sims`` are the pairs without sources and terms.
SCHEMAS = {"hist": "bin int, n long", "values": "v double, n long", "pairs": PAIR_SCHEMA, "topk": PAIR_SCHEMA, "sims": "doc_a long, doc_b long, sim double"}


def block_products(vecs: DataFrame, V: int, n_docs: int, mode: str, k: int = K_NEIGHBOURS,
                   floor: float = SIM_FLOOR, lo: float = 0.0, hi: float = 2.0, n_shared: int = N_SHARED,
                   nbins: int = HIST_BINS, doc: str = "doc_id",
                   block_docs: int = BLOCK_DOCS, path: tuple = ()) -> DataFrame:
    """What ``mode`` asks for of all pairs of ``vecs`` (vectors, or the table
    that :func:`packed_blocks` made of them).  ``hist`` counts the pairs by bin
    of the range lo to hi, or of the bin that ``path`` leads to, bin by bin;
    ``values`` has the distinct similarities there."""
    blocks = vecs if vecs.columns == ["blk", "held"] else packed_blocks(vecs, n_docs, doc, block_docs)
    pairs = blocks.toDF("pi", "left").crossJoin(blocks.toDF("pj", "right")).where("pi <= pj")
    return pairs.mapInPandas(_kernel(mode, V, k, floor, lo, hi, n_shared, nbins, path), SCHEMAS[mode])


def with_term_names(pairs: DataFrame, vocabulary: DataFrame, sep: str = ", ") -> DataFrame:
    """Replace term indices by names, joined by ``sep``.

    The vocabulary has at most max_features names (a fixed bound), so it is
    read once and inlined as a literal array indexed by term_idx.
    """
    names = [r[0] for r in vocabulary.select("term", "term_idx").orderBy("term_idx").collect()]
    arr = F.array(*[F.lit(t) for t in names]) if names else F.array().cast("array<string>")
    return pairs.withColumn(
        "shared_terms",
        F.array_join(F.transform("terms", lambda i: F.element_at(arr, i + 1)), sep)).drop("terms")


# ---------------------------------------------------------------------------
# index method (pure joins)
# ---------------------------------------------------------------------------

def cosine_pairs_index(weights_df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b, sim), doc_a < doc_b, sim > 0, via a self-join on term.
    Costs the sum over terms of df^2: for small tables, to check the block
    kernel by."""
    a = weights_df.select(F.col(doc).alias("doc_a"), "term", F.col("weight").alias("wa"))
    b = weights_df.select(F.col(doc).alias("doc_b"), "term", F.col("weight").alias("wb"))
    return a.join(b, "term").where(F.col("doc_a") < F.col("doc_b")) \
        .groupBy("doc_a", "doc_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


# ---------------------------------------------------------------------------
# derived operators
# ---------------------------------------------------------------------------

def exact_percentile(vecs: DataFrame, V: int, n_docs: int, q: float = 0.95,
                     doc: str = "doc_id", block_docs: int = BLOCK_DOCS) -> float:
    """numpy-style (linear) percentile of ALL n(n-1)/2 pair similarities,
    zeros included - exact.

    A pass over all pairs counts them in 65,536 bins.  The bin that holds the
    wanted rank is the next pass's range while it has more than ``STORED_PAIRS``
    pairs; then its distinct values are stored, with the number of their pairs,
    and searched in the same way, down to one value.  Only bins reach the driver.
    """
    N = n_docs * (n_docs - 1) // 2
    if N == 0:
        return 0.0
    blocks = packed_blocks(vecs, n_docs, doc, block_docs)
    passes: dict = {}

    def once_only(what, make):
        if what not in passes:
            passes[what] = make()
        return passes[what]

    def counts(path: tuple) -> list:
        return once_only(path, lambda: block_products(blocks, V, n_docs, "hist", path=path).groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect())

    def stored(path: tuple) -> DataFrame:
        return once_only((path, "stored"), lambda: as_table(block_products(blocks, V, n_docs, "values", path=path), "similarities"))

    def bins(path: tuple, lo: float, hi: float) -> list:
        at = F.least(F.floor((F.col("v") - lo) * (HIST_BINS / (hi - lo))), F.lit(HIST_BINS - 1)) if hi > lo else F.lit(0)
        return once_only((path, lo, hi), lambda: stored(path).where(F.col("v").between(lo, hi)).groupBy(at.alias("bin"))
                         .agg(F.sum("n").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).orderBy("bin").collect())

    def holding(rows: list, rank: int, below: int) -> tuple:
        """The row that holds the rank, and the pairs below it."""
        for r in rows:
            if rank < below + r["n"]:
                break
            below += r["n"]
        return (r, below) if rank < below + r["n"] else (r, below - r["n"])

    def value_at(rank: int) -> float:
        path, below = (), 0
        while True:
            r, below = holding(counts(path), rank, below)
            path += (r["bin"],)
            if r["n"] <= STORED_PAIRS or len(path) == 3:  # 7e-15 wide by then
                break
        lo, hi = (once_only((path, "ends"), lambda: stored(path).agg(F.min("v"), F.max("v")).first()))
        while True:
            r, below = holding(bins(path, lo, hi), rank, below)
            if r["mn"] == r["mx"]:
                return r["mn"]
            lo, hi = r["mn"], r["mx"]

    pos = q * (N - 1)
    k0 = int(math.floor(pos))
    v0, v1 = value_at(k0), value_at(min(k0 + 1, N - 1))
    return float(v0 + (pos - k0) * (v1 - v0))


def knn_edges(vecs: DataFrame, V: int, n_docs: int, k: int = K_NEIGHBOURS,
              floor: float = SIM_FLOOR, doc: str = "doc_id",
              block_docs: int = BLOCK_DOCS, n_shared: int = N_SHARED) -> DataFrame:
    """Undirected kNN graph: union of every document's top-k (sim >= floor).

    Each task proposes at most k partners per document it met; the final
    top-k per document is a window over these candidates.
    Output (doc_a < doc_b, sim, src_a, src_b, terms).
    """
    cand = block_products(vecs, V, n_docs, "topk", k=k, floor=floor, doc=doc,
                          block_docs=block_docs, n_shared=n_shared)
    w = Window.partitionBy("doc_a").orderBy(F.round("sim", 6).desc(), F.col("doc_b").asc())
    top = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    und = top.select(
        F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"),
        "sim",
        F.when(F.col("doc_a") < F.col("doc_b"), F.col("src_a")).otherwise(F.col("src_b")).alias("sa"),
        F.when(F.col("doc_a") < F.col("doc_b"), F.col("src_b")).otherwise(F.col("src_a")).alias("sb"),
        "terms")
    # the two directions of one edge carry the same similarity and terms
    return und.groupBy("a", "b").agg(F.first("sim").alias("sim"), F.first("sa").alias("src_a"),
                                     F.first("sb").alias("src_b"), F.first("terms").alias("terms")) \
        .withColumnRenamed("a", "doc_a").withColumnRenamed("b", "doc_b")


def threshold_pairs(vecs: DataFrame, V: int, n_docs: int, threshold: float,
                    n_shared: int = N_SHARED, doc: str = "doc_id",
                    block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All pairs with similarity (6 places) >= threshold (6 places)."""
    lo = max(0.0, round(threshold, 6) - 1e-6)
    p = block_products(vecs, V, n_docs, "pairs", lo=lo, n_shared=n_shared, doc=doc,
                       block_docs=block_docs)
    return p.where(F.round("sim", 6) >= F.lit(round(threshold, 6)))


def shared_terms_join(edges: DataFrame, vecs: DataFrame, n_shared: int = N_SHARED,
                      doc: str = "doc_id") -> DataFrame:
    """Add ``terms`` (top shared term indices) to a set of edges: the two
    documents' rows are joined to each edge and intersected there, so the
    cost is linear in edges and nothing is exploded.  Order: product (12
    places) desc, term index asc."""
    ship_package(vecs.sparkSession)
    own = vecs.select(F.col(doc).alias("d"), "idx", "val")
    both = edges.drop("terms").join(own.toDF("doc_a", "ia", "va"), "doc_a", "left").join(own.toDF("doc_b", "ib", "vb"), "doc_b", "left")
    keep = [c for c in edges.columns if c != "terms"]
    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in keep) + ", terms array<int>"

    def run(frames):
        for f in frames:
            terms = []
            for ia, va, ib, vb in zip(f["ia"], f["va"], f["ib"], f["vb"]):
                if ia is None or ib is None:
                    terms.append([])
                    continue
                idx, x, y = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
                terms.append(_top_products(idx, (np.asarray(va)[x] * np.asarray(vb)[y])[None, :], n_shared)[0])
            yield f[keep].assign(terms=pd.Series(terms, dtype=object, index=f.index))

    return both.mapInPandas(run, schema)


__all__ = ["doc_vectors", "packed_blocks", "block_products", "cosine_pairs_index", "exact_percentile", "knn_edges", "threshold_pairs",
           "shared_terms_join", "with_term_names", "cut_lineage"]
