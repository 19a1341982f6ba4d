"""Language-model scores by prediction by partial matching (PPM).

The model is a byte-context trie: a node is a context of up to ``order``
symbols (a document's bytes, then an end mark; before its first byte stand
start marks), and holds how often each symbol followed it in the training
documents.  The trie is kept as one table per depth; the table of a depth is
the next deeper one, summed over the farthest symbol.

A symbol's probability in a context (escape method C, symbol exclusion):
seen there n times of N, among q distinct symbols, n / (N + q); else the
context escapes, with q / (N + q), to the one shorter by a symbol, where all
symbols already refused are left out of N and q.  Below the empty context,
what is left of the alphabet is equally likely.  Counts of a shorter context
include those of its longer ones, so the refused symbols of a context are
just those seen in the longer one: a table of refused counts per context is
enough, no set of symbols is carried.

A model is static, so each distinct (context, symbol) of the corpus needs
its probability once.  Documents are packed into pieces of some megabytes
(compressed Arrow batches); a piece's distinct keys are joined with the
model's tables and meet the piece again to be summed up by document.
Nothing of the model is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import as_table, cut_lineage
from .batches import map_arrow, slices, values
from .words import word_hashes

BITS = 9
END, START = 256, 257
#: Symbols that can follow a context: the bytes and the end mark.
ALPHABET = 257
ORDER = 5
#: Bytes of text in a piece.
PIECE_BYTES = 32 << 20
#: Symbols worked on at once, and key rows handed on at once.
STEP = ROWS = 1 << 18

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Kinds of rows of a piece.
KEYS, TEXTS = 0, 1
#: Keys of tokens have this bit (they are below 0), those of symbols don't.
WORDS = np.int64(-(1 << 63))
#: The key of the token that ends a document.
END_TOKEN = 1


def gram_slices(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, key) of each symbol of each text; a key is the symbol in
    its low bits and the ``order`` symbols before it above."""
    for i, j in slices(texts):
        size = np.array([len(t) for t in texts[i:j]]) + order + 1
        end = np.cumsum(size)
        sym = np.full(end[-1], START, dtype=np.uint16)
        for t, e in zip(texts[i:j], end):
            sym[e - 1 - len(t) : e - 1] = np.frombuffer(t, dtype=np.uint8)
        sym[end - 1] = END
        for a in range(order, len(sym), STEP):
            b = min(len(sym), a + STEP)
            at = np.flatnonzero(sym[a:b] != START) + a
            key = np.zeros(b - a, dtype=np.int64)
            for back in range(order + 1):
                key |= sym[a - back : b - back].astype(np.int64) << (BITS * back)
            yield i + np.searchsorted(end, at, side="right"), key[at - a]


def token_slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, key) of each word and each text's end."""
    for i, j in slices(texts):
        h, at = word_hashes(texts[i:j])
        yield np.repeat(np.arange(i, j), np.diff(at)), (h >> np.uint64(1)).astype(np.int64)
        yield np.arange(i, j), np.full(j - i, END_TOKEN, dtype=np.int64)


class Tally:
    """Distinct keys of what is added, and how often each occurs in learned
    texts; parts are merged as they come."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, found: Iterator[tuple[np.ndarray, np.ndarray]], learned: np.ndarray) -> None:
        for doc, key in found:
            both, n = np.unique(key.view(np.uint64) << np.uint64(1) | learned[doc], return_counts=True)
            self.parts.append(((both >> np.uint64(1)).view(np.int64), n * (both & np.uint64(1)).astype(np.int64)))
            self.held += len(both)
            if self.held > 2 * len(self.parts[0][0]) + (1 << 18):
                self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        key, count = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        self.parts = [(key[first], np.add.reduceat(count, first) if len(first) else count)]
        self.held = len(first)
        return self.parts[0]


def _pieces(docs: DataFrame, learn: Column, keep: list[str], order: int, piece_bytes: int) -> DataFrame:
    """(piece, kind, key, n, data): per piece its distinct keys with their
    training counts (words below 0), and one row of kind TEXTS that holds its
    documents."""
    schema = "piece long, kind byte, key long, n long, data binary"

    def rows(piece: int, kind: int, key: np.ndarray, n: np.ndarray, data: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array(np.full(len(key), piece)), "kind": pa.array(np.full(len(key), kind, dtype=np.int8)),
                                           "key": pa.array(key), "n": pa.array(n), "data": data})

    class Piece:
        def __init__(self, number: int, schema: pa.Schema):
            self.number, self.size, self.grams, self.words = number, 0, Tally(), Tally()
            self.sink = pa.BufferOutputStream()
            self.out = pa.ipc.new_stream(self.sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6)))

        def add(self, batch: pa.RecordBatch, texts: list[bytes], size: int) -> None:
            learned = np.array(batch.column("_learn").to_pylist(), dtype=np.uint64)
            self.grams.add(gram_slices(texts, order), learned)
            self.words.add(token_slices(texts), learned)
            self.out.write_batch(batch)
            self.size += size

        def close(self) -> Iterator[pa.RecordBatch]:
            self.out.close()
            for tally, sign in ((self.grams, 0), (self.words, WORDS)):
                key, n = tally.merged()
                for a in range(0, len(key), ROWS):
                    part = key[a : a + ROWS]
                    yield rows(self.number, KEYS, part | sign, n[a : a + ROWS], pa.nulls(len(part), pa.binary()))
            none = np.zeros(1, dtype=np.int64)
            yield rows(self.number, TEXTS, none, none, pa.array([self.sink.getvalue().to_pybytes()], pa.binary()))

    def run(batches):
        number, piece = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            for i, j in slices(values(batch, "_text", b"")):
                texts = [t.translate(_LOWER) for t in values(batch.slice(i, j - i), "_text", b"")]
                size = sum(map(len, texts))
                if piece and piece.size + size > piece_bytes:
                    yield from piece.close()
                    number, piece = number + 1, None
                low = batch.slice(i, j - i).set_column(at, "_text", pa.array(texts, pa.binary()))
                piece = piece or Piece(number, low.schema)
                piece.add(low, texts, size)
        if piece:
            yield from piece.close()

    text = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), learn.alias("_learn"), F.col("text").cast("binary").alias("_text"))
    return map_arrow(text, run, schema)


def _mask(k: int) -> int:
    return (1 << (BITS * (k + 1))) - 1


def trie(grams: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables by depth, of the training counts ``grams`` (key, n > 0): (key, n)
    of the symbols after the contexts of this depth; and (context, total,
    kinds, refused): its counts, its distinct symbols and what these count
    in the context shorter by one."""
    levels = [cut_lineage(grams)]
    for k in range(order - 1, -1, -1):
        levels.insert(0, cut_lineage(levels[0].groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.sum("n").alias("n"))))
    contexts = []
    for k, rows in enumerate(levels):
        if k:
            shorter = levels[k - 1].select(F.col("key").alias("_k"), F.col("n").alias("_n"))
            rows = rows.join(shorter, F.col("key").bitwiseAND(F.lit(_mask(k - 1))) == F.col("_k"))
        else:
            rows = rows.withColumn("_n", F.lit(0))
        contexts.append(cut_lineage(rows.groupBy(F.shiftright("key", BITS).alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("refused"))))
    return levels, contexts


def log_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """(key, logp): log10 of each key's symbol in its context, of rows
    (key, n) with n the training count, 0 where training never saw the key."""
    levels, contexts = trie(grams.where("n > 0"), order)
    context = lambda k: F.shiftright(F.col("key").bitwiseAND(F.lit(_mask(k))), BITS)
    seen = levels[order].join(contexts[order], context(order) == F.col("context")).select("key", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("logp"))

    open_ = grams.where("n = 0").select("key")
    sofar, done = F.lit(0.0), F.lit(False)
    for k in range(order, -1, -1):
        own = contexts[k].select(F.col("context").alias(f"c{k}"), F.col("total").alias(f"t{k}"), F.col("kinds").alias(f"q{k}"), F.col("refused").alias(f"r{k}"))
        open_ = open_.join(own, context(k) == F.col(f"c{k}"), "left")
        if k < order:
            open_ = open_.join(levels[k].select(F.col("key").alias(f"k{k}"), F.col("n").alias(f"n{k}")), F.col("key").bitwiseAND(F.lit(_mask(k))) == F.col(f"k{k}"), "left")
            mass = F.col(f"t{k}") - F.coalesce(f"r{k + 1}", F.lit(0))
            kinds = F.col(f"q{k}") - F.coalesce(f"q{k + 1}", F.lit(0))
            count = F.col(f"n{k}")
        else:
            mass, kinds, count = F.col(f"t{k}"), F.col(f"q{k}"), F.lit(None).cast("long")
        # a context that every symbol has followed has nothing to escape for
        escape = F.when(F.col(f"q{k}") == ALPHABET, F.lit(0)).otherwise(kinds)
        step = F.when(count.isNotNull(), F.log10(count / (mass + escape))).when(F.coalesce(kinds, F.lit(0)) > 0, F.log10(escape / (mass + escape))).otherwise(F.lit(0.0))
        open_ = open_.withColumn("_sofar", F.when(done, sofar).otherwise(sofar + step)).withColumn("_done", done | count.isNotNull())
        sofar, done = F.col("_sofar"), F.col("_done")
    rest = F.when(done, sofar).otherwise(sofar - F.log10(F.lit(ALPHABET) - F.coalesce("q0", F.lit(0))))
    return seen.unionByName(open_.select("key", rest.alias("logp")))


def _sums(found: Iterator[tuple[np.ndarray, np.ndarray]], n_docs: int, index: pd.Index, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Per text, the number of keys and the sums of ``columns``, given by the
    places of ``index``, over them."""
    out = [np.zeros(n_docs) for _ in range(1 + len(columns))]
    for doc, key in found:
        at = index.get_indexer(key)
        if len(at) and at.min() < 0:
            raise ValueError("a key of the piece is missing")
        out[0] += np.bincount(doc, minlength=n_docs)
        for o, c in zip(out[1:], columns):
            o += np.bincount(doc, weights=c[at], minlength=n_docs)
    return out


def score_documents(docs: DataFrame, learn: Column, order: int = ORDER, keep: list[str] | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``keep`` columns (doc_id) and n_tokens, n_known, train_tokens,
    base_score, score of every row of ``docs`` (text).

    Texts are lower-cased (A-Z) first.  ``learn`` (a condition on the columns
    of ``docs``) names the training documents; all of them are counted, whole.
    score: log10 probability of the text's bytes and its end under the PPM
    model of contexts of ``order`` (6 at most) symbols.  base_score: that of
    its tokens (words and one end) under the smoothed counts of single tokens:
    log10 of (c + 0.1) / (N + 0.1 (V + 1)); n_known tokens occur in training.

    Null and empty texts: the end alone.  A null ``learn``: not learned from.
    Very long texts are worked on in steps; a text is never cut, so a piece
    holds one text at least.  Repeated rows count, and are scored, as often as
    they occur; nothing depends on the order of rows.  No training document:
    every symbol has 1 / 257, every token 1 (a single class).  An empty table
    gives no row.  Further columns of any name are ignored.
    """
    if not 1 <= order <= 6:
        raise ValueError("contexts of 1 to 6 symbols")
    keep = keep or ["doc_id"]
    pieces = as_table(_pieces(docs, F.coalesce(learn, F.lit(False)), keep, order, piece_bytes), "ppm-pieces", compression="zstd")
    keys = pieces.where(F.col("kind") == KEYS).select("piece", "key", "n")
    # several pieces share a task, so that their common keys are added up before they travel
    near = keys.coalesce(-(-keys.rdd.getNumPartitions() // 4))
    counts = as_table(near.groupBy("key").agg(F.sum("n").alias("n")), "ppm-counts")
    tokens = counts.where("key < 0")
    known = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, kinds = known["n"], known["v"]
    # of tokens the count travels, of symbols the log probability
    found = log_probabilities(counts.where("key >= 0"), order).unionByName(tokens.select("key", F.col("n").cast("double").alias("logp")))
    worth = keys.select("piece", "key").join(found, "key")
    texts = pieces.where(F.col("kind") == TEXTS).select(F.col("piece").alias("own"), "data")
    row = T.StructField("_row", T.StructType([docs.schema[c] for c in keep]))
    schema = T.StructType([row, *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        key, logp = right.column("key").to_numpy(), right.column("logp").to_numpy()
        grams, words = pd.Index(key[key >= 0]), pd.Index(key[key < 0] ^ WORDS)
        logp, count = logp[key >= 0], logp[key < 0]
        base = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))
        out = []
        for part in pa.ipc.open_stream(left.column("data")[0].as_py()):  # a piece has one row of texts
            low = values(part, "_text", b"")
            _, score = _sums(gram_slices(low, order), len(low), grams, [logp])
            n, n_known, base_score = _sums(token_slices(low), len(low), words, [(count > 0).astype(float), base])
            out.append(pa.Table.from_pydict({
                "_row": part.column("_row"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
                "base_score": pa.array(base_score), "score": pa.array(score)}))
        return pa.concat_tables(out)

    done = texts.groupBy("own").cogroup(worth.groupBy("piece")).applyInArrow(add_up, schema)
    return done.select("_row.*", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
