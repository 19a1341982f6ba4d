"""Packing documents into token sequences by best-fit decreasing.

Documents are tokenised whole and closed by an end id.  A document longer
than a window is first cut into full windows; what remains of every
document is placed, longest first, into the open window that it fills
best.  Open windows are counted by remaining capacity in a segment tree,
which finds the tightest that fits in ten steps.

Documents are dealt into shards of a bounded number by a hash; a shard is
packed in one task, so memory stays bounded and only a shard's last few
windows are left unfilled.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import ROWS, map_arrow, slices, values

WINDOW = 1024
END_ID = 0
_SHARD_IDS = 1 << 32
_ENCODERS: dict = {}


#: Split rule of the byte-level pre-tokeniser (fixed, part of the vocabulary's definition).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The faster library's split rule needs stack for every blank of a run.
_LONG_BLANK = re.compile(r"\s{1000}")


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranked(path: str):
    """The vocabulary as a rank table for the faster library, or None where
    the file isn't plain byte-level BPE with ids in merge order."""
    import tiktoken

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and spec["normalizer"] is None and spec["post_processor"] is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("ignore_merges")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")))
    if not plain:
        return None
    vocab, name = model["vocab"], _byte_names()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)):
        return None
    own = set(merged)
    ranks = {bytes(name[c] for c in t): i for t, i in vocab.items() if i in own or len(t) == 1}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts by a vocabulary file.  A plain byte-level
    vocabulary runs in the faster of the two libraries (equal ids)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fast = _ranked(path)
        # the library takes these strings in a text as single tokens
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without an end id."""
        if self.fast is None or _LONG_BLANK.search(text) or any(t in text for t in self.added):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenise(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, crcs[, ids]): tokens with the end id, and the CRC
    of each full window and of the rest, in order."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("doc_tokens", T.LongType()),
              T.StructField("crcs", T.ArrayType(T.LongType()))] + [T.StructField("ids", T.BinaryType())] * with_ids

    def run(batches):
        enc, end, step = encoder(vocabulary), array("I", [END_ID]).tobytes(), 4 * window
        for batch in batches:
            texts = values(batch, "text", "")
            for i, j in slices(texts):
                bufs = [enc.encode(t) + end for t in texts[i:j]]
                cols = {"doc_id": batch.column("doc_id").slice(i, j - i), "doc_tokens": pa.array([len(b) // 4 for b in bufs], pa.int64()),
                        "crcs": pa.array([[zlib.crc32(b[k : k + step]) for k in range(0, len(b), step)] for b in bufs], pa.list_(pa.int64()))}
                if with_ids:
                    cols["ids"] = pa.array(bufs, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(docs.select("doc_id", "text"), run, T.StructType(fields))


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.n = 1 << window.bit_length()
        self.count = [0] * (2 * self.n)
        self.ids: list[list[int]] = [[] for _ in range(self.n)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.n
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.ids[capacity].append(window_id)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, id) of the tightest open window that holds ``need``."""
        count, n = self.count, self.n
        i = need + n
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < n:
                i *= 2
                i += not count[i]
        self._add(i - n, -1)
        return i - n, self.ids[i - n].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each item (given longest first), windows used."""
    opened, where, offset, used = OpenWindows(window), [], [], 0
    for need in lengths:
        capacity, at = opened.take(need) or (window, used)
        used += at == used
        where.append(at)
        offset.append(window - capacity)
        if capacity > need:
            opened.put(capacity - need, at)
    return where, offset, used


def _pack_shard(table: pa.Table, window: int, with_ids: bool) -> pa.Table:
    shard, tokens, crcs = table["shard"][0].as_py(), table["doc_tokens"].to_pylist(), table["crcs"].to_pylist()
    ids = table["ids"].to_pylist() if with_ids else None
    row, start, length, seq, offset = [], [], [], [], []
    used = 0
    for r, n in enumerate(tokens):
        for k in range(n // window):
            row.append(r), start.append(k * window), length.append(window), seq.append(used), offset.append(0)
            used += 1
    # the order of the rows that a shuffle delivers must not matter
    rest = sorted((r for r, n in enumerate(tokens) if n % window), key=lambda r: (-(tokens[r] % window), crcs[r], str(table["doc_id"][r])))
    where, at, _ = best_fit([tokens[r] % window for r in rest], window)
    for r, w, o in zip(rest, where, at):
        row.append(r), start.append(tokens[r] // window * window), length.append(tokens[r] % window), seq.append(used + w), offset.append(o)
    out = {"doc_id": table["doc_id"].combine_chunks().take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
           "ids_crc32": pa.array([crcs[r][s // window] for r, s in zip(row, start)], pa.int64()), "doc_tokens": pa.array([tokens[r] for r in row], pa.int64()),
           "sequence_id": pa.array([shard * _SHARD_IDS + s for s in seq], pa.int64()), "offset": pa.array(offset, pa.int64())}
    if with_ids:
        # straight from the buffers: no Python object per token
        tokens_of = np.frombuffer(b"".join(ids[r][4 * s : 4 * (s + n)] for r, s, n in zip(row, start, length)), dtype=np.int32)
        out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens_of))
    return pa.Table.from_batches(pa.table(out).to_batches(max_chunksize=ROWS), pa.table(out).schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, docs_per_shard: int = 8_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids].

    A sequence's pieces lie gapless from offset 0; it is padded to the
    window by who writes it, unless its length is a power of two.  Null and
    empty texts are one piece, the end id.  Null doc_id: passed through.
    Repeated rows are documents of their own.  Order of ties: by length,
    content, doc_id.  An empty table gives no row.  Very long texts are cut
    into full windows first; the ids of a shard's documents are in one task, so
    its memory follows their length.  Further columns, whatever their names,
    aren't looked at.
    """
    n = docs.count()
    d = tokenise(docs, vocabulary or default_vocabulary(), window, with_ids)
    shards = max(1, -(-n // docs_per_shard))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs"), F.lit(shards)).cast("long"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return d.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, window, with_ids), T.StructType(fields))
