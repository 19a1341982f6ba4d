"""Words of a text and their hashes.

A word is a run of code points other than space and U+0009..U+000D.  The
column form stays in the JVM; the numpy form works on UTF-8 bytes, where
the same six bytes separate words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes handled at once; longer inputs are cut between words.
PIECE = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def word_count(text: Column) -> Column:
    """Number of words (null and blank texts: 0)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS + "+"))).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = _INV = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown by doubling)."""
    global _POW, _INV
    while len(_POW) < n:
        k = len(_POW)
        up, down = np.uint64(pow(_BASE, k, 1 << 64)), np.uint64(pow(_BASE_INV, k, 1 << 64))
        _POW, _INV = np.concatenate([_POW, _POW * up]), np.concatenate([_INV, _INV * down])
    return _POW, _INV


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = sum of values[t] * base**t over i <= t < j."""
    pw, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end)."""
    _, inv = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE[buf])


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a uint8 array."""
    edge = np.ones(len(buf) + 2, dtype=bool)
    edge[1:-1] = _IS_SPACE[buf]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[0::2], at[1::2]


def _pieces(data: bytes):
    """Slices of about PIECE bytes, cut at a separator."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets: text i owns
    ``hashes[offsets[i]:offsets[i + 1]]``."""
    out, counts = [], np.zeros(len(texts), dtype=np.int64)

    def flush(group: list[int]) -> None:
        data = b"\n".join(texts[i] for i in group)
        buf = np.frombuffer(data, dtype=np.uint8)
        s, e = spans(buf)
        out.append(span_hashes(byte_sums(buf), s, e))
        first = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
        counts[group] = np.diff(np.searchsorted(s, first))

    group, total = [], 0
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            if group:
                flush(group)
                group, total = [], 0
            for piece in _pieces(t):
                buf = np.frombuffer(piece, dtype=np.uint8)
                s, e = spans(buf)
                out.append(span_hashes(byte_sums(buf), s, e))
                counts[i] += len(s)
            continue
        group.append(i)
        total += len(t) + 1
        if total > PIECE:
            flush(group)
            group, total = [], 0
    if group:
        flush(group)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), offsets


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (crossing texts: caller masks)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += hashes[j : j + n]
    return mix64(out)


def long_window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """As window_hashes, for long windows: from prefix sums, O(n) for any k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return span_hashes(prefix_sums(hashes), at, at + k)
