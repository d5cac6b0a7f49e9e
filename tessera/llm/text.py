"""Shared numpy kernels over Arrow text columns: whole batches at once, no per-word Python objects.

A text is the UTF-8 bytes of one slot; a null slot is an empty text here (callers that must tell them apart look at
the column's validity)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_A = np.uint64(0x9E3779B97F4A7C15 | 1)
_A_INV = np.uint64(pow(int(_A), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << int(n).bit_length()
        for i, a in enumerate((_A, _A_INV)):
            p = np.full(size, a, np.uint64)
            p[0] = 1
            _pow[i] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(off: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each; a longer text is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + target, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes other than 0x20 and 0x09-0x0D; runs end with their text."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = ~SPACE[b]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(b))]
    s[inner] |= m[inner]
    e[inner - 1] |= m[inner - 1]
    starts = np.flatnonzero(s)
    ends = np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_counts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    _, _, row = words(b, off)
    return np.bincount(row, minlength=len(off) - 1).astype(np.int64)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever the span lies."""
    p, inv = _powers(len(b) + 1)
    t = (_BYTE_LOWER if lower else _BYTE)[b]
    t *= p[: len(b)]
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(t, out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(b: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of every row, lower-casing A-Z: (flat hashes, offsets). A text with fewer
    words has its whole sequence as one shingle, one without words has none. Works through the rows in chunks."""
    hs, counts = [], []
    for i, j in chunks(off, 1 << 19):
        h, o = _shingles(b[off[i] : off[j]], off[i : j + 1] - off[i], n)
        hs.append(h)
        counts.append(np.diff(o))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hs), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _shingles(b: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    s, e, row = words(b, off)
    rows = len(off) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = span_hashes(b, s, e, lower=True)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    k = len(h) - n + 1
    acc = np.zeros(max(k, 0), np.uint64)
    for i in range(n):
        acc = mix(acc * np.uint64(31) + h[i : i + max(k, 0)] + np.uint64(i + 1))
    ok = row[: max(k, 0)] == row[n - 1 :] if k > 0 else np.zeros(0, bool)
    hs, rs = acc[ok], row[: max(k, 0)][ok]
    for k in range(1, n):  # whole sequences of texts with fewer words
        r = np.flatnonzero(count == k)
        a = np.zeros(len(r), np.uint64)
        for i in range(k):
            a = mix(a * np.uint64(31) + h[first[r] + i] + np.uint64(k + 1000))
        hs, rs = np.concatenate([hs, a]), np.concatenate([rs, r])
    o = np.lexsort((hs, rs))
    hs, rs = hs[o], rs[o]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    hs, rs = hs[new], rs[new]
    return hs, np.concatenate([[0], np.cumsum(np.bincount(rs, minlength=rows))]).astype(np.int64)


def code_points(b: np.ndarray) -> np.ndarray:
    """Exclusive count of code points before each byte (length len(b) + 1)."""
    c = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=c[1:])
    return c


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text has remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: a known id that isn't held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone, so that extra columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def bounded_texts(df: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, the ones whose ids hash lowest: the same on every run, independent of file order."""
    return df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)
