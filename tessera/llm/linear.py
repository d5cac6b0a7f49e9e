"""Hashed indicator features shared by the two linear text classifiers, and their scoring pass.

A text's features are the set of hashed n-grams that occur in it: indicators, so a repeated line counts once. Kinds:
``bytes`` 2- to 4-grams; ``words`` lower-cased words stripped of outer punctuation, their beginnings of 4, 5, 6 and 8 bytes, and pairs of them; ``shapes`` 1- to 3-grams of word
shapes (letter case, length class, trailing sign, whether the word repeats the one before)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import chunks, column, mix, span_hashes, words
from tessera.session import map_arrow, stored

BITS = 18
DIM = 1 << BITS
_SHIFT = np.uint64(64 - BITS)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> _SHIFT).astype(np.int64)


def features(b: np.ndarray, off: np.ndarray, kinds: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) pairs, with repeats, for each family of n-grams."""
    out = []
    if not len(b):
        return out
    if "bytes" in kinds:
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        v = b.astype(np.uint64)
        g = v.copy()
        for n in (2, 3, 4):
            if len(b) < n:
                break
            g = (g[: len(b) - n + 1] << np.uint64(8)) | v[n - 1 :]
            ok = row[: len(g)] == row[n - 1 :]
            out.append((row[: len(g)][ok], _bucket(g[ok] + np.uint64(n << 40))))
    s, e, row = words(b, off)
    if not len(s):
        return out
    if "words" in kinds:
        a = np.concatenate([np.flatnonzero(_ALNUM[b]), [len(b)]])
        first = a[np.searchsorted(a, s)]
        last = a[np.maximum(np.searchsorted(a, e) - 1, 0)] + 1
        ok = (first < e) & (last > first)
        h = span_hashes(b, first[ok], last[ok], lower=True)
        r = row[ok]
        out.append((r, _bucket(h)))
        f, z = first[ok], last[ok]
        for k in (4, 5, 6, 8):
            long_ = z - f > k
            out.append((r[long_], _bucket(span_hashes(b, f[long_], f[long_] + k, lower=True) + np.uint64(k))))
        same = r[1:] == r[:-1]
        out.append((r[1:][same], _bucket(h[:-1][same] * np.uint64(3) + mix(h[1:][same]))))
    if "shapes" in kinds:
        def among(mask):
            c = np.concatenate([[0], np.cumsum(mask[b])])
            return c[e] - c[s]

        size, letters, upper = e - s, among(_LETTER), among(_UPPER)
        h = span_hashes(b, s, e)
        repeat = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])
        caps = np.where(letters == 0, 0, np.where((upper == letters) & (size > 1), 1, np.where(_UPPER[b[s]], 2, 3)))
        tail = np.where(_ALNUM[b[e - 1]], 0, 1 + b[e - 1].astype(np.int64))
        signs = np.minimum(size - among(_ALNUM), 3)
        t = ((caps * 4 + signs) * 260 + tail) * 2 + repeat
        t = (t * 4 + np.minimum(size // 4, 3)).astype(np.uint64)
        g = np.zeros(len(t), np.uint64)
        for n in (1, 2, 3):
            if len(t) < n:
                break
            g = mix(g[: len(t) - n + 1] * np.uint64(31) + t[n - 1 :] + np.uint64(1))
            ok = row[: len(g)] == row[n - 1 :]
            out.append((row[: len(g)][ok], _bucket(g[ok] + np.uint64(n))))
    return out


def indicators(b: np.ndarray, off: np.ndarray, kinds: tuple[str, ...]):
    """Each row's distinct buckets, in turn."""
    for i, j in chunks(off, 1 << 17):  # arrays that stay in the processor's cache
        fam = []
        for r, k in features(b[off[i] : off[j]], off[i : j + 1] - off[i], kinds):
            o = np.searchsorted(r, np.arange(j - i + 1))
            fam.append((o, k))
        seen = np.zeros(DIM, bool)
        for x in range(j - i):
            for o, k in fam:
                seen[k[o[x] : o[x + 1]]] = True
            f = np.flatnonzero(seen)
            seen[f] = False
            yield f


def training_rows(docs: DataFrame, ids: list[int], kinds: tuple[str, ...], most_bytes: int = 192 << 20) -> dict[int, np.ndarray]:
    """Features of the given documents (a bounded list), found on the executors; at most DIM numbers a document. What the
    driver holds is bounded by ``most_bytes``: where all features are more, the documents of the lowest id hashes are taken."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "w long") if ids else None
    if wanted is None:
        return {}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = slim.join(F.broadcast(wanted), slim.doc_id == wanted.w, "left_semi")  # bounded by the sample size

    def run(batches):
        for b in batches:
            f = [x.astype(np.int32).tobytes() for x in indicators(*column(b.column(1)), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.binary())], ["doc_id", "f"])

    found = stored(map_arrow(src, run, "doc_id long, f binary"), "training-rows")
    sizes = found.groupBy("doc_id").agg(F.max(F.length("f")).alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h").collect()  # one row a sampled document
    total = np.cumsum([r.n for r in sizes])
    if len(total) and total[-1] > most_bytes:
        found = found.where(F.xxhash64("doc_id") < sizes[int(np.searchsorted(total, most_bytes, side="right"))].h)
    out: dict[int, bytes] = {}
    for r in found.toLocalIterator():  # a partition at a time
        out[r.doc_id] = max(bytes(r.f), out.get(r.doc_id, b""))  # of texts under one id always the same
    return {k: np.frombuffer(out[k], np.int32) for k in sorted(out)}


def apply_linear(docs: DataFrame, weights: np.ndarray | None, bias: float, a: float, c: float, kinds: tuple[str, ...], norm: bool, default: float) -> DataFrame:
    """Adds score = logistic(a * margin + c), margin = w.f (over the root of the number of features if ``norm``) + bias.
    ``default`` is everyone's score without a model."""
    keep = [x for x in docs.columns if x != "score"]
    src = docs.select(*keep)
    at = keep.index("text")
    spark = docs.sparkSession
    w = spark.sparkContext.broadcast(None if weights is None else weights.astype(np.float64))

    def run(batches):
        for b in batches:
            z = np.full(b.num_rows, default)
            if w.value is not None:
                buf, off = column(b.column(at))
                for i, f in enumerate(indicators(buf, off, kinds)):
                    m = w.value[f].sum() / (np.sqrt(max(len(f), 1)) if norm else 1.0) + bias
                    z[i] = 1.0 / (1.0 + np.exp(-np.clip(a * m + c, -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], names=[*keep, "score"])

    return map_arrow(src, run, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic calibration of margins by Newton's method, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -60, 60)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        s = np.linalg.solve(m, g)
        a, c = a - s[0], c - s[1]
        if np.abs(s).max() < 1e-8:
            break
    return (float(a), float(c)) if np.isfinite([a, c]).all() and a > 0 else (1.0, 0.0)


def label_sample(labels: DataFrame, name: str, limit: int, seed: int, where=None) -> list[tuple[int, int]]:
    """At most ``limit`` (doc_id, label) from learnable rows, lowest id hashes first. Null labels are left out; an id with
    several labels has the largest."""
    from tessera.llm.text import bounded_texts, learnable

    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("y")).where(learnable(F.col("doc_id")) & F.col("y").isNotNull())
    rows = rows if where is None else rows.where(where)
    got: dict[int, int] = {}
    for r in bounded_texts(rows, limit, seed).collect():
        got[r.doc_id] = max(r.y, got.get(r.doc_id, r.y))
    return sorted(got.items())
