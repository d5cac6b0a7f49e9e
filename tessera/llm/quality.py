"""Text quality by naive Bayes support vectors.

N-gram indicators are scaled by their class log-count ratios, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent; margins are calibrated on cross-fitted folds. Training uses a bounded sample of
labelled learnable rows (``limit``); every document is then scored whole.

Edge cases: null and empty texts have no features and get the calibrated bias; without labels of both classes every
score is the share of label 1 (0.5 without any label); null labels are left out; of repeated label rows the largest label
counts, and rows that repeat an id are scored each by its text; a very long text is scored whole; an empty table gives no
rows; extra columns, whatever their names, aren't looked at."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import DIM, apply_linear, label_sample, platt, training_rows
from tessera.llm.text import held_out, text_only

KINDS = ("bytes", "shapes")


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(DIM, alpha), np.full(DIM, alpha)
    for f, t in zip(rows, y, strict=True):
        (p if t > 0 else q)[f] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge_dual(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights over buckets (already times the ratios) and bias. Rows are scaled to unit length; a class's cost is
    weighted by the other's share. A row whose dual variable is at its bound and would stay there is passed over."""
    g = np.random.default_rng(seed)
    scaled = [r[f] for f in rows]
    length = np.array([np.sqrt(max(len(f), 1)) for f in rows])
    xs = [s / n for s, n in zip(scaled, length, strict=True)]
    q = np.array([float(x @ x) + 1.0 for x in xs])
    share = np.clip((y > 0).mean(), 0.05, 0.95)
    c = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / (1 - share))
    a, w, bias = np.zeros(len(rows)), np.zeros(DIM), 0.0
    for _ in range(epochs):
        for i in g.permutation(len(rows)):
            f, x = rows[i], xs[i]
            d = y[i] * (float(w[f] @ x) + bias) - 1
            if (a[i] == 0 and d >= 0) or (a[i] == c[i] and d <= 0):
                continue
            new = min(max(a[i] - d / q[i], 0.0), c[i])
            step = (new - a[i]) * y[i]
            a[i] = new
            w[f] += step * x
            bias += step
    return w * r, bias


def margins(rows: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[f].sum() / np.sqrt(max(len(f), 1)) + bias for f in rows])


def fit(rows: list[np.ndarray], y01: np.ndarray, folds: int = 3) -> tuple[np.ndarray, float, float, float]:
    y = np.where(np.asarray(y01) > 0, 1, -1)
    m = np.zeros(len(y))
    for k in range(folds):
        tr, te = np.arange(len(y)) % folds != k, np.arange(len(y)) % folds == k
        part = [rows[i] for i in np.flatnonzero(tr)]
        if len(set(y[tr])) == 2:
            w, b = hinge_dual(part, y[tr], log_count_ratio(part, y[tr]))
            m[te] = margins([rows[i] for i in np.flatnonzero(te)], w, b)
    a, c = platt(m, y)
    w, b = hinge_dual(rows, y, log_count_ratio(rows, y))
    return w, b, a, c


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = 5000, seed: int = 17) -> DataFrame:
    """Adds score to ``docs``. The model learns from at most ``limit`` labelled rows."""
    sample = label_sample(labels, "quality", limit, seed)
    got = training_rows(docs, [d for d, _ in sample], KINDS)
    pairs = [(got[d], y) for d, y in sample if d in got]
    y = np.array([t for _, t in pairs])
    if len(set(y.tolist())) < 2:
        return apply_linear(docs, None, 0, 1, 0, KINDS, True, float(y.mean()) if len(y) else 0.5)
    w, b, a, c = fit([f for f, _ in pairs], y)
    return apply_linear(docs, w, b, a, c, KINDS, True, 0.5)


def op5(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    out = score_quality(text_only(docs), labels, **options)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
