"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic learnable rows are the positives. Unlabelled text comes in two bounded draws: from all learnable documents of
the corpus, and from those that ``labels`` names, whatever their label. A feature takes part only if it is surely commoner
among the positives than in both draws. The risk p*E_pos[l(z)] + max(0, E_unl[l(-z)] - p*E_pos[l(-z)]) has the second draw as
its unlabelled set, because the class prior p (the toxic share among learnable labelled rows) is that population's and not
the corpus's. It is minimised by Adam over hashed word indicators; where the corrected negative part of a batch falls below
zero, its gradient is turned round, so that the model can't explain positives away among the unlabelled. Several classifiers
with different seeds are averaged.

The margin is a sum over a text's distinct words and pairs, not a mean, so an insult counts the same in a long text.

Edge cases: null and empty texts get the bias's score; without positives every score is 0; null labels are left out; of
repeated label rows the largest label counts, and rows that repeat an id are scored each by its text; a very long text is
scored whole; an empty table gives no rows; extra columns, whatever their names, aren't looked at."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import DIM, apply_linear, label_sample, training_rows
from tessera.llm.text import bounded_texts, held_out, learnable, text_only

KINDS = ("words",)


def _flat(rows: list[np.ndarray], i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(rows[k]) for k in i])
    return np.repeat(np.arange(len(i)), n), (np.concatenate([rows[k] for k in i]) if n.sum() else np.zeros(0, np.int64)).astype(np.int64)


def feature_scale(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """How far a feature's log rate among positives surely exceeds that among the unlabelled: the smoothed log ratio less
    one and a half standard errors; 0 where it doesn't, so that chance words get no weight."""
    p, u = np.zeros(DIM), np.zeros(DIM)
    for f in pos:
        p[f] += 1
    for f in unl:
        u[f] += 1
    prior = max(1.0, len(unl) / max(len(pos), 1)) * 0.5
    lp = np.log((p + 0.5) / (len(pos) + 1)) - np.log((u + prior) / (len(unl) + 1))
    doubt = np.sqrt(1 / (p + 0.5) + 1 / (u + 0.5))
    return np.where(p > 0, np.clip(lp - 1.5 * doubt, 0.0, 3.0), 0.0)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, scale: np.ndarray, epochs: int = 20, least_steps: int = 200, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, float]:
    """One classifier: weights over buckets (times the scale) and bias. Small sets are gone through more often than ``epochs``
    times, so that ``least_steps`` steps are taken."""
    g = np.random.default_rng(seed)
    active = np.flatnonzero(scale > 0)
    index = np.full(DIM, -1)
    index[active] = np.arange(len(active))
    cut = lambda rows: [index[f][index[f] >= 0] for f in rows]
    pos, unl = cut(pos), cut(unl)
    s = scale[active]
    w, b = np.zeros(len(active)), float(np.log(prior / (1 - prior)))
    m1, m2, mb1, mb2, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    nb = max(1, -(-len(unl) // batch))
    np_ = max(8, min(len(pos), batch))
    for _ in range(max(epochs, -(-least_steps // nb))):
        order = g.permutation(len(unl))
        for k in range(nb):
            ui, pi = order[k * batch : (k + 1) * batch], g.choice(len(pos), min(np_, len(pos)), replace=False)
            (rp, fp), (ru, fu) = _flat(pos, pi), _flat(unl, ui)
            x = s * w
            zp, zu = np.bincount(rp, x[fp], len(pi)) + b, np.bincount(ru, x[fu], len(ui)) + b
            sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            # logistic loss l(z) = log(1 + exp(-z))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_pos = -prior * sig(-zp) / len(pi)
            gp_neg, gu_neg = -prior * sig(zp) / len(pi), sig(zu) / max(len(ui), 1)
            if negative >= 0:
                gp, gu = gp_pos + gp_neg, gu_neg
            else:
                gp, gu = -gp_neg, -gu_neg
            gw = (np.bincount(fp, gp[rp], len(w)) + np.bincount(fu, gu[ru], len(w))) * s + decay * w
            gb = gp.sum() + gu.sum()
            t += 1
            m1 = 0.9 * m1 + 0.1 * gw
            m2 = 0.99 * m2 + 0.01 * gw * gw
            mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
            b -= rate * (mb1 / (1 - 0.9**t)) / (np.sqrt(mb2 / (1 - 0.99**t)) + 1e-7)
    out = np.zeros(DIM)
    out[active] = s * w
    return out, b


def score_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, classifiers: int = 3, seed: int = 23) -> DataFrame:
    """Adds score to ``docs``; bounds: ``positives`` confirmed rows, ``unlabelled`` documents in each of the two draws."""
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") == 1).cast("double"))).collect()[0][0]
    pos = label_sample(labels, "toxic", positives, seed, F.col("y") == 1)
    named = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    unl = [r.doc_id for r in bounded_texts(named, unlabelled, seed + 1).collect()]
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learnable(F.col("doc_id")))
    corpus = [r.doc_id for r in bounded_texts(every, unlabelled, seed + 2).collect()]
    got = training_rows(docs, sorted({d for d, _ in pos} | set(unl) | set(corpus)), KINDS)
    p, u, c = [got[d] for d, _ in pos if d in got], [got[d] for d in unl if d in got], [got[d] for d in corpus if d in got]
    if not p or not u:
        return apply_linear(docs, None, 0, 1, 0, KINDS, False, 0.0)
    prior = float(np.clip(known or 0.1, 0.005, 0.9))
    scale = np.minimum(feature_scale(p, u), feature_scale(p, c))
    fits = [fit(p, u, prior, scale, seed=seed + k) for k in range(classifiers)]
    w, b = np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits]))
    return apply_linear(docs, w, b, 1.0, 0.0, KINDS, False, 0.0)


def op9(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    out = score_toxicity(text_only(docs), labels, **options)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
