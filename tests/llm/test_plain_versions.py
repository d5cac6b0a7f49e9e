"""The three classifiers' whole results against plain versions: features and scores text by text, the network step by step."""

import math
import random

import numpy as np

from tessera.llm import langid, linear, quality, text, toxicity
from tests.llm.test_models import DOCS, corpus, held

M = (1 << 64) - 1
SPACES = b"\t\n\x0b\x0c\r "


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M
    return h ^ h >> 31


def bucket(h):
    return mix(h & M) >> 64 - linear.BITS


def span(b, lower=False):
    """Hash of a byte string: its bytes' fixed numbers, each times the next power of one fixed factor, and the length."""
    b = bytes(b).lower() if lower else bytes(b)  # ASCII letters alone
    a, p, h = int(text._A), 1, 0
    for x in b:
        h += int(text._BYTE[x]) * p
        p = p * a & M
    return mix((h + len(b)) & M)


def split(raw):
    out, at = [], 0
    for w in raw.translate(bytes(32 if i in SPACES else i for i in range(256))).split(b" "):
        if w:
            out.append(raw[at : at + len(w)])
        at += len(w) + 1
    return out


def letter(x):
    return x >= 128 or chr(x).isascii() and chr(x).isalpha()


def alnum(x):
    return letter(x) or 48 <= x < 58


def plain_features(t, kinds):
    raw, out = (t or "").encode(), set()
    if "bytes" in kinds:
        for n in (2, 3, 4):
            out |= {bucket(int.from_bytes(raw[i : i + n], "big") + (n << 40)) for i in range(len(raw) - n + 1)}
    ws = split(raw)
    if "words" in kinds:
        bare = []
        for w in ws:
            k = [i for i, x in enumerate(w) if alnum(x)]
            if k:
                bare.append(w[k[0] : k[-1] + 1])
        for w in bare:
            out.add(bucket(span(w, True)))
            out |= {bucket(span(w[:k], True) + k) for k in (4, 5, 6, 8) if len(w) > k}
        out |= {bucket(span(x, True) * 3 + mix(span(y, True))) for x, y in zip(bare, bare[1:], strict=False)}
    if "shapes" in kinds:
        shapes = []
        for i, w in enumerate(ws):
            letters, upper = sum(map(letter, w)), sum(65 <= x < 91 for x in w)
            caps = 0 if not letters else 1 if upper == letters and len(w) > 1 else 2 if 65 <= w[0] < 91 else 3
            tail = 0 if alnum(w[-1]) else 1 + w[-1]
            signs = min(len(w) - sum(map(alnum, w)), 3)
            again = int(i > 0 and ws[i - 1] == w)
            shapes.append((((caps * 4 + signs) * 260 + tail) * 2 + again) * 4 + min(len(w) // 4, 3))
        for i in range(len(shapes)):
            g = 0
            for n in (1, 2, 3):
                if i + n <= len(shapes):
                    g = mix((g * 31 + shapes[i + n - 1] + 1) & M)
                    out.add(bucket(g + n))
    return np.array(sorted(out), np.int64)


def test_features():
    r = random.Random(2)
    bits = ["Ab", "c", "XY", "z.", "'q'", "é", "ß", "1", "22", "--", "?!", "\n", " ", " ", " ", "\t", "longerword", "Other", "日本"]
    texts = ["", " ", "a", "ab", *("".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(60))]
    import pyarrow as pa

    for kinds in (quality.KINDS, toxicity.KINDS):
        got = list(linear.indicators(*text.column(pa.array([*texts, None])), kinds))
        for t, f in zip([*texts, None], got, strict=True):
            assert f.tolist() == plain_features(t, kinds).tolist(), t


def logistic(z):
    return 1 / (1 + math.exp(-min(max(z, -60.0), 60.0)))


def test_op5_and_op9(spark):
    docs, labels = corpus(150, 5)
    docs = [d for d in docs if d[0] is not None and len(d[1] or "") < 5000][:-1]
    d, lab = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    known = {}
    for i, q, tox, _ in labels:
        if i is not None and not held(i):
            was = known.get(i, (i, None, None))
            known[i] = (i, *(max((v for v in (x, y) if v is not None), default=None) for x, y in zip(was[1:], (q, tox), strict=True)))
    there = {x[0] for x in docs}
    # quality
    f = {x[0]: plain_features(x[1], quality.KINDS) for x in docs}
    rows = sorted((i, x[1]) for i, x in known.items() if x[1] is not None and i in there)
    w, b, a, c = quality.fit([f[i] for i, _ in rows], np.array([y for _, y in rows]))
    for r in quality.op5(d, lab).collect():
        k = f[r.doc_id]
        assert abs(r.score - logistic(a * (sum(w[k]) / math.sqrt(max(len(k), 1)) + b) + c)) < 1e-6
    # toxicity
    f = {x[0]: plain_features(x[1], toxicity.KINDS) for x in docs}
    pos = [f[i] for i, x in sorted(known.items()) if x[2] == 1 and i in there]
    named = spark.createDataFrame([(i,) for i, x in known.items() if x[2] is not None], "doc_id long")
    unl = [f[r.doc_id] for r in text.bounded_texts(named, 6000, 24).collect() if r.doc_id in there]
    every = spark.createDataFrame([(i,) for i in there if not held(i)], "doc_id long")
    whole = [f[r.doc_id] for r in text.bounded_texts(every, 6000, 25).collect()]
    prior = np.mean([x[2] == 1 for x in known.values() if x[2] is not None])
    scale = np.minimum(toxicity.feature_scale(pos, unl), toxicity.feature_scale(pos, whole))
    fits = [toxicity.fit(pos, unl, float(prior), scale, seed=23 + k) for k in range(3)]
    w, b = np.mean([x[0] for x in fits], axis=0), np.mean([x[1] for x in fits])
    for r in toxicity.op9(d, lab).collect():
        assert abs(r.score - logistic(sum(w[f[r.doc_id]]) + b)) < 1e-6


def plain_probabilities(net, raw):
    """Every window of 64 bytes, the last one reaching back; each byte's softmax once; their mean."""
    total, t = np.zeros(len(net.langs)), langid.T
    for a in range(0, len(raw), t):
        start = max(min(a, len(raw) - t), 0)
        x = raw[start : start + t].ljust(t, b" ")
        states = np.zeros((t, 2, langid.H))
        for d in range(2):
            h, m = np.zeros(langid.H), net.m[d].astype(float)
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                z = m @ np.concatenate([h, net.emb[:, x[k]], [1.0]])
                g, c = np.clip(z[: langid.H] / 4 + 0.5, 0, 1), np.clip(z[langid.H :], -1, 1)
                h = c + g * (h - c)
                states[k, d] = h
        for k in range(a - start, min(t, len(raw) - start)):
            z = net.out.astype(float) @ np.concatenate([states[k].ravel(), [1.0]])
            e = np.exp(z - z.max())
            total += e / e.sum()
    return total / max(len(raw), 1)


def test_op1(spark):
    docs, _ = corpus(60, 3)
    docs = [d for d in docs if len(d[1] or "") < 5000]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    options = {"per_lang": 60, "epochs": 2}
    net = langid.train(d, **options)
    want = {(x[0], x[1]): plain_probabilities(net, (x[1] or "").encode()) for x in docs}
    texts = {}
    for x in docs:
        texts.setdefault(x[0], set()).add(x[1])
    for r in langid.op1(d, **options).collect():
        can = [want[r.doc_id, t] for t in texts[r.doc_id]]
        if r.lang_pred == "und":
            assert not any(any(ch.isalpha() for ch in t or "") for t in texts[r.doc_id])
        else:
            assert any(net.langs[int(p.argmax())] == r.lang_pred and abs(p.max() - r.score) < 1e-4 for p in can)
