import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality, toxicity
from tessera.llm.text import chunks, column

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, label int"
EN = "the and that with from this have which their would about there other into water people".split()
DE = "der die das und nicht mit eine auch werden über zwischen straße größer können müssen für".split()


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=400, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(["de", "en"])
        w = [r.choice(EN if lang == "en" else DE) for _ in range(r.randint(5, 80))]
        toxic, low = r.random() < 0.2, r.random() < 0.3
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["vile", "nasty", "rotten"]))
        if low:
            w = [x + r.choice(["###", "%%%"]) for x in w]
        docs.append((i, " ".join(w), lang if r.random() < 0.9 else None, "s", 1, 0.5, 1, 1))
        if r.random() < 0.8:
            labels.append((i, int(not low), int(toxic), "x"))
    odd = [(n, None, "en", "s", 0, 0.0, 1, 1), (n + 1, "", "de", "s", 0, 0.0, 1, 1), (n + 2, "123 ... 456", "en", "s", 0, 0.0, 1, 1), (None, "the water and the people with that which there", "en", "s", 0, 0.0, 1, 1), (n + 3, "der die das und " * 20000, "de", "s", 0, 0.0, 1, 1), (0, docs[0][1], "en", "s", 0, 0.0, 1, 1)]
    return docs + odd, labels + [(None, 1, 1, "x"), (3, None, None, "x"), (n + 50, 1, 0, "x")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), docs, labels


def test_gradients_match_differences():
    net = langid.Net(["a", "b"], 3)
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (5, 7)).astype(np.uint8), r.integers(0, 2, 7)
    for p in net.params():
        p *= 0.5
    _, gs = net.gradients(x, y)
    for p, g in zip(net.params(), gs, strict=True):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in p.shape)
            if p is net.emb:
                at = (at[0], int(x[2, 1]))
            old = p[at]
            p[at] = old + 2e-3
            up = net.gradients(x, y)[0]
            p[at] = old - 2e-3
            down = net.gradients(x, y)[0]
            p[at] = old
            assert abs((up - down) / 4e-3 - g[at]) < 3e-3


def test_pooling_covers_every_byte():
    import pyarrow as pa

    net = langid.Net(["a", "b", "c"], 3)
    texts = ["", "x", "y" * 63, "ab" * 32, "abc" * 100, "é" * 200]
    b, off = column(pa.array(texts))
    got = np.concatenate([net.documents(b[off[i] : off[j]], off[i : j + 1] - off[i], 3) for i, j in chunks(off, 50)])
    assert np.allclose(got[1:].sum(1), 1, atol=1e-5) and (got[0] == 0).all()
    alone = net.documents(*column(pa.array([texts[4]])))
    assert np.allclose(alone[0], got[4], atol=1e-5)


def test_op1(tables):
    d, _, docs, _ = tables
    out = langid.op1(d, per_lang=400, epochs=15).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (400, 401, 402))
    assert by[403].lang_pred == "de" and by[None].lang_pred in ("de", "en") and by[None].held_out is False
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out if r.doc_id is not None)
    test = [(t[2], by[t[0]].lang_pred) for t in docs[:400] if t[2] and held(t[0])]
    assert np.mean([a == b for a, b in test]) > 0.97
    kept = langid.stage(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {400, 401, 402}
    assert langid.op1(d.where("false")).count() == 0
    assert {r.lang_pred for r in langid.op1(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize(("name", "op", "at", "threshold"), [("quality", quality.op5, 1, 0.7), ("toxic", toxicity.op9, 2, 0.3)])
def test_labelled(spark, tables, name, op, at, threshold):
    d, lab, docs, labels = tables
    out = op(d, lab).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in out)
    by = {r.doc_id: r for r in out}
    test = [(x[at], by[x[0]].predicted) for x in labels if x[0] is not None and x[at] is not None and x[0] < 400 and held(x[0])]
    assert np.mean([a == b for a, b in test]) > 0.95
    # labels of held-out rows aren't looked at
    from tessera.llm.text import held_out

    turned = lab.withColumn(name, F.when(held_out(F.col("doc_id")), 1 - F.col(name)).otherwise(F.col(name)))
    again = {r.doc_id: r.score for r in op(d, turned).collect()}
    assert again == {k: r.score for k, r in by.items()}
    none = op(d, lab.where("false")).collect()
    assert len({r.score for r in none}) == 1
    assert op(d.where("false"), lab).count() == 0


def test_dual_coordinate_descent_optimum():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(50, 8, replace=False)) for _ in range(60)]
    y = np.where(np.array([(f < 20).sum() for f in rows]) > 3, 1, -1)
    ratio = np.ones(quality.DIM)
    w, b = quality.hinge_dual(rows, y, ratio, epochs=400)
    x = np.zeros((60, 51))
    for i, f in enumerate(rows):
        x[i, f] = 1 / np.sqrt(len(f))
    x[:, 50] = 1
    share = np.clip((y > 0).mean(), 0.05, 0.95)
    c = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))

    def primal(v):
        return 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()

    best = np.append(w[:50], b)
    assert all(primal(best) <= primal(best + r.normal(0, s, 51)) + 1e-3 for s in (0.01, 0.1, 0.5) for _ in range(30))


def test_risk_is_not_negative():
    r = np.random.default_rng(2)
    pos = [np.unique(np.append(r.integers(100, 400, 10), 7)) for _ in range(40)]
    unl = [np.unique(np.append(r.integers(100, 400, 10), 7 if r.random() < 0.2 else 8)) for _ in range(200)]
    s = toxicity.feature_scale(pos, unl)
    assert s[7] > 1 and s[8] == 0
    w, b = toxicity.fit(pos, unl, 0.2, s)
    assert w[7] + b > 1 and b < -1


def test_language_stage_keeps_columns_of_any_name(tables):
    d, *_ = tables
    df = d.selectExpr("* except (score)", "-5.0D as score", "'z' as lang_pred", "7 as letter", "8 as _letter")
    out = langid.stage(df)
    assert out.columns == df.columns
    assert {(r.score, r.lang_pred, r.letter, r._letter) for r in out.collect()} == {(-5.0, "z", 7, 8)}


def test_training_rows_stay_within_their_bound(spark, tables):
    from tessera.llm.linear import training_rows

    d, *_ = tables
    whole = training_rows(d, list(range(100)), ("words",))
    size = sum(v.nbytes for v in whole.values())
    some = training_rows(d, list(range(100)), ("words",), most_bytes=size // 2)
    assert size / 4 < sum(v.nbytes for v in some.values()) <= size / 2
    assert all((whole[k] == v).all() for k, v in some.items()) and len(whole) == 100


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 80:02d}", f"text {i % 80} " * 20) for i in range(1600)]
    got = langid.sample_windows(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 40, 7)
    assert {lang for lang, _ in got} == {f"l{k:02d}" for k in range(80)}
