import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, component string"


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=2, percent=80):
    """(n_shingles by row, smallest id reachable) by comparing every pair."""
    s = [sets(t, n) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(x), find(d) if d is not None else None) for (d, _), x in zip(rows, s, strict=True)), key=str)


def corpus(seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 6, 20, 80, 300]))]
        for _ in range(r.choice([1, 1, 2, 9])):
            t = [r.choice(words) if r.random() < r.choice([0, 0.02, 0.06, 0.15]) else w for w in base]
            rows.append((n, r.choice([" ", "\n", "\t "]).join(t) if r.random() < 0.8 else " ".join(t).upper()))
            n += 1
    for i in range(40):  # each links with its neighbours only
        rows.append((n + i, " ".join(f"c{k}" for k in range(i * 2, i * 2 + 30))))
    n += 40
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "a b c"), (None, "w1 w2 w3"), (n + 4, rows[5][1]), (7, rows[7][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("large", "rounds"), [(64, 3), (2, 0)])
def test_against_brute_force(spark, large, rounds):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x") for d, t in rows], DOCS).repartition(3)
    got = minhash.near_duplicates(df, large=large, star_rounds=rounds).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_stage_and_empty(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x") for d, t in rows], DOCS)
    out = minhash.stage(df)
    assert out.columns == df.columns
    want = {c for _, _, c in brute(rows, 5) if c is not None}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1
    assert minhash.op8(df.where("false")).count() == 0


def test_stage_tells_rows_of_one_id_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(3, text(0)), (5, text(0)), (5, text(1)), (5, text(2)), (7, text(2)), (9, text(3)), (9, text(3)), (9, text(4)), (None, text(4)), (11, text(1) + " end")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x") for d, t in order], DOCS).repartition(3)
        out = minhash.stage(df)
        assert out.columns == df.columns
        got = sorted((x.doc_id or 0, x.text) for x in out.collect())
        assert got == sorted([(3, text(0)), (5, text(1)), (5, text(2)), (9, text(3)), (9, text(4)), (0, text(4))])


def test_occupancy_bound_keeps_every_link(spark):
    g = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([g.permutation(base)[: int(len(base) * keep)], g.integers(1, 1 << 62, extra, dtype=np.uint64)])) for base in (g.integers(1, 1 << 62, 60, dtype=np.uint64), g.integers(1, 1 << 62, 900, dtype=np.uint64)) for keep in (1.0, 0.95, 0.9, 0.8, 0.6) for extra in (0, 3, 9)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = minhash.occupancy(np.concatenate(sets), off)
    rows = [(i, j, len(sets[i]), len(sets[j]), bits[i].tolist(), bits[j].tolist()) for i in range(len(sets)) for j in range(i)]
    df = spark.createDataFrame(rows, "i int, j int, n long, m long, a array<long>, b array<long>")
    kept = {(r.i, r.j) for r in df.where(minhash.may_link(F.col("n"), F.col("a"), F.col("m"), F.col("b"), 80)).collect()}
    links = set()
    for i, j, n, m, _, _ in rows:
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (n + m - both):
            links.add((i, j))
    assert links and links <= kept and len(kept) < len(rows) / 2


@pytest.mark.parametrize("twice", [False, True])
def test_stage_keeps_columns_of_any_name(spark, twice):
    rows = [(i, f"one two three four five six {i // 2} seven eight nine ten", 1, 2, "x", 4) for i in range(8)] + [(7, "other words altogether", 1, 2, "x", 4)] * twice
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, gone int, _row string, row int")
    out = minhash.stage(df)
    assert out.columns == df.columns
    assert {(r._gone, r.gone, r._row, r.row) for r in out.collect()} == {(1, 2, "x", 4)} and out.count() == 4 + twice
