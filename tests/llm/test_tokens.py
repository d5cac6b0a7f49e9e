import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, wavelet
from tessera.llm.text import column
from tessera.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids int"
ROWS = [(5, "the cat's hat, 12 times", "en", "a", 1, 0), (None, "no id", None, None, None, 0), (3, None, "en", "a", 0, 0), (4, "", "en", "b", 0, 0), (9, "word " * 9000, "en", "b", 1, 0), (3, "again", "en", "a", 1, 0), (5, "the cat's hat, 12 times", "en", "a", 1, 0)]


def test_encoder_equals_library():
    rnd = random.Random(1)
    bits = ["a", "b", "Z", "'", "'s", "'re", "'ll", "'ve", "'m", "'d", "'t", " ", "  ", "\n", "\n\n", "\t", "1", "23", ".", "!!", "é", "ß", "×", "÷", " '", "_", "\x1c", "\x00", "“", "日本", "½", "\x85", "€", "<|endoftext|>"]
    texts = ["".join(rnd.choice(bits[: 26 if i % 2 else 34]) for _ in range(rnd.randint(0, 30))) for i in range(6000)]
    e = encoder()
    flat, o = e.encode(*column(pa.array([*texts, None])))
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert [flat[o[i] : o[i + 1]].tolist() for i in range(len(want))] == want


def test_wavelet_operations():
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 300, 5000), r.integers(0, 9, 8 * wavelet.BLOCK), r.integers(0, 70000, 90_000), np.array([7]), np.zeros(100, int), np.array([70000, 3])):
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, [1], [len(ids)]).to_bytes())
        assert w.decode().tolist() == ids.tolist()
        at = r.integers(0, len(ids), 50)
        assert w.access(at).tolist() == ids[at].tolist()
        for t in {int(ids[0]), 299, 1 << 20}:
            assert w.locate(t).tolist() == np.flatnonzero(ids == t).tolist()
            assert w.count(t, 0, len(ids) // 2) == int((ids[: len(ids) // 2] == t).sum())
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"XXXX" + bytes(20))


def test_a_shard_file_is_queried_by_its_blocks(spark, tmp_path):
    r = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in r.integers(0, 5000, 4000)), "en", "a", 0, 0) for i in range(60)]
    shards = wavelet.write_shards(spark.createDataFrame(texts, DOCS).repartition(2), shard_bytes=600_000)
    files = wavelet.write_files(shards, str(tmp_path / "out")).orderBy("shard").collect()
    assert len(files) > 1 and [f.size for f in files] == [(tmp_path / "out" / f"shard-{f.shard:06d}.wmx").stat().st_size for f in files]
    ids = np.concatenate([x for _, x in expected(texts, 2)])
    start = 0
    for f in files:
        w, read = wavelet.WaveletMatrix.from_file(f.file), []
        plain = w.read
        w.read = lambda at, size, plain=plain, read=read: read.append(size) or plain(at, size)
        mine = ids[start : start + w.n]
        assert w.n > 8 * wavelet.BLOCK and w.access(5).tolist() == mine[5:6].tolist()
        assert sum(read) < f.size / 4  # a few blocks of each plane
        at = r.integers(0, w.n, 200)
        assert w.access(at).tolist() == mine[at].tolist()
        for t in (2, int(mine[7]), int(mine[-2])):
            assert w.locate(t).tolist() == np.flatnonzero(mine == t).tolist() and w.count(t, 100, w.n - 9) == int((mine[100 : w.n - 9] == t).sum())
        assert (w.decode() == mine).all()
        start += w.n
    assert start == len(ids)


def expected(rows, end):
    tok = encoder().tok
    return [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_op2(spark):
    df = spark.createDataFrame(ROWS, DOCS).repartition(3)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.op2(df, shard_bytes=20000).collect()), key=lambda x: x[0])
    assert [g[1] for g in got] == [None, 3, 3, 4, 5, 5, 9]
    assert sorted((g[2], g[3]) for g in got) == sorted((len(i), crc(i)) for _, i in expected(ROWS, 2))
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    assert wavelet.op2(df.where("false")).count() == 0


def test_op3(spark):
    r = random.Random(2)
    rows = [*ROWS, *[(100 + i, "ab cd " * r.randint(1, 900), "en", "a", 1, 0) for i in range(300)]]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = packing.op3(df, with_ids=True).collect()
    want = {}
    for d, ids in expected(rows, 0):
        want.setdefault(d, []).append(ids)
    by_doc, by_seq = {}, {}
    for p in out:
        assert p.ids_crc32 == crc(p.ids) and p.length == len(p.ids) <= 2048
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, docs in want.items():
        assert sum(len(x) for x in docs) == sum(p.length for p in by_doc[d])
        if len(docs) == 1:
            ps = sorted(by_doc[d], key=lambda p: p.piece)
            assert [i for p in ps for i in p.ids] == docs[0] and all(p.length == 2048 for p in ps[1:])
            assert [p.start for p in ps] == np.cumsum([0, *[p.length for p in ps[:-1]]]).tolist()
    for s in by_seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    bins = []  # first fit by descending length, the plain way
    for n in sorted((p.length for p in out), reverse=True):
        i = next((i for i, x in enumerate(bins) if x + n <= 2048), None)
        if i is None:
            bins.append(n)
        else:
            bins[i] += n
    assert len(by_seq) <= len(bins) + 1
    assert packing.op3(df.where("false")).count() == 0


def test_plan_holds_demand():
    d = np.zeros(2049, np.int64)
    d[np.random.default_rng(1).integers(1, 2049, 20000)] += 1
    d *= 40
    p = packing.plan(d)
    got = np.zeros_like(d)
    for c, m in p:
        assert sum(c) <= 2048
        got += np.bincount(c, minlength=2049) * m
    assert (got == d).all()


@pytest.mark.parametrize("scale", [1, 1000])
def test_program_covers_all_demand(scale):
    d = np.random.default_rng(5).integers(0, 60, 513) * scale
    d[[0, 512]] = 0
    got = packing.solve_lp(d, 512)
    cover = sum(x * np.bincount(c, minlength=513) for c, x in got)
    assert np.allclose(cover, d)
    assert sum(x for _, x in got) <= 1.02 * (d * np.arange(513)).sum() / 512


def large_histograms():
    r = np.random.default_rng(1)
    yield "few lengths", np.bincount(r.choice([683, 690, 700, 1030, 1100, 500, 420], 250_000), minlength=2049), 1.006
    yield "all lengths", np.bincount(np.clip(r.lognormal(6, 1, 250_000), 1, 2047).astype(int), minlength=2049), 1.001


@pytest.mark.parametrize(("name", "demand", "most"), list(large_histograms()), ids=["few", "all"])
def test_the_program_packs_large_histograms(name, demand, most):
    solution, bound = packing.solve(demand, 2048)
    cover = sum(x * np.bincount(c, minlength=2049) for c, x in solution)
    assert (cover >= demand * (1 - 1e-9)).all() and all(sum(c) <= 2048 for c, _ in solution)
    assert bound >= np.arange(2049) @ demand / 2048 - 1e-6 and sum(x for _, x in solution) <= bound * most
    left = demand.astype(np.int64).copy()
    kept = packing.rounded(solution, left)
    held = sum(m * np.bincount(c, minlength=2049) for c, m in kept)
    assert (held + left == demand).all() and held.sum() >= 0.95 * demand.sum()  # the program's columns hold nearly all pieces
    bins = sum(m for _, m in packing.plan(demand))
    assert bound <= bins <= bound * most + 1
    assert bins <= sum(m for _, m in packing.best_fit(demand, 2048))


def test_best_fit_uses_the_room_of_bins_begun():
    left = np.zeros(11, np.int64)
    left[[3, 4]] = 2, 1
    assert sorted(packing.best_fit(left, 10, [((7,), 2), ((6,), 1)])) == [((6, 4), 1), ((7, 3), 2)]
