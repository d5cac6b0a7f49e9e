import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.operators.ivf import build_ivf, make_index
from tessera.operators.knn import knn_grid
from tessera.operators.quantize import quantize
from tessera.operators.score import decide, fraud_count

COLS = [f"g{i}" for i in range(5)]


def data(spark, n=1500, nq=12, high=60):
    rng = np.random.default_rng(3)
    v = rng.integers(0, high, (n, 5))
    rows = [(i, int(i % 7 == 0), *map(int, v[i])) for i in range(n)]
    refs = spark.createDataFrame(rows, "ref_id long, label int, " + ", ".join(f"{c} int" for c in COLS)).repartition(3)
    q = rng.integers(0, high, (nq, 5))
    queries = spark.createDataFrame([(i, *map(int, q[i])) for i in range(nq)], "query_id long, " + ", ".join(f"{c} int" for c in COLS))
    want = {}
    for i in range(nq):
        d = ((v - q[i]) ** 2).sum(1)
        want[i] = sorted((int(d[j]), j) for j in range(n))[:5]
    return refs, queries, want


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.dist, r.ref_id))
    return out


def test_brute_force_with_ties_and_blocks(spark):
    refs, queries, want = data(spark, high=4)
    assert got(knn_grid(queries, refs, COLS, 5, block=5)) == want


def test_clustered_exact_equals_brute_force(spark):
    refs, queries, want = data(spark)
    ix = build_ivf(refs, COLS, n_centroids=6, max_cluster=100, iters=3)
    assert got(ix.exact(queries)) == want
    n = ix.clusters.count()
    assert ix.clusters.agg(F.sum("n")).collect()[0][0] == 1500 and n > 6
    assert got(ix.with_probe(n).search(queries)) == want
    j = ix.rows.join(ix.clusters, "cluster_id")
    assert j.where((F.col("g0") < F.col("lo_g0")) | (F.col("g0") > F.col("hi_g0"))).count() == 0
    assert ix.early_stop(queries).count() == 60


def test_empty_and_small(spark):
    refs, queries, _ = data(spark)
    none = refs.where("ref_id < 0")
    assert knn_grid(queries, none, COLS).count() == 0
    assert build_ivf(none, COLS, n_centroids=4).exact(queries).count() == 0
    assert make_index("brute_force", refs.where("ref_id < 3"), COLS).search(queries).count() == 36
    assert knn_grid(queries.where("query_id < 0"), refs, COLS).count() == 0
    with pytest.raises(ValueError):
        make_index("other", refs, COLS)


def test_scores(spark):
    near = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 0), (2, 0, 9)], "query_id long, label int, dist long")
    rows = {r.query_id: r for r in decide(fraud_count(near)).collect()}
    assert (rows[1].fraud_score, rows[1].approved) == (0.6, False)
    assert (rows[2].fraud_score, rows[2].approved, rows[2].n_found) == (0.0, True, 1)


def test_evaluator(spark):
    p = spark.createDataFrame([(True, True), (False, False), (False, True), (True, False), (True, True)], "p boolean, e boolean")
    g = p.select(ev.group_of(F.col("p"), F.col("e")).alias("group"), F.lit(5000).alias("g0"))
    assert {r.group: r.n for r in ev.confusion(g).collect()} == {"TN": 2, "TP": 1, "FP": 1, "FN": 1}
    assert {r.group: r.rate for r in ev.confusion(g.where("group = 'TN'")).collect()} == {"TN": 1.0, "TP": 0.0, "FP": 0.0, "FN": 0.0}
    w = ev.feature_stats_wide(g.where("group = 'TN'"), ["g0"], ["amount"]).collect()[0]
    assert (w.name, w.TN_mean, w.TN_std, w.FP_mean) == ("amount", "0.5000", "0.0000", "0")
    a, b = spark.createDataFrame([("x",), ("y",), ("z",)], "value string"), spark.createDataFrame([(" true ",), ("no",)], "value string")
    assert [(r.value, r.expected) for r in ev.zip_lines(a, b).orderBy("line").collect()] == [("x", True), ("y", False)]


def test_quantizer_error_is_half_a_step(spark):
    df = spark.createDataFrame([([-0.3, 0.0, 0.7],), ([0.1, 0.2, 0.3],)], "v array<double>")
    for r in quantize(df).collect():
        assert max(abs(a - b) for a, b in zip(r.v, r.back, strict=True)) <= r.step / 2 + 1e-12
    same = quantize(spark.createDataFrame([([0.5, 0.5],)], "v array<double>")).collect()[0]
    assert same.step == 1.0 and same.back == [0.5, 0.5]


def test_many_queries_meet_references_in_blocks(spark):
    from tessera.operators.knn import nearest
    from tessera.operators import knn

    refs, queries, want = data(spark, high=4)
    out = nearest(queries, refs, COLS, COLS, 5, knn.grid, "long", block=5, part_rows=400)
    assert got(out) == want


@pytest.mark.parametrize("name", ["EUCLIDEAN", "manhattan", " Cosine "])
def test_metrics_as_the_expressions(spark, name):
    from tessera.functions.scalar import metric
    from tessera.operators.knn import best_per_query, knn_join

    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (300, 6)).astype(np.float32)
    v[7] = 0
    refs = spark.createDataFrame([(i, int(i % 3) if i % 5 else None, v[i].tolist()) for i in range(300)] + [(900, 1, None)], "ref_id long, label int, v array<float>").repartition(3)
    queries = refs.where("ref_id % 40 = 0 or ref_id = 7").select(F.col("ref_id").alias("query_id"), F.col("v").alias("qv"))
    plain = queries.crossJoin(refs.dropna(subset=["v"])).withColumn("dist", metric(name)(F.col("qv"), F.col("v")))
    cols = ["query_id", "ref_id", "label", "dist", "rank"]
    want = sorted(map(str, best_per_query(plain, 5, ["dist", "ref_id"]).select(*cols).collect()))
    for block in (4096, 3):
        assert sorted(map(str, knn_join(queries, refs, 5, name, block).select(*cols).collect())) == want


def test_saved_index_gives_the_same_answers(spark, tmp_path):
    from dataclasses import replace

    from tessera.operators.ivf import load_ivf

    refs, queries, want = data(spark)
    ix = build_ivf(refs, COLS, n_centroids=6, max_cluster=100, iters=3)
    ix.save(str(tmp_path / "ix"))
    back = load_ivf(spark, str(tmp_path / "ix"))
    assert got(back.exact(queries)) == want and got(back.search(queries)) == got(ix.search(queries))
    by_joins = replace(back, block=4)  # more queries than that
    assert got(by_joins.exact(queries)) == want and got(by_joins.search(queries)) == got(back.search(queries))
    probes, rest = back.probes(queries).count(), back.unprobed(queries).count()
    assert probes == 24 and probes + rest == 12 * ix.clusters.count()
    back.clusters.limit(3).write.parquet(str(tmp_path / "ix/other"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "ix/rows").rename(tmp_path / "bad/rows")
    (tmp_path / "ix/other").rename(tmp_path / "bad/clusters")
    with pytest.raises(ValueError, match="rows"):
        load_ivf(spark, str(tmp_path / "bad"))


def test_mini_batches_and_drawn_starts(spark):
    from tessera.operators.ivf import drawn, kmeans

    refs, queries, want = data(spark)
    for options in ({"batch": 300, "start": "drawn"}, {"batch": 10_000}, {"start": "drawn"}):
        a, b = (kmeans(refs, COLS, 6, 4, 7, **options) for _ in range(2))
        assert a.shape[1] == 5 and 1 <= len(a) <= 6 and np.array_equal(a, b)
        assert got(build_ivf(refs, COLS, n_centroids=6, max_cluster=100, iters=3, **options).exact(queries)) == want
    some = drawn(refs, 200, 3)
    assert 100 < some.count() <= 200
    assert drawn(refs, 200, 3).collect() == some.collect()


def test_quantised_index_from_its_files(spark, tmp_path):
    from tessera.operators.ivf import load_ivf_q16
    from tessera.sources.binary import header, lattice, params
    from tessera.tools import ready, write_containers

    refs, queries, _ = data(spark)
    ix = build_ivf(refs, COLS, n_centroids=6, max_cluster=400, iters=3)
    idx, qbin = str(tmp_path / "i.idx"), str(tmp_path / "v.qbin")
    write_containers(ix, idx, qbin)
    h = header(qbin)
    rows = [(r.cluster_id, r.ref_id, r.label, [r[c] for c in COLS]) for r in ix.rows.collect()]
    rows.sort()
    cluster = sorted({r[0] for r in rows})
    centroid = np.array([[r[f"c_{c}"] / 1e4 for c in COLS] for r in sorted(ix.clusters.collect(), key=lambda r: r.cluster_id)], np.float32).astype(float)
    assert params(h["lo"], h["hi"])[1] > 0
    v = lattice(np.array([r[3] for r in rows]) / 1e4, h["lo"], h["hi"]).astype(np.int64)
    at, lab = np.array([cluster.index(r[0]) for r in rows]), np.array([r[2] for r in rows])
    for stop in (False, True):
        q16 = make_index("ivf_q16", None, COLS, clusters_path=idx, vectors_path=qbin, n_probe=4, stop_early=stop)
        assert ready(q16) and q16.name == "IVF_Q16(nProbe=4)"
        out = got(q16.search(queries))
        for q in queries.collect():
            x = np.array([q[c] for c in COLS])
            near = np.argsort(((x / 1e4 - centroid) ** 2).sum(1), kind="stable")[:4]
            d = ((lattice(x / 1e4, h["lo"], h["hi"]).astype(np.int64) - v) ** 2).sum(1)
            for p in range(1, 5):
                found = sorted((int(d[i]), int(i)) for i in np.flatnonzero(np.isin(at, near[:p])))[:5]
                if p == 4 or stop and p >= 2 and len(found) == 5 and len({lab[i] for _, i in found}) == 1:
                    break
            assert out[q.query_id] == found
    for missing in ({"clusters_path": idx}, {"vectors_path": qbin}, {}):
        with pytest.raises(ValueError, match="needs"):
            make_index("IVF_Q16", refs, COLS, **missing)
    with pytest.raises(ValueError, match="dimensions"):
        load_ivf_q16(spark, idx, qbin, COLS[:3])


def test_index_from_settings(spark):
    from tessera.config import Settings
    from tessera.operators.ivf import index_from

    refs, queries, want = data(spark)
    assert got(index_from(Settings(index="BRUTE_FORCE"), refs, COLS).search(queries)) == want
    far = index_from(Settings(index="brute_force", metric="manhattan"), refs, COLS).search(queries)
    assert far.count() == 60 and got(far) != want
    assert got(index_from(Settings(n_centroids=5, max_cluster=200, kmeans_iters=3, kmeans_sample=500), refs, COLS).exact(queries)) == want
    with pytest.raises(ValueError, match="needs"):
        index_from(Settings(index="IVF_Q16"), refs, COLS)
    with pytest.raises(ValueError, match="metric"):
        index_from(Settings(index="BRUTE_FORCE", metric="HAMMING"), refs, COLS)
