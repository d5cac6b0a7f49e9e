import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators.ivf import build_ivf
from tessera.sources import binary, flat, references, sinks

V = [0.0251, 0.3333, 0.2512, 1.0, 0.8333, -1, -1, 1.0, 0.25, 1, 0, 1, 0.5, 0.008]
RECORDS = [{"vector": V, "label": "fraud", "other": {"x": [1]}}, {"label": "legit", "vector": V[::-1]}]


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, RECORDS)))
    (tmp_path / "g.data").write_bytes(gzip.compress(json.dumps(RECORDS).encode()))
    (tmp_path / "h.json.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, RECORDS)).encode()))
    for name in ("a.json", "l.json", "g.data", "h.json.gz"):
        rows = references.load_references(spark, str(tmp_path / name)).orderBy("ref_id").collect()
        assert [r.label for r in rows] == [1, 0] and len(rows[0].v) == 14, name
    (tmp_path / "e.json").write_text("[]")
    assert references.load_references(spark, str(tmp_path / "e.json")).count() == 0


@pytest.mark.parametrize("bad", [{"vector": V[:13], "label": "x"}, {"vector": V + [1], "label": "x"}, {"label": "x"}, {"vector": V}])
def test_bad_records_fail(spark, tmp_path, bad):
    (tmp_path / "b.json").write_text(json.dumps([bad]))
    with pytest.raises(Exception, match="record without"):
        references.read_json(spark, str(tmp_path / "b.json")).collect()


@pytest.mark.parametrize("kind", ["float32", "grid", "affine"])
def test_container_round_trip(spark, tmp_path, kind):
    df = references.synthetic(spark, 500)
    path = str(tmp_path / ("x.qbin" if kind == "affine" else "x.bin"))
    assert binary.write_vectors(df, path, kind) == 500
    back = {r.ref_id: r for r in binary.read_vectors(spark, path, 128).collect()}
    tol = {"float32": 0, "grid": 0.5001e-4, "affine": 1e-5}[kind]
    for r in df.collect():
        assert back[r.ref_id].label == r.label and max(abs(a - b) for a, b in zip(r.v, back[r.ref_id].v, strict=True)) <= tol
    with open(path, "r+b") as f:
        f.truncate(600)
    with pytest.raises(Exception, match="truncated"):
        binary.header(path)


def test_bad_header(tmp_path):
    (tmp_path / "x").write_bytes(b"NOPE" + b"\0" * 28)
    with pytest.raises(ValueError):
        binary.header(str(tmp_path / "x"))


def test_clusters_round_trip_and_layout(spark, tmp_path):
    refs = spark.range(300).select(F.col("id").alias("ref_id"), F.lit(0).alias("label"), (F.col("id") * 7 % 100).cast("int").alias("g0"), (F.col("id") * 3 % 50).cast("int").alias("g1"))
    ix = build_ivf(refs, ["g0", "g1"], n_centroids=4, iters=2)
    p = str(tmp_path / "c.idx")
    binary.write_clusters(ix.clusters, ix.cols, p, 300)
    assert binary.read_clusters(spark, p, 300).agg(F.sum("n")).collect()[0][0] == 300
    with pytest.raises(ValueError):
        binary.read_clusters(spark, p, 299)
    sinks.write_clustered(ix.rows, str(tmp_path / "rows"), 4)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 300


def test_flat_and_synthetic(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"max_km": 500, "extra": "x"}')
    (tmp_path / "r.json").write_text('{"5411": 0.15, "5912": 0.2}')
    assert flat.read_scales(spark, str(tmp_path / "n.json"))["max_km"] == 500.0
    assert flat.read_scales(spark, None)["max_km"] == 1000.0
    assert flat.read_risks(spark, str(tmp_path / "r.json")).count() == 2 and flat.read_risks(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        references.load_references(spark, None)
    s = references.load_references(spark, None, Settings(dev_fallback=True))
    assert s.count() == 10_000 and 0.12 < s.agg(F.avg("label")).collect()[0][0] < 0.18
    assert references.jittered_queries(s, 0.01).count() > 0


def test_reports(spark, tmp_path):
    from tessera.operators.features import GRID_COLUMNS

    row = {"group": "FP", "expected": True, "predicted": False, "fraud_score": 0.6, "neighbors": [1], "raw": "{}", **dict.fromkeys(GRID_COLUMNS, 100)}
    df = spark.createDataFrame([row])
    sinks.write_failures(df, str(tmp_path / "f"))
    sinks.write_summary(df, str(tmp_path / "s"))
    sinks.write_features(df, str(tmp_path / "t"))
    assert json.loads(spark.read.text(str(tmp_path / "f")).collect()[0][0])["vec"][0] == "0.0100"
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s")).where("group = 'FP'").collect()[0]["rate"] == "1.0000"
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 14
    sinks.publish(df, "published")
    assert spark.table("published").count() == 1


def test_stream(spark, tmp_path):
    from tessera.operators.features import to_grid
    from tessera.streaming.score_stream import score_stream
    from tests.test_features import A, B

    cols = [f"g{i}" for i in range(14)]
    refs = spark.range(50).select(F.col("id").alias("ref_id"), F.lit(1).alias("label"), *[(F.col("id") * (i + 3) % 10000).cast("int").alias(c) for i, c in enumerate(cols)])
    ix = build_ivf(refs, cols, n_centroids=3, iters=2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.jsonl").write_text("\n".join([json.dumps(A), json.dumps(B), "{broken"]))
    seen = []
    q = score_stream(spark, str(tmp_path / "in"), ix, lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.id: r.approved for r in seen} == {"a": False, "b": False, None: None}


def test_gzip_comes_in_blocks_of_lines(spark, tmp_path):
    text = "\n".join(f"line {i} {'é' * (i % 50)}" for i in range(3000))
    (tmp_path / "x").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "y").write_bytes(b" [1,\n2]")
    got = [r.value for r in references.gunzip_by_content(spark, str(tmp_path / "x"), block=1000).collect()]
    assert len(got) > 50 and "".join(got) == text and all(x.endswith("\n") for x in got[:-1])
    assert [r.value for r in references.gunzip_by_content(spark, str(tmp_path / "y"), block=3).collect()] == [" [1,\n2]"]


def test_tools_from_file_to_answer(spark, tmp_path, capsys):
    from tessera import tools
    from tessera.config import Settings
    from tessera.operators.features import GRID_COLUMNS
    from tessera.operators.ivf import load_ivf, load_ivf_q16
    from tessera.sources.binary import read_vectors, vector_at

    rng = np.random.default_rng(2)
    v = np.round(rng.random((400, 14)), 4)
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"vector": x.tolist(), "label": "fraud" if i % 6 == 0 else "legit"}) for i, x in enumerate(v)))
    source, s = str(tmp_path / "r.jsonl"), Settings(n_centroids=8, max_cluster=100, kmeans_iters=3, timings=True)
    assert tools.convert_dataset(spark, source, str(tmp_path / "r.bin")) == 400
    assert tools.quantize_dataset(spark, str(tmp_path / "r.bin"), str(tmp_path / "r.qbin")) == 400
    refs = read_vectors(spark, str(tmp_path / "r.bin"))
    assert np.allclose(vector_at(refs, 17), v[17], atol=1e-6) and vector_at(refs, 400) is None
    index = tools.build_index(spark, str(tmp_path / "r.bin"), str(tmp_path / "ix"), s, str(tmp_path / "i.idx"), str(tmp_path / "i.qbin"))
    assert "[perf] build" in capsys.readouterr().out
    assert tools.ready(load_ivf(spark, str(tmp_path / "ix"))) and not tools.ready(None)
    assert tools.warm_up(index, refs, Settings(), 50) > 20
    q16 = load_ivf_q16(spark, str(tmp_path / "i.idx"), str(tmp_path / "i.qbin"), GRID_COLUMNS, 3)
    assert tools.warm_up(q16, refs, Settings(), 50) > 20


def test_numbers_by_partition_and_place(spark):
    from tessera.session import in_order

    df = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("at"))
    assert [(r.line, r.at) for r in in_order(df, "line").orderBy("line").collect()] == [(i, str(i)) for i in range(1000)]


def test_evaluator_uses_the_probing_search(spark, tmp_path):
    from tessera.operators.evaluate import evaluate, read_lines
    from tests.test_features import A, B

    cols = [f"g{i}" for i in range(14)]
    refs = spark.range(50).select(F.col("id").alias("ref_id"), F.lit(1).alias("label"), *[(F.col("id") * (i + 3) % 10000).cast("int").alias(c) for i, c in enumerate(cols)])
    ix = build_ivf(refs, cols, n_centroids=3, iters=2)
    (tmp_path / "in").write_text("\n".join([json.dumps(A), "{broken", "", json.dumps(B), json.dumps(A)]))
    (tmp_path / "out").write_text("true\nfalse\nfalse\n")
    got = evaluate(read_lines(spark, str(tmp_path / "in")), read_lines(spark, str(tmp_path / "out")), ix).orderBy("query_id").collect()
    assert [(r.query_id, r.expected, r.predicted, r.group, len(r.neighbors)) for r in got] == [(0, True, False, "FP", 5), (2, False, False, "TP", 5)]
