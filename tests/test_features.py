import json

import pytest
from pyspark.sql import functions as F

from tessera.config import FEATURES, Settings
from tessera.functions import scalar as S
from tessera.operators.features import parse_requests, vectorize

A = {"id": "a", "transaction": {"amount": 251.2, "installments": 4, "requested_at": "2026-03-14T23:10:59Z"}, "customer": {"avg_amount": 100, "tx_count_24h": 5, "known_merchants": ["M-1", "M-1"]}, "merchant": {"id": "M-9", "mcc": "5411", "avg_amount": 80.255}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 1500}, "last_transaction": {"timestamp": "2026-03-14T20:10:01Z", "km_from_current": 12.34567}}
B = {"id": "b", "transaction": {"amount": 40, "installments": 1, "requested_at": "2026-03-09T09:00:00Z"}, "customer": {"avg_amount": 40, "tx_count_24h": 0, "known_merchants": ["M-2", "M-3"]}, "merchant": {"id": "M-3", "mcc": "5912", "avg_amount": 60.9}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 3.2}, "last_transaction": None}
WANT = {
    "a": [0.0251, 0.3333, 0.2512, 1.0, 0.8333, 0.125, 0.0123, 1.0, 0.25, 1, 0, 1, 0.5, 0.008],
    "b": [0.004, 0.0833, 0.1, 0.3913, 0.0, -1, -1, 0.0032, 0.0, 0, 1, 0, 0.15, 0.0061],
}


def run(spark, *rows):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    good, bad = parse_requests(spark.createDataFrame([(t,) for t in texts], "value string"))
    risk = spark.createDataFrame([("5912", 0.15)], "mcc string, risk double")
    return {r.id: [r[f] for f in FEATURES] for r in vectorize(good, risk).collect()}, [r.raw for r in bad.collect()]


def change(base, path, value):
    out = json.loads(json.dumps(base))
    a, b = path.split(".")
    out[a][b] = value
    return out


def test_worked_examples(spark):
    got, bad = run(spark, A, B)
    assert got == WANT and not bad


@pytest.mark.parametrize(
    ("path", "value", "dim", "want"),
    [("customer.avg_amount", 0, 2, 1.0), ("transaction.amount", -5, 0, 0.0), ("transaction.amount", 1.5, 0, 0.0001), ("last_transaction.timestamp", "2026-03-15T00:00:00Z", 5, 0.0), ("last_transaction.timestamp", "2024-02-28T00:00:00Z", 5, 1.0), ("transaction.requested_at", "2026-03-15T00:00:00Z", 4, 1.0)],
)
def test_edges(spark, path, value, dim, want):
    assert run(spark, change(A, path, value))[0]["a"][dim] == want


def test_rejects(spark):
    broken = {k: v for k, v in A.items() if k != "merchant"}
    got, bad = run(spark, '{"id": ', broken, B)
    assert set(got) == {"b"} and len(bad) == 2


def test_rounding_and_division(spark):
    df = spark.createDataFrame([(1.5e-4,), (float("nan"),), (-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.clamp01(F.col("x"))).collect()] == [1e-4, 0.0, 0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.clamp01(S.ieee_div(F.col("a"), F.col("b")))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_metrics_and_sql(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert df.select(S.metric(" manhattan ")(F.col("a"), F.col("b")), S.metric(None)(F.col("a"), F.col("b")), S.cosine_distance(F.col("a"), F.col("z"))).collect()[0][:] == (7.0, 25.0, 1.0)
    with pytest.raises(ValueError):
        S.metric("other")
    S.register_sql(spark)
    df.createOrReplaceTempView("mv")
    assert spark.sql("select l2sq(a,b), l1(a,b), cosine_dist(a,z), clamp01(1.5e-4), bbox_lb(array(5L, 1L), array(0L, 2L), array(3L, 4L)) from mv").collect()[0][:] == (25.0, 7.0, 1.0, 1e-4, 5)


def test_settings():
    s = Settings.from_env({"TOP_K": "0", "THRESHOLD": "x", "EARLY_STOP": "yes", "IVF_NPROBE": " 7 "})
    assert (s.top_k, s.threshold, s.early_stop, s.n_probe) == (1, 0.6, True, 7)
