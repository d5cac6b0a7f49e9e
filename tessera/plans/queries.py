"""Registered queries over the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import FEATURES
from tessera.functions import scalar as S
from tessera.operators import evaluate as ev
from tessera.operators import ivf as iv
from tessera.operators.features import GRID_COLUMNS as G
from tessera.operators.features import parse_requests, vectorize
from tessera.operators.knn import knn_grid, knn_join, matrix
from tessera.operators.quantize import quantize
from tessera.operators.score import decide, fraud_count, respond
from tessera.plans.adapter import SCALES, featured, gridded, risk_table, split, transactions
from tessera.session import at_exit, in_order, shared_dir, stored, table

E_DIM = 64
E_COLS = [f"e{i}" for i in range(E_DIM)]


def _emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def _emb_grid(spark, d) -> DataFrame:
    """Embeddings on the integer grid, unrolled."""
    return _emb(spark, d).select("vec_id", F.coalesce("label", F.lit(0)).alias("label"), *[S.grid(F.element_at("embedding", i + 1).cast("double")).alias(c) for i, c in enumerate(E_COLS)])


def _near(spark, d, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, r = split(stored(gridded(spark, d), "grid"))
    return q, r, knn_grid(q, r, G, k)


def flagship_score(spark: SparkSession, d: str) -> DataFrame:
    _, _, near = _near(spark, d)
    return decide(fraud_count(near)).select("query_id", "fraud_count", "dist_sum", "fraud_score", "approved")


def features_vector(spark, d):
    return featured(spark, d).select("event_id", *FEATURES)


def clamp01_edges(spark, d):
    x = S.ieee_div(F.col("l_extendedprice") - 20000.0, F.col("l_quantity") - 25.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clamp01(x / 5000.0).alias("ratio"), S.clamp01(F.col("l_discount") / 3.0).alias("third"), S.clamp(F.col("l_quantity") / 30.0).alias("plain"))


def date_features(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("p"))
    at = S.wall_minute(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.hour(at).alias("hh"), F.minute(at).alias("mi"), F.weekday(at).alias("dow"), F.dayofmonth(at).alias("dd"), F.month(at).alias("mm"), F.year(at).alias("yy"), S.minutes_between(F.col("ts"), F.col("p")).alias("gap"))


def json_parse(spark, d):
    """Payloads written as JSON text, parsed back and vectorized."""
    t = transactions(spark, d)
    js = t.select(F.to_json(F.struct(*[c for c in t.columns if c not in ("event_id", "label")])).alias("value"))
    good, _ = parse_requests(js)
    return vectorize(good, risk_table(spark), SCALES).select(F.col("id").cast("bigint").alias("event_id"), *FEATURES)


def mcc_lookup(spark, d):
    return featured(spark, d).groupBy(F.col("merchant.mcc").alias("mcc")).agg(F.max("mcc_risk").alias("risk"), F.count(F.lit(1)).alias("n"))


def known_merchant(spark, d):
    return featured(spark, d).groupBy(F.col("customer.avg_amount").isNull().alias("no_customer"), F.col("unknown_merchant").cast("int").alias("unknown")).agg(F.count(F.lit(1)).alias("n"))


def grid_quantize(spark, d):
    q = F.posexplode(S.grid_array(F.col("embedding"))).alias("dim", "q")
    return _emb(spark, d).select("vec_id", q).select("vec_id", "dim", F.col("q").cast("int").alias("q"), S.ungrid(F.col("q").cast("double")).alias("back"))


def affine_quantize(spark, d):
    out = quantize(_emb(spark, d).select("vec_id", F.col("embedding").alias("v")))
    return out.select("vec_id", F.posexplode(F.arrays_zip("q", "back")).alias("dim", "x")).select("vec_id", "dim", "x.q", "x.back")


def _knn(name: str):
    def run(spark, d):
        e = _emb(spark, d)
        q = e.where(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
        r = e.where(F.col("vec_id") % 25 != 0).select(F.col("vec_id").alias("ref_id"), "label", F.col("embedding").alias("v"))
        return knn_join(q, r, 5, name).select("query_id", "ref_id", "label", "dist", "rank")

    return run


def knn_grid_events(spark, d):
    return _near(spark, d)[2].select("query_id", "ref_id", "label", "dist", "rank")


def _start_centroids(spark, d, n: int = 10) -> DataFrame:
    g = _emb_grid(spark, d)
    first = g.orderBy("vec_id").limit(n)
    return first.select((F.row_number().over(W.orderBy("vec_id")) - 1).alias("cluster_id"), *[F.col(c).alias(f"c_{c}") for c in E_COLS])


def _assigned(spark, d) -> DataFrame:
    """Each row's nearest starting centroid and the integer distance, found where the row is."""
    c = _start_centroids(spark, d).orderBy("cluster_id").toArrow()  # ten rows
    return iv.assign(_emb_grid(spark, d), E_COLS, matrix([c[f"c_{x}"] for x in E_COLS]), dist="dist")


def centroid_assign(spark, d):
    return _assigned(spark, d).select("vec_id", "cluster_id", "dist")


def _per_cluster(spark, d) -> DataFrame:
    long = _assigned(spark, d).select("cluster_id", F.posexplode(F.array(*[F.col(c).cast("bigint") for c in E_COLS])).alias("dim", "x"))
    return long.groupBy("cluster_id", "dim").agg((F.sum("x") / F.count(F.lit(1))).alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))


def kmeans_step(spark, d):
    return _per_cluster(spark, d).select("cluster_id", "dim", "mean", "n")


def cluster_bbox(spark, d):
    return _per_cluster(spark, d).select("cluster_id", "dim", "lo", "hi")


def cluster_sizes(spark, d):
    n = _assigned(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def row_in_cluster(spark, d):
    return _assigned(spark, d).select("vec_id", "cluster_id", (F.row_number().over(W.partitionBy("cluster_id").orderBy("vec_id")) - 1).alias("pos"))


def bbox_lower_bound(spark, d):
    a = _assigned(spark, d)
    box = a.groupBy("cluster_id").agg(*[F.min(c).alias(f"lo_{c}") for c in E_COLS], *[F.max(c).alias(f"hi_{c}") for c in E_COLS])
    q = _emb_grid(spark, d).where(F.col("vec_id") % 25 == 0)
    lb = S.box_bound([F.col(c) for c in E_COLS], [F.col(f"lo_{c}") for c in E_COLS], [F.col(f"hi_{c}") for c in E_COLS])
    return q.crossJoin(F.broadcast(box)).select(F.col("vec_id").alias("query_id"), "cluster_id", lb.alias("lb"))


def _emb_index(spark, d) -> tuple[iv.Ivf, DataFrame]:
    a = stored(_assigned(spark, d), "assigned")
    rows = a.where(F.col("vec_id") % 25 != 0).withColumnRenamed("vec_id", "ref_id").drop("dist")
    q = a.where(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"), *E_COLS)
    return iv.Ivf(rows, stored(iv.cluster_table(rows, E_COLS), "clusters"), E_COLS, 2), q


def ivf_probe(spark, d):
    """Two nearest clusters by integer centroids (the starting ones, so that no rounding decides)."""
    q, c = _emb_grid(spark, d).where(F.col("vec_id") % 25 == 0).withColumnRenamed("vec_id", "query_id"), _start_centroids(spark, d)
    return iv.Ivf(q, c, E_COLS, 2).probes(q)


def unprobed_clusters(spark, d):
    q, c = _emb_grid(spark, d).where(F.col("vec_id") % 25 == 0).withColumnRenamed("vec_id", "query_id"), _start_centroids(spark, d)
    return iv.Ivf(q, c, E_COLS, 2).unprobed(q)


def ivf_search(spark, d):
    """Probe and scan on the starting centroids."""
    ix, q = _emb_index(spark, d)
    return iv.Ivf(ix.rows, _start_centroids(spark, d), E_COLS, 2).search(q).select("query_id", "ref_id", "label", "dist", "rank")


def early_stop_unanimous(spark, d):
    ix, q = _emb_index(spark, d)
    return iv.Ivf(ix.rows, _start_centroids(spark, d), E_COLS, 4).early_stop(q).select("query_id", "ref_id", "label", "dist", "rank")


_built: dict[tuple[str, str], str] = {}


def _index(spark, d) -> tuple[iv.Ivf, DataFrame]:
    """The events' index and its queries, built and saved once an application, then loaded."""
    key = spark.sparkContext.applicationId, d
    if key not in _built:
        q, r = split(stored(gridded(spark, d), "grid"))
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        iv.build_ivf(r, G, n_centroids=64, iters=4).save(path)
        q.write.parquet(f"{path}/queries")
        at_exit(spark, path)
        _built[key] = path
    return iv.load_ivf(spark, _built[key]), spark.read.parquet(f"{_built[key]}/queries")


def ivf_exact(spark, d):
    ix, q = _index(spark, d)
    return ix.exact(q).select("query_id", "ref_id", "label", "dist", "rank")


def kmeans_build(spark, d):
    """Built clusters: sizes and exclusive starts."""
    return _index(spark, d)[0].clusters.select("cluster_id", "n", "start")


def kmeans_rounds(spark, d):
    """Two rounds over all rows from the first ten, centroids rounded to the grid."""
    start = matrix(_start_centroids(spark, d).orderBy("cluster_id").select(*[f"c_{c}" for c in E_COLS]).toArrow().columns)
    c = iv.kmeans(_emb_grid(spark, d), E_COLS, 10, 2, start=start, whole=True)
    rows = [(i, j, int(x)) for i, v in enumerate(c) for j, x in enumerate(v)]
    return spark.createDataFrame(rows, "cluster_id int, dim int, value long")


def _q16(spark, d, stop_early: bool) -> DataFrame:
    """Clusters around the first ten rows, written as the two containers and read back as the quantised index."""
    from tessera.tools import write_containers

    ix, q = _emb_index(spark, d)
    folder = f"{shared_dir(spark).removeprefix('file:').replace('//', '/')}/q16-{uuid.uuid4().hex}"
    os.makedirs(folder)
    at_exit(spark, folder)
    write_containers(ix, f"{folder}/rows.idx", f"{folder}/rows.qbin")
    q16 = iv.load_ivf_q16(spark, f"{folder}/rows.idx", f"{folder}/rows.qbin", E_COLS, 4, stop_early)
    ids = in_order(ix.rows.orderBy("cluster_id", "ref_id").select(F.col("ref_id").alias("vec_id")), "ref_id")
    # the container numbers rows by cluster and id
    return q16.search(q).join(ids, "ref_id").select("query_id", F.col("vec_id").alias("ref_id"), "label", "dist", "rank")


def ivf_q16(spark, d):
    return _q16(spark, d, False)


def ivf_q16_early(spark, d):
    return _q16(spark, d, True)


def fraud_counts(spark, d):
    return fraud_count(_near(spark, d)[2]).select("query_id", "fraud_count", "unanimous")


def decision(spark, d):
    return decide(fraud_count(_near(spark, d)[2])).select("query_id", "fraud_score", "approved")


def response_json(spark, d):
    return respond(decide(fraud_count(_near(spark, d)[2]))).select("query_id", "response")


def _evaluated(spark, d) -> DataFrame:
    q, r = split(stored(gridded(spark, d), "grid"))
    s = decide(fraud_count(knn_grid(q, r, G)))
    j = q.join(s, "query_id").withColumnRenamed("approved", "predicted").withColumn("expected", F.col("expected_label") == 0)
    return j.withColumn("group", ev.group_of(F.col("predicted"), F.col("expected")))


def confusion(spark, d):
    return ev.confusion(_evaluated(spark, d))


def feature_stats(spark, d):
    return ev.feature_stats(_evaluated(spark, d), G)


def failures(spark, d):
    return ev.failures(_evaluated(spark, d)).select("query_id", "group", "expected", "predicted", "fraud_score")


def zip_eval(spark, d):
    """Decisions against a shorter list of expectations, matched by line position."""
    lab = table(spark, d, "labels").orderBy("doc_id")
    left = lab.select(F.col("doc_id").cast("string").alias("value"))
    right = lab.where(F.col("doc_id").isNotNull()).orderBy(F.desc("doc_id")).select(F.when(F.col("quality") == 1, "true").otherwise("false").alias("value"))
    return ev.zip_lines(left, right).select("line", "value", "expected")


def synthetic_vectors(spark, d):
    from tessera.sources.references import synthetic

    return synthetic(spark, 1000).select("ref_id", "label", F.size("v").alias("dim"), (F.array_min("v") >= 0).alias("low_ok"), (F.array_max("v") < 1).alias("high_ok"))


def score_requests(spark, d):
    """JSON request text through parsing, exact clustered search and response, as the streaming entry does per batch."""
    from tessera.config import Settings
    from tessera.streaming.score_stream import score_batch

    t = transactions(spark, d).where(F.col("event_id") % 200 == 0)
    js = t.select(F.to_json(F.struct(*[c for c in t.columns if c not in ("event_id", "label")])).alias("value"))
    index, _ = _index(spark, d)
    s = Settings(scales={**Settings().scales, **SCALES})
    return score_batch(js, index, risk_table(spark), s).select(F.col("id").cast("bigint").alias("query_id"), "fraud_score", "approved", "response")


QUERIES = {
    "flagship_score": flagship_score, "features_vector": features_vector, "clamp01_edges": clamp01_edges, "date_features": date_features, "json_parse": json_parse,
    "mcc_lookup": mcc_lookup, "known_merchant": known_merchant, "grid_quantize": grid_quantize, "affine_quantize": affine_quantize, "dist_l2": _knn("EUCLIDEAN"),
    "dist_l1": _knn("MANHATTAN"), "dist_cosine": _knn("COSINE"), "knn_exact": _knn("EUCLIDEAN_SIMD"), "knn_grid": knn_grid_events, "centroid_assign": centroid_assign,
    "kmeans_step": kmeans_step, "cluster_bbox": cluster_bbox, "cluster_sizes": cluster_sizes, "row_in_cluster": row_in_cluster, "bbox_lower_bound": bbox_lower_bound,
    "ivf_probe": ivf_probe, "unprobed_clusters": unprobed_clusters, "ivf_search": ivf_search, "early_stop_unanimous": early_stop_unanimous, "ivf_exact": ivf_exact,
    "kmeans_build": kmeans_build, "kmeans_rounds": kmeans_rounds, "ivf_q16": ivf_q16, "ivf_q16_early": ivf_q16_early, "fraud_count": fraud_counts, "decision": decision, "response_json": response_json, "confusion": confusion, "feature_stats": feature_stats,
    "failures": failures, "zip_eval": zip_eval, "synthetic_vectors": synthetic_vectors, "score_requests": score_requests,
}
