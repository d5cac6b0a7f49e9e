"""Sinks: Parquet by cluster, JSON lines of failures, tab-separated reports, session views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import FEATURES
from tessera.operators.evaluate import confusion, failures, feature_stats_wide
from tessera.operators.features import GRID_COLUMNS


def write_clustered(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Rows laid out by cluster: a cluster is contiguous in a file, so row-group statistics prune probes."""
    rows.repartitionByRange(buckets, "cluster_id", "ref_id").sortWithinPartitions("cluster_id", "ref_id").write.mode("overwrite").parquet(path)


def write_failures(evaluated: DataFrame, path: str) -> None:
    vec = F.array(*[F.format_string("%.4f", F.col(g) / 1e4) for g in GRID_COLUMNS])
    failures(evaluated).select(F.col("group").alias("type"), "expected", "predicted", F.col("fraud_score").alias("score"), vec.alias("vec"), "neighbors", "raw").write.mode("overwrite").json(path)


def _tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_summary(evaluated: DataFrame, path: str) -> None:
    _tsv(confusion(evaluated).select("group", F.col("n").alias("count"), F.format_string("%.4f", "rate").alias("rate")), path)


def write_features(evaluated: DataFrame, path: str) -> None:
    _tsv(feature_stats_wide(evaluated, GRID_COLUMNS, list(FEATURES)).orderBy("dim"), path)


def publish(df: DataFrame, name: str) -> DataFrame:
    """Swap the view readers see; queries already planned keep the old one."""
    df.createOrReplaceTempView(name)
    return df
