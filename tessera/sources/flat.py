"""Small flat JSON objects: scales and category risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT_SCALES


def flat_object(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) rows of a flat JSON object file, values as text."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_scales(spark: SparkSession, path: str | None) -> dict[str, float]:
    """The seven scales; a missing file or key falls back to its default."""
    if not path:
        return dict(DEFAULT_SCALES)
    got = {r.key: float(r.value) for r in flat_object(spark, path).where(F.col("key").isin(list(DEFAULT_SCALES))).collect()}
    return {**DEFAULT_SCALES, **got}


def read_risks(spark: SparkSession, path: str | None) -> DataFrame:
    """(mcc, risk); empty without a file, so that every code has the default risk."""
    if not path:
        return spark.createDataFrame([], "mcc string, risk double")
    return flat_object(spark, path).select(F.col("key").alias("mcc"), F.col("value").cast("double").alias("risk"))
