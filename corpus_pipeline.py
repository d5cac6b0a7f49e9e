"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, minhash, mixing, packing, secrets
from tessera.session import stored, table

STAGES = [
    ("language", lambda spark, docs, sf_dir: langid.stage(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: minhash.stage(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.stage(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.stage(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.stage(docs)),
]

#: Trained models, hashing and packing can't be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
