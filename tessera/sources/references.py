"""Labelled reference vectors: JSON array, JSON lines, gzip told by content, Parquet, synthetic."""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.session import in_order, map_arrow
from tessera.sources.binary import read_vectors

DIM = 14
RECORD = "vector array<double>, label string"


def validate(raw: DataFrame, dim: int = DIM) -> DataFrame:
    """Both keys required and exactly ``dim`` numbers, else the job fails; any label but 'fraud' is legitimate (0).
    Elements are narrowed to float32."""
    ok = F.col("vector").isNotNull() & F.col("label").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())
    checked = raw.select("vector", "label", F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(f"record without {dim} numbers and a label")).alias("_ok"))
    # assert_true yields null on success, so the filter keeps every row and can't be pruned away
    return checked.where(F.col("_ok").isNull()).select(F.col("vector").cast("array<float>").alias("v"), F.when(F.col("label") == "fraud", 1).otherwise(0).alias("label"))


def numbered(df: DataFrame) -> DataFrame:
    """Consecutive ref_id by file order: the position in the input."""
    return in_order(df, "ref_id")


def gunzip_by_content(spark: SparkSession, path: str, block: int = 4 << 20) -> DataFrame:
    """Text of files that may be gzip whatever their name; a plain file passes through. A JSON array comes as one text, anything
    else in blocks of whole lines, about ``block`` bytes each, so that only one is held unpacked at a time."""

    def pieces(content: bytes):
        if content[:2] != b"\x1f\x8b":
            yield from (content[a : a + block] for a in range(0, len(content), block))
            return
        with gzip.open(io.BytesIO(content)) as f:
            while piece := f.read(block):
                yield piece

    def lines(batches):
        for b in batches:
            for content in b.column(0):
                held, array = b"", None
                for piece in pieces(content.as_buffer().to_pybytes()):
                    held += piece
                    if array is None and held.strip():
                        array = held.lstrip()[:1] == b"["
                    end = held.rfind(b"\n") + 1
                    if array is False and end:
                        yield pa.RecordBatch.from_arrays([pa.array([held[:end].decode("utf-8")])], ["value"])
                        held = held[end:]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([held.decode("utf-8")])], ["value"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), lines, "value string")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array or one object per line, told by the first character that isn't white space. Unknown keys are skipped."""
    if spark.read.format("binaryFile").load(path).where(F.expr("hex(substring(content, 1, 2))") == "1F8B").where(~F.col("path").endswith(".gz")).limit(1).count():
        text = gunzip_by_content(spark, path)
        items = text.withColumn("a", F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{'vector:array<double>,label:string'}>>")))
        whole = items.where(F.col("a").isNotNull()).select(F.explode("a").alias("r"))
        each = items.where(F.col("a").isNull()).select(F.explode(F.split("value", "\n")).alias("l")).where(F.trim("l") != "").select(F.from_json("l", RECORD).alias("r"))
        return validate(whole.unionByName(each).select("r.vector", "r.label"))
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return validate(spark.read.schema(RECORD).option("multiLine", array).json(path))


def synthetic(spark: SparkSession, n: int, seed: int = 42, dim: int = DIM, fraud: float = 0.15) -> DataFrame:
    """n uniform vectors, each labelled 1 with probability ``fraud``; the same for the same seed."""
    return spark.range(n).select(F.col("id").alias("ref_id"), F.array(*[F.rand(seed + d).cast("float") for d in range(dim)]).alias("v"), F.when(F.rand(seed + dim) < fraud, 1).otherwise(0).alias("label"))


def load_references(spark: SparkSession, path: str | None, settings: Settings | None = None) -> DataFrame:
    """By the path's ending: binary container, Parquet or JSON; without a path, synthetic data if allowed, else an error."""
    if path and path.endswith((".bin", ".qbin")):
        return read_vectors(spark, path)
    if path and path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path:
        return numbered(read_json(spark, path))
    if settings and settings.dev_fallback:
        return synthetic(spark, 10_000, settings.seed)
    raise FileNotFoundError("no reference data given and synthetic data not allowed")


def jittered_queries(refs: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Warm-up queries: rows drawn with replacement, each element moved by up to 0.005."""
    s = refs.sample(True, fraction, seed)
    return s.select(F.monotonically_increasing_id().alias("query_id"), F.transform("v", lambda x: x.cast("double") + (F.rand(seed) - 0.5) * 0.01).alias("qv"))
