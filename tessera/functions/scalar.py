"""Scalar expressions, all JVM-side: clamping, rounding, quantisation, distances and date parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.config import GRID


def half_up(y: Column) -> Column:
    """Round half up, exact also just below one half."""
    return F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)


def clamp(x: Column) -> Column:
    """To [0, 1]; NaN and null become 0."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).when(x > 1, 1.0).otherwise(x)


def quantize4(x: Column) -> Column:
    return half_up(x * F.lit(1e4)) / F.lit(1e4)


def clamp01(x: Column) -> Column:
    """Clamp to [0, 1], then round half up to four decimals; NaN and null become 0."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).when(x > 1, 1.0).otherwise(quantize4(x))


def ieee_div(a: Column, b: Column) -> Column:
    """Division that yields infinities and NaN instead of an error."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def grid(x: Column) -> Column:
    """A value on the 1/10000 integer grid."""
    return half_up(x * F.lit(float(GRID))).cast("smallint")


def grid_array(v: Column) -> Column:
    return F.transform(v, lambda x: grid(x.cast("double")))


def ungrid(v: Column) -> Column:
    return v / F.lit(float(GRID))


def affine_params(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Centre and step of the 16-bit lattice spanning [lo, hi]; step 1 where the range is empty."""
    return (hi + lo) / 2.0, F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo) / 65534.0)


def affine_quantize(x: Column, centre: Column, step: Column) -> Column:
    return F.least(F.greatest(half_up((x - centre) / step), F.lit(-32767)), F.lit(32767)).cast("int")


def affine_dequantize(q: Column, centre: Column, step: Column) -> Column:
    return q * step + centre


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, folded left to right."""
    return _fold(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def l1(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 where either vector has no length."""
    dot = _fold(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))
    na, nb = (_fold(F.transform(v, lambda x: _d(x) * _d(x))) for v in (a, b))
    return F.when((na == 0) | (nb == 0), 1.0).otherwise(1.0 - dot / (F.sqrt(na) * F.sqrt(nb)))


def grid_l2(a: list[Column], b: list[Column]) -> Column:
    """Integer squared distance over unrolled columns (whole-stage code); 64-bit throughout."""
    return _total([(x.cast("bigint") - y.cast("bigint")) * (x.cast("bigint") - y.cast("bigint")) for x, y in zip(a, b, strict=True)])


def box_bound(q: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Integer lower bound on the squared distance from a point to anything inside a box."""
    gaps = [F.greatest(a.cast("bigint") - x.cast("bigint"), x.cast("bigint") - b.cast("bigint"), F.lit(0)) for x, a, b in zip(q, lo, hi, strict=True)]
    return _total([g * g for g in gaps])


METRICS = {"EUCLIDEAN": l2sq, "EUCLIDEAN_SIMD": l2sq, "MANHATTAN": l1, "COSINE": cosine_distance}


def metric(name: str | None):
    """By name: trimmed, any case, none means Euclidean; an unknown name is an error."""
    key = (name or "EUCLIDEAN").strip().upper()
    if key not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[key]


def wall_minute(s: Column) -> Column:
    """The first 16 characters (date, hour, minute) as a zoneless timestamp; seconds and offsets play no part."""
    return F.to_timestamp_ntz(F.substring(s, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm"))


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MINUTE", F.date_trunc("MINUTE", earlier), F.date_trunc("MINUTE", later))


def register_sql(spark: SparkSession) -> None:
    """The metrics and the clamp as SQL functions that the optimizer inlines."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION clamp01(x DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN x IS NULL OR isnan(x) OR x < 0 THEN 0e0 WHEN x > 1 THEN 1e0
        ELSE (floor(x*1e4) + CASE WHEN x*1e4 - floor(x*1e4) >= 0.5e0 THEN 1 ELSE 0 END) / 1e4 END""")
    arrays = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2sq{arrays} aggregate(zip_with(a, b, (x, y) -> (x-y)*(x-y)), 0e0, (s, x) -> s + x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l1{arrays} aggregate(zip_with(a, b, (x, y) -> abs(x-y)), 0e0, (s, x) -> s + x)")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine_dist{arrays}
        CASE WHEN aggregate(a, 0e0, (s, x) -> s + x*x) = 0 OR aggregate(b, 0e0, (s, x) -> s + x*x) = 0 THEN 1e0 ELSE
        1e0 - aggregate(zip_with(a, b, (x, y) -> x*y), 0e0, (s, x) -> s + x)
        / (sqrt(aggregate(a, 0e0, (s, x) -> s + x*x)) * sqrt(aggregate(b, 0e0, (s, x) -> s + x*x))) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION bbox_lb(q ARRAY<BIGINT>, lo ARRAY<BIGINT>, hi ARRAY<BIGINT>) RETURNS BIGINT RETURN
        aggregate(transform(q, (x, i) -> greatest(lo[i] - x, x - hi[i], 0L) * greatest(lo[i] - x, x - hi[i], 0L)), 0L, (s, x) -> s + x)""")
