"""Connected components by alternating large and small stars over tables; no links or labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs to (id, component), one row per id that has a link, with the smallest id reachable. Each
    round is written to the shared folder in place of the one before; the loop ends when a round changes nothing. The result
    reads the last round's table."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = stored(e, "star"), None
    while True:
        got = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).collect()[0]
        if tuple(got) == last or not got[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        last = tuple(got)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        j = large.join(small, large.a == small.u)
        new = stored(j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "star")
        discard(e)
        e = new
