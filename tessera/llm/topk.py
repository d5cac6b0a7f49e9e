"""Exact top-k inner products with length ordering, rotation and residual bounds.

Components become the integers floor(256 x). Rows are range-sorted by descending length into parts, queries into blocks; the
Gram matrix of all rows (summed on the executors, dimension by dimension squared in size) gives the rotation that packs inner
products into the first coordinates. A part is skipped for a block of queries, and a run of rows within it for a query, if |q|
times the largest length there can't reach the query's k-th score; within a run, the product over the first rotated
coordinates plus |q rest| |x rest| (Cauchy-Schwarz) rules rows out, and what is left is scored exactly in integers: pair by pair
in slices where little is left, or as one product of matrices where the bound rules out too little to pay. Starting thresholds come from
the bounded set of longest rows.

Queries and rows meet on the executors, one task for a block and a part, both of bounded size; it returns at most k rows a
query. Neither passes through the driver.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of other than the most frequent
length are compared over zero padding; ties go to the smaller vec_id; repeated ids are separate rows and separate queries, and a query excludes
all rows of its own id; a null id takes no part; fewer rows than k give all; an empty table gives no rows; other columns, whatever
their names, aren't looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import map_arrow, stored, trim

SCALE = 256
NONE = np.int64(-(1 << 62))  # below any score
PAIRS = 1 << 16


def integral(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long), norm2 of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    d = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.coalesce(fine, F.lit(False)))
    d = d.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    return d.withColumn("norm2", F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def matrix(arr, dim: int) -> np.ndarray:
    """(rows, dim) int64 of a list column, zero-padded."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(arr.offsets.to_numpy())
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def gram(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products over all rows: one flat row per task, added up by cell."""

    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            m = matrix(b.column(0), dim).astype(np.float64)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(g.ravel())], ["i", "x"])

    out = np.zeros(dim * dim)
    for r in map_arrow(rows.select("v"), run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(dim, dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All exact inner products: by floating point where no sum can leave its integers."""
    if len(q) and len(x) and q.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max()) < 2.0**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def thresholds(qid: np.ndarray, q: np.ndarray, tid: np.ndarray, tv: np.ndarray, k: int, rows: int = 1024) -> np.ndarray:
    """Each query's k-th best score among the rows (tid, tv), or NONE where there are fewer."""
    out = np.full(len(q), NONE)
    for a in range(0, len(q) if len(tid) >= k else 0, rows):
        s = products(q[a : a + rows], tv)
        s[qid[a : a + rows, None] == tid[None, :]] = NONE
        out[a : a + rows] = np.partition(s, len(tid) - k, axis=1)[:, -k]
    return out


def search(qid: np.ndarray, q: np.ndarray, low: np.ndarray, ids: np.ndarray, v: np.ndarray, rot: np.ndarray, head: int, k: int, run: int = 512, dense: float = 0.05) -> tuple[np.ndarray, ...]:
    """(query's place, row id, score) of the best k rows (ids, v) a query, or fewer where no row reaches ``low``."""
    low = low.copy()
    below = np.nextafter(low.astype(float), -np.inf)
    norm = lambda m: np.sqrt((m.astype(float) ** 2).sum(1))
    qn, qr = norm(q), q.astype(float) @ rot
    q_head, q_rest = qr[:, :head], norm(qr[:, head:])
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    vn = norm(v)
    o = np.lexsort((ids, -vn))
    for a in range(0, len(o), run):
        w = o[a : a + run]
        slack = 1e-6 * (1 + qn * vn[w[0]])
        live = np.flatnonzero(qn * vn[w[0]] + slack >= below)
        if not len(live):
            break  # shorter rows follow
        x, xi = v[w], ids[w]
        xr = x.astype(float) @ rot
        bound = q_head[live] @ xr[:, :head].T + np.outer(q_rest[live], norm(xr[:, head:])) + slack[live][:, None]
        open_ = bound >= below[live][:, None]
        if open_.mean() > dense:
            s = products(q[live], x)
            r, c = np.nonzero(open_ & (s >= low[live][:, None]))
            exact = s[r, c]
        else:
            r, c = np.nonzero(open_)
            exact = np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", q[live[r[z : z + PAIRS]]], x[c[z : z + PAIRS]]) for z in range(0, len(r), PAIRS)]])
        ok = (exact >= low[live][r]) & (xi[c] != qid[live][r])
        new = live[r[ok]], xi[c[ok]], exact[ok]
        if not len(new[0]):
            continue
        best = tuple(np.concatenate(z) for z in zip(best, new, strict=True))
        by = np.lexsort((best[1], -best[2], best[0]))
        best = tuple(z[by] for z in best)
        nth = np.arange(len(by)) - np.searchsorted(best[0], best[0], side="left")
        full = nth == k - 1
        low[best[0][full]] = np.maximum(low[best[0][full]], best[2][full])
        below = np.nextafter(low.astype(float), -np.inf)
        best = tuple(z[nth < k] for z in best)
    return best


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, query_block: int = 4096, longest: int = 4096, part_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``, against all rows but its own."""
    spark = vectors.sparkSession
    rows = stored(integral(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()[0]
    if not facts.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = facts.dim
    values, axes = np.linalg.eigh(gram(rows, dim))
    rot = axes[:, np.argsort(-values)]
    head = max(1, min(dim, dim // 4))
    top = rows.orderBy(F.desc("norm2"), "vec_id").select("vec_id", "v").limit(longest).toArrow()
    tid, tv = top.column(0).to_numpy(), matrix(top.column(1), dim)
    by = [F.desc("norm2"), F.col("vec_id"), F.col("row")]  # many rows alike still fall into many parts
    ranged = lambda d, size, n: stored(d.repartitionByRange(max(1, -(-n // size)), *by).withColumn("part", F.spark_partition_id()), "vectors-by-length")
    refs = ranged(rows, part_rows, facts.n)
    b = spark.sparkContext.broadcast((tid, tv))  # at most ``longest`` rows

    def floors(batches):
        tid, tv = b.value
        for x in batches:
            low = thresholds(x.column(1).to_numpy(), matrix(x.column(2), dim), tid, tv, k)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(low)], ["q", "query_id", "v", "norm2", "block", "low"])

    queries = ranged(rows.where(F.col("vec_id") % every == 0), query_block, facts.q).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", "norm2", F.col("part").alias("block"))
    queries = stored(map_arrow(queries, floors, "q long, query_id long, v array<long>, norm2 double, block int, low long"), "queries")
    # the parts that a block can't do without, by lengths alone
    parts = refs.groupBy("part").agg(F.sqrt(F.max("norm2")).alias("most"))
    blocks = queries.groupBy("block").agg(F.sqrt(F.max("norm2")).alias("long"), F.min("low").alias("least"))
    n_parts = max(1, -(-facts.n // part_rows))
    pairs = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("p")).join(parts, F.col("p") == F.col("part"))
    pairs = stored(pairs.where(F.col("long") * F.col("most") * (1 + 1e-6) + 1 >= F.col("least")).select(F.col("block").alias("b"), "p"), "block-parts")
    left = queries.join(pairs, F.col("block") == F.col("b")).select("b", "p", "q", "query_id", "v", "low")
    right = refs.join(pairs, F.col("part") == F.col("p")).select(F.col("b").alias("rb"), F.col("p").alias("rp"), "vec_id", "v")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"q": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        qid = x["query_id"].to_numpy()
        r, i, s = search(qid, matrix(x["v"], dim), x["low"].to_numpy(), y["vec_id"].to_numpy(), matrix(y["v"], dim), rot, head, k)
        trim()
        return pa.table({"q": pa.array(x["q"].to_numpy()[r]), "query_id": pa.array(qid[r]), "vec_id": pa.array(i), "score": pa.array(s)})

    found = left.groupBy("b", "p").cogroup(right.groupBy("rb", "rp")).applyInArrow(meet, "q long, query_id long, vec_id long, score long")
    w = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(vectors: DataFrame, **options) -> DataFrame:
    return top_products(vectors, **options)
