"""Exact k nearest neighbours by any metric.

Queries and references meet in blocks: numpy computes a block's distances, keeps k per query, and a window merges what the
tasks return; what is shuffled is k rows per query and task, never the pairs. Up to ``block`` queries (their number is
checked) are broadcast to the partitions of the references, which stay where they are. More are cut into blocks, the references into parts
of bounded size, and each block meets each part in a task of its own; no query passes through the driver then.

Distances are folded dimension by dimension from the left, so they equal the expressions in ``functions.scalar`` bit by bit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import metric
from tessera.session import importable, map_arrow, stored

CELLS = 1 << 22  # distances that a task holds at once
NO_LABEL = np.iinfo(np.int64).min


def _fold(q: np.ndarray, v: np.ndarray, term: Callable) -> np.ndarray:
    acc = np.zeros((len(q), len(v)))
    for i in range(q.shape[1]):
        acc += term(q[:, i, None], v[None, :, i])
    return acc


def squared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _fold(q, v, lambda a, b: (a - b) * (a - b))


def manhattan(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _fold(q, v, lambda a, b: np.abs(a - b))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    one = np.zeros((1, q.shape[1]))
    nq, nv = _fold(q, one, lambda a, b: a * a), _fold(one, v, lambda a, b: b * b)
    dot = _fold(q, v, lambda a, b: a * b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((nq == 0) | (nv == 0), 1.0, 1.0 - dot / (np.sqrt(nq) * np.sqrt(nv)))


def grid(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of grid integers (|x| <= 32767, so float64 products are exact)."""
    return (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (q @ v.T)


KERNELS = {"EUCLIDEAN": squared, "EUCLIDEAN_SIMD": squared, "MANHATTAN": manhattan, "COSINE": cosine}


def kernel(name: str | None) -> Callable:
    metric(name)  # an unknown name is an error
    return KERNELS[(name or "EUCLIDEAN").strip().upper()]


def best_per_query(df: DataFrame, k: int, order: list, by: str = "query_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def top_rows(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of each row's k smallest, ties by id, in order."""
    if dist.shape[1] > k:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(dist <= kth)
    else:
        r, c = (x.ravel() for x in np.indices(dist.shape))
    o = np.lexsort((ids[c], dist[r, c], r))
    r, c = r[o], c[o]
    start = np.searchsorted(r, r, side="left")
    keep = np.arange(len(r)) - start < k
    return r[keep], c[keep]


class Best:
    """The k nearest so far of each query: places, distances, ids and labels, in order."""

    def __init__(self, k: int):
        self.k, self.rows = k, None

    def add(self, place: np.ndarray, dist: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        new = (place, dist, ids, labels)
        if self.rows is not None:
            new = tuple(np.concatenate(x) for x in zip(self.rows, new, strict=True))
            o = np.lexsort((new[2], new[1], new[0]))
            new = tuple(x[o] for x in new)
            keep = np.arange(len(o)) - np.searchsorted(new[0], new[0], side="left") < self.k
            new = tuple(x[keep] for x in new)
        self.rows = new

    def scan(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, distances: Callable, places: np.ndarray | None = None) -> None:
        """Holds the queries (or those at ``places``) against rows, CELLS distances at a time."""
        if places is not None:
            q = q[places]
        if not len(q):
            return
        step = max(1, CELLS // len(q))
        for at in range(0, len(ids), step):
            s = slice(at, at + step)
            d = distances(q, v[s])
            r, c = top_rows(d, ids[s], self.k)
            self.add(r if places is None else places[r], d[r, c], ids[s][c], labels[s][c])

    def batches(self, query_ids: np.ndarray, kind: str):
        if self.rows is not None and len(self.rows[0]):
            place, dist, ids, labels = self.rows
            dist = pa.array(dist.astype(np.int64)) if kind == "long" else pa.array(dist)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[place]), pa.array(ids), pa.array(labels, pa.int64(), mask=labels == NO_LABEL).cast(pa.int32()), dist], ["query_id", "ref_id", "label", "dist"])


def matrix(columns: list) -> np.ndarray:
    """(rows, dim) doubles of one list column or of several number columns."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    if len(columns) == 1 and pa.types.is_list(columns[0].type):
        c = columns[0]
        flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 0))
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]) if len(columns[0]) else np.zeros((0, len(columns)))


def labels_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(NO_LABEL).to_numpy(zero_copy_only=False)


def few(queries: DataFrame, cols: list[str], block: int) -> pa.Table | None:
    """The queries themselves if there are at most ``block`` of them, else None."""
    got = queries.select("query_id", *cols).limit(block + 1).toArrow()
    return got if got.num_rows <= block else None


def nearest(queries: DataFrame, refs: DataFrame, qcols: list[str], rcols: list[str], k: int, distances: Callable, kind: str, block: int = 4096, part_rows: int = 1 << 16) -> DataFrame:
    """query_id, ref_id, label, dist, rank. Rows whose vector is null take no part; ties go to the smaller ref_id. Ids that are
    equal are still compared: leave a query's own row out of refs beforehand if it isn't wanted."""
    schema = f"query_id long, ref_id long, label int, dist {kind}"
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), *qcols).dropna()
    src = refs.select(F.col("ref_id").cast("long").alias("ref_id"), "label", *rcols).dropna(subset=["ref_id", *rcols])
    head = few(queries, qcols, block)
    if head is not None and not head.num_rows:
        out = refs.sparkSession.createDataFrame([], schema)
    elif head is not None:
        b = refs.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), matrix([head[c] for c in qcols])))  # at most ``block`` rows

        def near(batches):
            ids, q = b.value
            best = Best(k)
            for x in batches:
                if x.num_rows:
                    best.scan(q, x.column(0).to_numpy(), labels_of(x.column(1)), matrix(x.columns[2:]), distances)
            yield from best.batches(ids, kind)

        out = map_arrow(src, near, schema)
    else:
        q = stored(queries.withColumn("at", F.monotonically_increasing_id()), "queries")
        r = stored(src.withColumn("at", F.monotonically_increasing_id()), "references")
        lanes = lambda d, size: max(1, -(-d.count() // size))
        n, m = lanes(q, block), lanes(r, part_rows)
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.select(place("at", n).alias("x"), every(m).alias("y"), "query_id", *qcols)
        right = r.select(every(n).alias("rx"), place("at", m).alias("ry"), "ref_id", "label", *rcols)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            best = Best(k)
            if len(a) and len(b):
                best.scan(matrix([a[c] for c in qcols]), b["ref_id"].to_numpy(), labels_of(b["label"]), matrix([b[c] for c in rcols]), distances)
            rows = list(best.batches(a["query_id"].to_numpy(), kind))
            return pa.Table.from_batches(rows, schema=pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("label", pa.int32()), ("dist", pa.int64() if kind == "long" else pa.float64())]))

        importable(refs.sparkSession)
        out = left.groupBy("x", "y").cogroup(right.groupBy("rx", "ry")).applyInArrow(meet, schema)
    return best_per_query(out, k, ["dist", "ref_id"])


def knn_join(queries: DataFrame, refs: DataFrame, k: int = 5, name: str = "EUCLIDEAN", block: int = 4096) -> DataFrame:
    """queries(query_id, qv) against refs(ref_id, v, label) by the named metric."""
    return nearest(queries, refs, ["qv"], ["v"], k, kernel(name), "double", block)


def knn_grid(queries: DataFrame, refs: DataFrame, cols: list[str], k: int = 5, block: int = 4096) -> DataFrame:
    """Exact integer squared-distance neighbours. queries(query_id, *cols), refs(ref_id, label, *cols), all grid integers."""
    return nearest(queries, refs, cols, cols, k, grid, "long", block)
