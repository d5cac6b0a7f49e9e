"""Inverted-file index: k-means clusters with bounding boxes; approximate probing and exact completion.

Build: seeded centroids from a bounded id-ordered sample, Lloyd steps whose map side reduces each partition to one
row per cluster, splitting of clusters above a size, integer boxes. Centroids and boxes are bounded by the cluster
count; the rows never leave the executors. Search: ``ivf_search`` probes the nearest clusters;
``ivf_exact`` completes it: with R the k-th distance so far, any unprobed cluster whose box bound is <= R is scanned
too, so the answer equals the exhaustive one, ties included, for any clustering."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import GRID, Settings
from tessera.functions.scalar import box_bound, grid_l2
from tessera.operators import knn
from tessera.operators.knn import Best, best_per_query, few, labels_of, matrix
from tessera.session import importable, map_arrow, stored

PROBES = 512  # no query probes more clusters than this
CLUSTERS = 1 << 16  # cluster tables up to this size are held against a block of queries in one place


class VectorIndex(Protocol):
    """What every index offers: its name, and the k nearest references of queries(query_id, *cols) as (query_id, ref_id, label,
    dist, rank)."""

    name: str

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame: ...


def _matrix(batch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, the lowest on ties."""
    return np.argmin((c * c).sum(1)[None, :] - 2.0 * (x @ c.T), axis=1)


def assign(refs: DataFrame, cols: list[str], centroids: np.ndarray, name: str = "cluster_id", dist: str | None = None) -> DataFrame:
    """Adds the nearest centroid's index, and with ``dist`` the squared distance as a whole number; the centroids (bounded by the
    cluster count) are broadcast."""
    b = refs.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*refs.schema.fields, T.StructField(name, T.IntegerType()), *([T.StructField(dist, T.LongType())] if dist else [])])
    at = [refs.columns.index(c) for c in cols]

    def run(batches):
        for batch in batches:
            x, c = matrix([batch.column(i) for i in at]), b.value
            i = nearest(x, c)
            more = [pa.array(((x - c[i]) ** 2).sum(1).astype(np.int64))] if dist else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i.astype(np.int32)), *more], names=[*batch.schema.names, name, *([dist] if dist else [])])

    return map_arrow(refs, run, schema)


def drawn(df: DataFrame, n: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``n`` rows, at most that many, drawn with replacement; the same for the same seed and files."""
    total = df.count() if total is None else total
    return df.sample(True, min(1.0, 1.1 * n / max(total, 1)) if n < total else 1.0, seed).limit(n)


def kmeans(refs: DataFrame, cols: list[str], k: int, iters: int, seed: int = 42, batch: int | None = None, start: str | np.ndarray = "hash", whole: bool = False) -> np.ndarray:
    """Centroids after ``iters`` rounds, each over all rows (Lloyd) or over a fresh sample of ``batch`` rows drawn with
    replacement; an empty cluster keeps its centroid. They start at ``k`` different rows, the first by hash, or (``drawn``) at rows
    drawn with replacement, or at given centroids. ``whole`` rounds them half up after each round."""
    spark = refs.sparkSession
    given = isinstance(start, np.ndarray)
    total = refs.count() if batch or not given and start == "drawn" else 0
    if given:
        first = start
    elif start == "drawn":
        first = drawn(refs.select(*cols), k, seed, total).collect()
    else:
        first = refs.select(*cols).withColumn("_h", F.xxhash64("*", F.lit(seed))).distinct().orderBy("_h").limit(k).drop("_h").collect()
    c = np.array([list(r) for r in first], np.float64).reshape(-1, len(cols))
    for i in range(iters if len(c) > 1 else 0):
        rows = refs.select(*cols) if not batch or batch >= total else drawn(refs.select(*cols), batch, seed + 1 + i, total)
        b = spark.sparkContext.broadcast(c)

        def sums(batches, b=b):
            cen = b.value
            n, s = np.zeros(len(cen), np.int64), np.zeros(cen.shape)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, 0, cen.shape[1])
                    a = nearest(x, cen)
                    n += np.bincount(a, minlength=len(cen))
                    for d in range(cen.shape[1]):
                        s[:, d] += np.bincount(a, x[:, d], len(cen))
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n[got]), *[pa.array(s[got, d]) for d in range(cen.shape[1])]], ["c", "n", *cols])

        part = map_arrow(rows, sums, "c long, n long, " + ", ".join(f"{x} double" for x in cols))
        rows = part.groupBy("c").agg(F.sum("n"), *[F.sum(x) for x in cols]).collect()
        new = c.copy()
        for r in rows:
            new[r[0]] = np.array(r[2:]) / r[1]
            if whole:
                new[r[0]] = np.floor(new[r[0]] + 0.5)
        if np.array_equal(new, c) and not batch:
            break
        c = new
    return c


def split_large(members: DataFrame, cols: list[str], most: int, iters: int, seed: int) -> DataFrame:
    """Clusters above ``most`` rows fall into ceil(n / most) parts by k-means within the cluster (one level, so a part
    may still exceed it). Parts are found on a bounded sample per cluster and every row is then assigned, so no cluster
    has to fit one task. Adds part."""
    sizes = {r[0]: r[1] for r in members.groupBy("cluster_id").count().where(F.col("count") > most).collect()}
    if not sizes:
        return members.withColumn("part", F.lit(0))
    sample = 32 * most
    keep = F.lit(False)
    rate = {c: min(1.0, sample / n) for c, n in sizes.items()}
    m = F.create_map(*[F.lit(x) for kv in rate.items() for x in kv])
    keep = F.pmod(F.xxhash64("ref_id", F.lit(seed)), F.lit(1 << 20)) < F.coalesce(F.try_element_at(m, F.col("cluster_id")), F.lit(0.0)) * (1 << 20)

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ref_id")[cols].to_numpy(np.float64)
        k = -(-sizes[int(pdf.cluster_id.iloc[0])] // most)
        c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(iters):
            a = nearest(x, c)
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = x[a == j].mean(0)
        return pd.DataFrame({"cluster_id": int(pdf.cluster_id.iloc[0]), "c": list(c.tolist()), "part": np.arange(len(c), dtype=np.int32)})

    importable(members.sparkSession)
    cs = members.where(keep).select("cluster_id", "ref_id", *cols).groupBy("cluster_id").applyInPandas(parts, "cluster_id int, c array<double>, part int").collect()
    cents: dict[int, np.ndarray] = {}
    for r in sorted(cs, key=lambda r: (r.cluster_id, r.part)):
        cents.setdefault(r.cluster_id, []).append(r.c)
    b = members.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in cents.items()})
    at, cid = [members.columns.index(c) for c in cols], members.columns.index("cluster_id")

    def run(batches):
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            if batch.num_rows:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in at])
                c = batch.column(cid).to_numpy(zero_copy_only=False)
                for j in np.unique(c):
                    if int(j) in b.value:
                        part[c == j] = nearest(x[c == j], b.value[int(j)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return map_arrow(members, run, T.StructType([*members.schema.fields, T.StructField("part", T.IntegerType())]))


def near_clusters(q: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """(queries, n) places of the nearest centroids, in order; ties go to the first."""
    out = []
    for a in range(0, len(q), max(1, knn.CELLS // max(1, len(centroids)))):
        d = knn.squared(q[a : a + max(1, knn.CELLS // max(1, len(centroids)))], centroids)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def box_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(queries, clusters) lower bounds on the squared distance to anything in a box; exact for integers."""
    acc = np.zeros((len(q), len(lo)))
    for i in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, i] - q[:, i, None], q[:, i, None] - hi[None, :, i]), 0)
        acc += gap * gap
    return acc


def scan_clusters(rows: DataFrame, cols: list[str], query_ids: np.ndarray, q: np.ndarray, want: dict[int, np.ndarray], k: int, name: str = "cluster_id") -> DataFrame:
    """Each partition of the clustered rows holds its clusters against the queries (a block, broadcast) that want them, and
    returns k rows a query."""
    b = rows.sparkSession.sparkContext.broadcast((query_ids, q, want))
    src = rows.select("ref_id", "label", name, *cols)
    if len(want) <= 1000:
        src = src.where(F.col(name).isin([int(c) for c in want]))  # row groups of other clusters aren't read

    def run(batches):
        ids, q, want = b.value
        best = Best(k)
        for x in batches:
            if not x.num_rows:
                continue
            c = x.column(2).to_numpy(zero_copy_only=False)
            rid, lab = x.column(0).to_numpy(), labels_of(x.column(1))
            o = np.argsort(c, kind="stable")
            lead = np.flatnonzero(np.concatenate([[True], c[o][1:] != c[o][:-1]]))
            v = None
            for s, e in zip(lead, [*lead[1:], len(o)], strict=True):
                places = want.get(int(c[o[s]]))
                if places is not None:
                    v = matrix(x.columns[3:]) if v is None else v
                    best.scan(q, rid[o[s:e]], lab[o[s:e]], v[o[s:e]], knn.grid, places)
        yield from best.batches(ids, "long")

    return map_arrow(src, run, "query_id long, ref_id long, label int, dist long")


def wanted(clusters: np.ndarray, of: np.ndarray) -> dict[int, np.ndarray]:
    """Places of the queries by the cluster they want, from (query, cluster place) pairs."""
    r, c = of
    if not len(c):
        return {}
    o = np.argsort(c, kind="stable")
    lead = np.flatnonzero(np.concatenate([[True], c[o][1:] != c[o][:-1]]))
    return {int(clusters[c[o[s]]]): r[o[s:e]] for s, e in zip(lead, [*lead[1:], len(o)], strict=True)}


@dataclass(frozen=True)
class Ivf:
    """rows(ref_id, label, *cols, cluster_id), clusters(cluster_id, n, start, c*, lo*, hi*); share it with another n_probe by ``with_probe``.

    A block of queries and a cluster table of checked sizes are held against each other in numpy, and the block then visits
    the partitions of the rows; more queries go by joins on cluster_id, with the same results, after each batch of them was
    held against the clusters where it is. Only beyond CLUSTERS clusters are queries and clusters paired by a join."""

    rows: DataFrame
    clusters: DataFrame
    cols: list[str]
    n_probe: int = 2
    block: int = 4096

    @property
    def name(self) -> str:
        return f"IVF(nProbe={self.n_probe})"

    def with_probe(self, n: int) -> Ivf:
        return replace(self, n_probe=n)

    def save(self, path: str) -> None:
        """Rows by cluster and the cluster table, as Parquet under ``path``; ``load_ivf`` reads them back."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.clusters.write.mode("overwrite").parquet(f"{path}/clusters")

    def _cluster_arrays(self) -> tuple[np.ndarray, pa.Table] | None:
        """Cluster ids and their table, in order, if there are at most CLUSTERS, else None."""
        c = self.clusters.limit(CLUSTERS + 1).toArrow()
        return None if c.num_rows > CLUSTERS else (c.sort_by("cluster_id")["cluster_id"].to_numpy(), c.sort_by("cluster_id"))

    def probes(self, queries: DataFrame) -> DataFrame:
        """(query_id, cluster_id, probe) of each query's nearest clusters by centroid, capped by the cluster count and PROBES."""
        n, got, cols = min(self.n_probe, PROBES), self._cluster_arrays(), self.cols
        if got is None:
            return self._ranked(queries).where(F.col("probe") <= n)
        b = queries.sparkSession.sparkContext.broadcast((got[0], matrix([got[1][f"c_{x}"] for x in cols])))  # at most CLUSTERS

        def run(batches):
            ids, centroids = b.value
            for x in batches:
                places = near_clusters(matrix(x.columns[1:]), centroids, min(n, len(ids)))
                wide = places.shape[1]
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(np.repeat(np.arange(len(places)), wide))), pa.array(ids[places.ravel()].astype(np.int32)), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(places)))], ["query_id", "cluster_id", "probe"])

        return map_arrow(queries.select(F.col("query_id").cast("long").alias("query_id"), *cols).dropna(), run, "query_id long, cluster_id int, probe int")

    def _open(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, cluster_id) of the clusters whose box could hold something as near as the k-th so far. queries has found and r."""
        got, cols = self._cluster_arrays(), self.cols
        near = F.when(F.coalesce("found", F.lit(0)) < k, F.lit(float("inf"))).otherwise(F.col("r").cast("double"))
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), near.alias("r"), *cols)
        if got is None:
            c = self.clusters.select("cluster_id", *[f"lo_{x}" for x in cols], *[f"hi_{x}" for x in cols])
            lb = box_bound([F.col(x) for x in cols], [F.col(f"lo_{x}") for x in cols], [F.col(f"hi_{x}") for x in cols])
            return q.crossJoin(c).where(lb <= F.col("r")).select("query_id", "cluster_id")
        b = queries.sparkSession.sparkContext.broadcast((got[0], *(matrix([got[1][f"{s}_{x}"] for x in cols]) for s in ("lo", "hi"))))  # at most CLUSTERS

        def run(batches):
            ids, lo, hi = b.value
            step = max(1, knn.CELLS // max(1, len(ids)))
            for whole in batches:
                for a in range(0, whole.num_rows, step):
                    x = whole.slice(a, step)
                    r, c = np.nonzero(box_bounds(matrix(x.columns[2:]), lo, hi) <= x.column(1).to_numpy(zero_copy_only=False)[:, None])
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(r)), pa.array(ids[c].astype(np.int32))], ["query_id", "cluster_id"])

        return map_arrow(q.dropna(), run, "query_id long, cluster_id int")

    def _ranked(self, queries: DataFrame) -> DataFrame:
        d = queries.crossJoin(self.clusters.select("cluster_id", *[f"c_{c}" for c in self.cols]))
        dist = sum(((F.col(c).cast("double") - F.col(f"c_{c}")) * (F.col(c).cast("double") - F.col(f"c_{c}")) for c in self.cols), F.lit(0.0))
        return best_per_query(d.select("query_id", "cluster_id", dist.alias("d")), 1 << 30, ["d", "cluster_id"]).select("query_id", "cluster_id", F.col("rank").alias("probe"))

    def _small(self, queries: DataFrame) -> tuple | None:
        """(query ids, queries, cluster ids, cluster table) where both are within bounds, else None."""
        head = few(queries.dropna(subset=["query_id", *self.cols]), self.cols, self.block)
        c = None if head is None else self._cluster_arrays()
        return None if c is None else (head["query_id"].cast("int64").to_numpy(), matrix([head[x] for x in self.cols]), *c)

    def _probed(self, small: tuple) -> tuple[np.ndarray, np.ndarray]:
        _, q, ids, c = small
        places = near_clusters(q, matrix([c[f"c_{x}"] for x in self.cols]), min(self.n_probe, PROBES, len(ids)))
        return np.repeat(np.arange(len(q)), places.shape[1]), places.ravel()

    def _scan(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in self.cols])
        d = pairs.join(q, "query_id").join(self.rows, "cluster_id")
        d = d.select("query_id", "ref_id", "label", "cluster_id", grid_l2([F.col(f"q_{c}") for c in self.cols], [F.col(c) for c in self.cols]).alias("dist"))
        return best_per_query(d, k, ["dist", "ref_id"])

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        small = self._small(queries)
        if small is None:
            return self._scan(self.probes(queries), queries, k).drop("cluster_id")
        found = scan_clusters(self.rows, self.cols, small[0], small[1], wanted(small[2], self._probed(small)), k)
        return best_per_query(found, k, ["dist", "ref_id"])

    def unprobed(self, queries: DataFrame) -> DataFrame:
        """(query_id, cluster_id) of every cluster that a query doesn't probe: those ranked behind its probes."""
        return self._ranked(queries).where(F.col("probe") > min(self.n_probe, PROBES)).select("query_id", "cluster_id")

    def exact(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The probed answer completed by every cluster whose box could hold something as near as the k-th."""
        small = self._small(queries)
        if small is None:
            return self._exact_by_joins(queries, k)
        ids, q, cluster, c = small
        r, p = self._probed(small)
        first = scan_clusters(self.rows, self.cols, ids, q, wanted(cluster, (r, p)), k)
        first = best_per_query(first, k, ["dist", "ref_id"]).drop("rank").toArrow()  # at most k rows a query of the block
        place = np.argsort(ids, kind="stable")
        at = place[np.searchsorted(ids[place], first["query_id"].to_numpy())]
        kth, dist = np.full(len(ids), -1.0), first["dist"].to_numpy().astype(float)
        np.maximum.at(kth, at, dist)
        kth[np.bincount(at, minlength=len(ids)) < k] = np.inf
        lo, hi = (matrix([c[f"{s}_{x}"] for x in self.cols]) for s in ("lo", "hi"))
        left, right = [], []
        for a in range(0, len(q), max(1, knn.CELLS // max(1, len(cluster)))):
            s = slice(a, a + max(1, knn.CELLS // max(1, len(cluster))))
            x, y = np.nonzero(box_bounds(q[s], lo, hi) <= kth[s, None])
            left.append(x + a)
            right.append(y)
        pair = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64) * max(1, len(cluster)) + np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)
        pair = np.setdiff1d(pair, r.astype(np.int64) * max(1, len(cluster)) + p)
        spark = self.rows.sparkSession
        have = spark.createDataFrame(first, "query_id long, ref_id long, label int, dist long")
        rest = scan_clusters(self.rows, self.cols, ids, q, wanted(cluster, (pair // max(1, len(cluster)), pair % max(1, len(cluster)))), k)
        return best_per_query(have.unionByName(rest), k, ["dist", "ref_id"])

    def _exact_by_joins(self, queries: DataFrame, k: int) -> DataFrame:
        probed = self.probes(queries)
        first = self._scan(probed, queries, k).drop("rank", "cluster_id")
        kth = first.groupBy("query_id").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("found"))
        open_ = self._open(queries.join(kth, "query_id", "left"), k)
        rest = self._scan(open_.join(probed, ["query_id", "cluster_id"], "left_anti"), queries, k).drop("rank", "cluster_id")
        return best_per_query(first.unionByName(rest), k, ["dist", "ref_id"])

    def early_stop(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Lossy: a query whose k neighbours after half of its probes are of one class stops there."""
        half = -(-self.n_probe // 2)
        pr = self.probes(queries)
        a = self._scan(pr.where(F.col("probe") <= half), queries, k).drop("rank", "cluster_id")
        done = a.groupBy("query_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("lo") == F.col("hi")) & (F.col("n") == k)).select("query_id")
        b = self._scan(pr.where(F.col("probe") > half).join(done, "query_id", "left_anti"), queries, k).drop("rank", "cluster_id")
        return best_per_query(a.unionByName(b), k, ["dist", "ref_id"])


def load_ivf(spark, path: str, n_probe: int = 2) -> Ivf:
    """An index saved by ``Ivf.save``; sizes that don't add up to the rows are an error."""
    rows, clusters = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/clusters")
    n, size = rows.count(), clusters.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    if n != size:
        raise ValueError(f"{path}: {n} rows, but clusters of {size}")
    return Ivf(rows, clusters, [c[2:] for c in clusters.columns if c.startswith("c_")], n_probe)


@dataclass(frozen=True)
class IvfQ16:
    """The quantised index: int16 rows of one affine lattice, by cluster, and float centroids. Queries are on the grid; a query is
    narrowed to the lattice, probes its nearest centroids by distance on the real scale, and distances are integers of the
    lattice. No completion: the answer is that of the probed clusters. With ``stop_early`` a query ends with the first
    cluster from half of its probes on after which its k neighbours are there and of one class."""

    rows: DataFrame  # ref_id, label, cluster_id, v array<int>
    clusters: DataFrame  # cluster_id, n, start, centroid array<float>
    lo: float
    hi: float
    cols: list[str]
    n_probe: int = 2
    stop_early: bool = False

    @property
    def name(self) -> str:
        return f"IVF_Q16(nProbe={self.n_probe})"

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        from tessera.sources.binary import lattice

        cols, dim, n = self.cols, len(self.cols), min(self.n_probe, PROBES)
        c = self.clusters.limit(CLUSTERS + 1).toArrow().sort_by("cluster_id")
        if c.num_rows > CLUSTERS:
            raise ValueError(f"more than {CLUSTERS} clusters")
        b = self.rows.sparkSession.sparkContext.broadcast((c["cluster_id"].to_numpy(), matrix([c["centroid"]]).reshape(-1, dim)))  # of checked size
        lo, hi = self.lo, self.hi

        def probe(batches):
            ids, centroids = b.value
            for x in batches:
                q = matrix(x.columns[1:]) / GRID
                places = near_clusters(q, centroids, min(n, len(ids)))
                r = np.repeat(np.arange(len(q)), places.shape[1])
                v = lattice(q, lo, hi).astype(np.int32)[r]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(r)), pa.array(ids[places.ravel()].astype(np.int32)), pa.array(np.tile(np.arange(1, places.shape[1] + 1, dtype=np.int32), len(q))), lists], ["query_id", "cluster_id", "probe", "qv"])

        src = queries.select(F.col("query_id").cast("long").alias("query_id"), *cols).dropna()
        probed = map_arrow(src, probe, "query_id long, cluster_id int, probe int, qv array<int>")
        dist = F.aggregate(F.zip_with("qv", "v", lambda a, x: (a - x).cast("long") * (a - x)), F.lit(0).cast("long"), lambda s, x: s + x)
        found = probed.join(self.rows, "cluster_id").select("query_id", "probe", "ref_id", "label", dist.alias("dist"))
        found = best_per_query(found.withColumn("lane", F.struct("query_id", "probe")), k, ["dist", "ref_id"], "lane").drop("lane", "rank")
        if self.stop_early:
            half = max(1, (min(n, len(c)) + 1) // 2)
            lane = found.withColumn("last", F.explode(F.sequence(F.greatest("probe", F.lit(half)), F.lit(max(half, min(n, len(c)))))))
            lane = best_per_query(lane.withColumn("lane", F.struct("query_id", "last")), k, ["dist", "ref_id"], "lane").drop("lane", "rank")
            ends = lane.groupBy("query_id", "last").agg(((F.count(F.lit(1)) == k) & (F.min("label") == F.max("label"))).alias("stop"))
            ends = ends.groupBy(F.col("query_id").alias("of")).agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("last"))), F.max("last")).alias("end"))
            found = lane.join(ends, (lane.query_id == ends.of) & (lane["last"] == ends.end)).drop("of", "end", "last")
        return best_per_query(found.drop("probe"), k, ["dist", "ref_id"])


def load_ivf_q16(spark, clusters_path: str, vectors_path: str, cols: list[str], n_probe: int = 2, stop_early: bool = False) -> IvfQ16:
    """A cluster container and a quantised vector container as one index; their row counts and widths must be equal."""
    from tessera.sources import binary

    head = binary.header(vectors_path)
    if not head["quantised"]:
        raise ValueError(f"{vectors_path}: not a quantised container")
    clusters = binary.read_clusters(spark, clusters_path, head["count"])
    if head["dim"] != len(cols) or len(clusters.schema) and len(clusters.select("centroid").first()[0] if head["count"] else cols) != len(cols):
        raise ValueError(f"{vectors_path}: {head['dim']} dimensions, not {len(cols)}")
    vectors = binary.read_vectors(spark, vectors_path, raw=True)
    places = binary.read_postings(spark, clusters_path).withColumnRenamed("ref_id", "r")
    rows = vectors.join(places, vectors.ref_id == F.col("r")).select("ref_id", "label", "cluster_id", "v")
    return IvfQ16(stored(rows.repartitionByRange("cluster_id", "ref_id").sortWithinPartitions("cluster_id", "ref_id"), "q16-rows"), clusters, head["lo"], head["hi"], cols, n_probe, stop_early)


def cluster_table(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Per cluster: size, exclusive prefix sum of sizes, centroid (integer sum over count) and integer box."""
    agg = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(F.col(c).cast("bigint")) / F.count(F.lit(1))).alias(f"c_{c}") for c in cols], *[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])
    start = F.coalesce(F.sum("n").over(W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return agg.withColumn("start", start)


def build_ivf(refs: DataFrame, cols: list[str], n_centroids: int = 64, max_cluster: int = 512, iters: int = 8, split_iters: int = 10, n_probe: int = 2, seed: int = 42, batch: int | None = None, start: str = "hash") -> Ivf:
    """refs(ref_id, label, *cols). Empty clusters vanish, an empty table gives an empty index. The clustered rows are
    written, sorted by cluster, to the shared folder. ``batch`` and ``start`` as in ``kmeans``."""
    src = refs.select("ref_id", "label", *cols)
    c = kmeans(src, cols, n_centroids, iters, seed, batch, start)
    if not len(c):
        rows = src.withColumn("cluster_id", F.lit(0))
        return Ivf(rows, cluster_table(rows, cols), cols, n_probe)
    rows = split_large(stored(assign(src, cols, c), "ivf-coarse"), cols, max_cluster, split_iters, seed)
    rows = rows.withColumn("cluster_id", (F.col("cluster_id") * F.lit(1 << 12) + F.col("part")).cast("int")).drop("part")
    rows = stored(rows.repartitionByRange("cluster_id", "ref_id").sortWithinPartitions("cluster_id", "ref_id"), "ivf-rows")
    return Ivf(rows, stored(cluster_table(rows, cols), "ivf-clusters"), cols, n_probe)


class BruteForce:
    """Every reference, by any metric: integer distances on the grid for the Euclidean one, else doubles."""

    name = "BRUTE_FORCE"

    def __init__(self, refs: DataFrame, cols: list[str], metric: str = "EUCLIDEAN"):
        self.refs, self.cols, self.metric = refs, cols, metric
        knn.kernel(metric)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        if knn.kernel(self.metric) is knn.squared:
            return knn.knn_grid(queries, self.refs, self.cols, k)
        return knn.nearest(queries, self.refs, self.cols, self.cols, k, knn.kernel(self.metric), "double")


def make_index(name: str, refs: DataFrame | None, cols: list[str], metric: str = "EUCLIDEAN", clusters_path: str | None = None, vectors_path: str | None = None, stop_early: bool = False, **options) -> VectorIndex:
    """BRUTE_FORCE (any metric), IVF, or IVF_Q16 (from its two files, else an error); an unknown name is an error."""
    key = (name or "").strip().upper()
    if key == "BRUTE_FORCE":
        return BruteForce(refs, cols, metric)
    if key == "IVF":
        return build_ivf(refs, cols, **options)
    if key == "IVF_Q16":
        if not clusters_path or not vectors_path:
            raise ValueError("IVF_Q16 needs a cluster container and a quantised vector container")
        return load_ivf_q16(SparkSession.active() if refs is None else refs.sparkSession, clusters_path, vectors_path, cols, options.get("n_probe", 2), stop_early)
    raise ValueError(f"unknown index: {name}")


def index_from(settings: Settings, refs: DataFrame | None, cols: list[str], clusters_path: str | None = None, vectors_path: str | None = None) -> VectorIndex:
    """The index that the settings name, with their metric, probes and build parameters."""
    s = settings
    if s.index.strip().upper() == "IVF":
        return build_ivf(refs, cols, s.n_centroids, s.max_cluster, s.kmeans_iters, s.split_iters, s.n_probe, s.seed, s.kmeans_sample, "drawn")
    return make_index(s.index, refs, cols, s.metric, clusters_path, vectors_path, s.early_stop, n_probe=s.n_probe)
