"""Improbable-feature digests of texts and their likeness.

Every 64-byte window has an entropy; windows are ranked by how rare their entropy is in the whole corpus (one counting
pass over all texts). In each run of 64 neighbouring windows the leftmost rarest one scores; windows that score often
enough are the text's features; where none does, its 16 rarest windows, one that
comes again a byte longer each time. Features go into a chain of Bloom filters (2048 bits, five bits a feature, a new filter
after 160 features). Two digests are compared filter by filter: bit overlap normalised between the overlap expected by
chance and the largest possible, best partner each, averaged by features.

Entropy sums are kept as scaled integers, so a window's value doesn't depend on where its text lies in a batch.

Edge cases: an empty or null text has no features (digest ``sd1:0::``); a text shorter than a window has itself as its
one feature. Equal digests have likeness 1, an empty and a non-empty one 0. Null ids order below all others, repeated ids by text
hash; the only row of a table is its own next row; a text of any length is fingerprinted whole; an empty table gives no rows;
other columns, whatever their names, aren't looked at."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import chunks, column, span_hashes, text_only
from tessera.session import map_arrow

WINDOW, RUN, POPULAR = 64, 64, 16
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
BUCKETS = 1001
_SUM = np.zeros(WINDOW + 2, np.int64)
_SUM[1:] = np.round(np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2)) * 65536).astype(np.int64)


def entropy_buckets(b: np.ndarray) -> np.ndarray:
    """Entropy of the window at each start, 0 to 1000 of the largest possible (length len(b) - WINDOW + 1)."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    step = 1 << 15
    for a in range(0, n, step):  # small pieces stay in the cache
        z = min(n, a + step)
        for k in range(1, WINDOW):
            e = min(z, n - k)
            if e <= a:
                break
            eq = (b[a:e] == b[a + k : e + k]).view(np.uint8)
            ahead[a:e] += eq
            behind[a + k : e + k] += eq
    s0 = int(_SUM[np.bincount(b[:WINDOW], minlength=1)].sum())
    out, into = ahead[: n - WINDOW], behind[WINDOW:]
    drop, gain = _SUM[:-1] - _SUM[1:], _SUM[1:] - _SUM[:-1]
    s = np.empty(n - WINDOW + 1, np.int64)
    s[0] = s0
    np.cumsum(drop[out] + gain[into], out=s[1:])
    s[1:] += s0
    full = _SUM[WINDOW]
    return (full - s) * 1000 // full


def _valid(off: np.ndarray, n: int) -> np.ndarray:
    """Window starts whose window lies within one text."""
    ok = np.zeros(max(n - WINDOW + 1, 0), bool)
    for s, e in zip(off[:-1], off[1:], strict=True):
        if e - s >= WINDOW:
            ok[s : e - WINDOW + 1] = True
    return ok


def entropy_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Windows by entropy bucket over all texts, and the bytes read."""

    def run(batches):
        c, size = np.zeros(BUCKETS, np.int64), 0
        for x in batches:
            b, off = column(x.column(0))
            size += len(b)
            for i, j in chunks(off, 1 << 20):
                piece = b[off[i] : off[j]]
                q = entropy_buckets(piece)
                c += np.bincount(q[_valid(off[i : j + 1] - off[i], len(piece))], minlength=BUCKETS)
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(c[k], size))], ["q", "n"])

    rows = map_arrow(docs.select("text"), run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()
    c, size = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r.q < 0:
            size = r.n
        else:
            c[r.q] = r.n
    return c, size


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each bucket, rarest first; windows of next to no or nearly full entropy come last."""
    rank = np.empty(BUCKETS, np.int64)
    rank[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)
    rank[:100] += 10_000
    rank[990:] += 10_000
    return rank


def select(b: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's features in order of place."""
    n, rows = len(b), len(off) - 1
    size = np.diff(off)
    picked = np.zeros(n + 1, bool)
    stops: dict[int, int] = {}
    if n >= WINDOW:
        q = entropy_buckets(b)
        key = (rank[q] << 40) + np.arange(len(q))
        m = key.copy()
        w = 1
        while w < RUN:
            k = max(len(m) - w, 0)
            m[:k] = np.minimum(m[:k], m[w:])
            w *= 2
        runs = np.zeros(len(q), bool)
        for s, e in zip(off[:-1], off[1:], strict=True):
            k = e - s - WINDOW + 1
            if k >= RUN:
                runs[s : s + k - RUN + 1] = True
            elif k > 0:
                picked[key[s : s + k].min() & ((1 << 40) - 1)] = True
        pop = np.bincount(m[runs] & ((1 << 40) - 1), minlength=n)
        picked[:n] |= pop >= POPULAR
        upto = np.append(0, np.cumsum(picked[:n]))
        for r in np.flatnonzero((size >= WINDOW) & (upto[off[1:]] == upto[off[:-1]])):  # none scores often enough
            own = key[off[r] : off[r + 1] - WINDOW + 1]
            at = np.sort(np.partition(own, POPULAR - 1)[:POPULAR] & ((1 << 40) - 1))
            picked[at] = True
            seen: dict[bytes, int] = {}
            for s in at:  # a single feature's five bits meet a full filter by chance, so windows that come again reach further
                w = b[s : s + WINDOW].tobytes()
                stops[s] = min(s + WINDOW + seen.get(w, 0), off[r + 1])
                seen[w] = seen.get(w, 0) + 1
    tiny = np.flatnonzero((size > 0) & (size < WINDOW))
    picked[off[tiny]] = True
    at = np.flatnonzero(picked[:n])
    row = np.searchsorted(off, at, side="right") - 1
    end = np.minimum(at + WINDOW, off[row + 1])
    if stops:
        far = np.array(sorted(stops))
        end[np.searchsorted(at, far)] = [stops[s] for s in far.tolist()]
    return row, span_hashes(b, at, end)


class Digest:
    """Chained filters: bits as (filters, 32) words, features by filter."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray):
        self.bits, self.counts = bits, counts

    def text(self) -> str:
        return f"sd1:{len(self.counts)}:{int(self.counts[-1]) if len(self.counts) else ''}:{base64.b64encode(self.bits.tobytes()).decode()}"

    @classmethod
    def parse(cls, s: str) -> Digest:
        _, n, last, raw = s.split(":", 3)
        n = int(n)
        bits = np.frombuffer(base64.b64decode(raw), "<u8").reshape(n, FILTER_BITS // 64)
        return cls(bits, np.array([PER_FILTER] * (n - 1) + [int(last)] if n else [], np.int64))


def digests(b: np.ndarray, off: np.ndarray, rank: np.ndarray) -> list[Digest]:
    out = []
    for i, j in chunks(off, 1 << 20):
        row, h = select(b[off[i] : off[j]], off[i : j + 1] - off[i], rank)
        # a feature that comes again counts once, at its first place
        o = np.lexsort((np.arange(len(h)), h, row))
        first = np.ones(len(o), bool)
        first[1:] = (h[o][1:] != h[o][:-1]) | (row[o][1:] != row[o][:-1])
        keep = np.sort(o[first])
        row, h = row[keep], h[keep]
        n = np.bincount(row, minlength=j - i)
        f = -(-n // PER_FILTER)
        base = np.cumsum(f) - f
        nth = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        where = (base[row] + nth // PER_FILTER) * FILTER_BITS
        bits = np.zeros(int(f.sum()) * FILTER_BITS, np.uint8)
        for k in range(HASHES):
            bits[where + ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        packed = np.packbits(bits, bitorder="little").view("<u8").reshape(-1, FILTER_BITS // 64)
        for x in range(j - i):
            c = np.full(f[x], PER_FILTER, np.int64)
            if f[x]:
                c[-1] = n[x] - PER_FILTER * (f[x] - 1)
            out.append(Digest(packed[base[x] : base[x] + f[x]], c))
    return out


def likeness(x: Digest, y: Digest) -> float:
    """0 to 1; 1 for equal digests."""
    if len(x.counts) == len(y.counts) and np.array_equal(x.bits, y.bits):
        return 1.0
    if not len(x.counts) or not len(y.counts):
        return 0.0
    if (len(x.counts), x.counts[-1]) > (len(y.counts), y.counts[-1]):
        x, y = y, x
    sy = np.bitwise_count(y.bits).sum(1).astype(float)
    total = 0.0
    for a, c in zip(x.bits, x.counts, strict=True):
        sa, best = float(np.bitwise_count(a).sum()), 0.0
        for k in range(0, len(sy), 4096):
            both = np.bitwise_count(y.bits[k : k + 4096] & a).sum(1)
            chance, most = sa * sy[k : k + 4096] / FILTER_BITS, np.minimum(sa, sy[k : k + 4096])
            best = max(best, float(((both - chance) / np.maximum(most - chance, 1e-9)).max()))
        total += min(max(best, 0.0), 1.0) * c
    return total / float(x.counts.sum())


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by as many code points (or all) from the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _dealt(slim: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows dealt by descending id into parts, each part also holding the first row of the part that follows (halo). An id that
    fills several parts by itself (null, say) has its rows dealt by text hash among parts of its own."""
    from pyspark.ml.feature import Bucketizer

    low = -(1 << 63)
    d = slim.withColumns({"key": F.coalesce("doc_id", F.lit(low)), "h": F.xxhash64("text")})
    cuts = d.agg(F.percentile_approx("key", F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5)), 10_000)).collect()[0][0]
    quantiles = [float(x) for x in cuts or []] if parts > 1 else []
    heavy = {x: quantiles.count(x) + 1 for x in set(quantiles) if quantiles.count(x) > 1}
    cuts = sorted({*quantiles, *(float(np.nextafter(x, np.inf)) for x in heavy)})
    d = d.withColumn("k", F.col("key").cast("double"))
    d = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="k", outputCol="p", handleInvalid="keep").transform(d) if cuts else d.withColumn("p", F.lit(0.0))
    lanes = [heavy.get(x, 1) for x in [None, *cuts]]  # of each range of ids, in ascending order
    first = np.cumsum([0, *lanes])
    if heavy:
        share = F.col("h") / float(1 << 64) + 0.5  # of the hashes below this one
        of = F.element_at(F.array(*[F.lit(int(x)) for x in lanes]), F.col("p").cast("int") + 1)
        base = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col("p").cast("int") + 1)
        d = d.withColumn("p", base + F.least(F.floor(share * of), of - 1))
    d = d.withColumn("p", F.col("p").cast("int")).drop("k")
    tops = {r.p: r.top for r in d.groupBy("p").agg(F.max(F.struct("key", "h")).alias("top")).collect()}  # one row a part
    order = sorted(tops)
    rows = [(p, tops[p].key, tops[p].h, order[i + 1] if i + 1 < len(order) else order[0]) for i, p in enumerate(order)]
    halo = d.sparkSession.createDataFrame(rows, "hp int, top long, top_h long, above int")
    d = d.join(F.broadcast(halo), d.p == halo.hp)
    own = F.struct(F.col("p").alias("part"), F.lit(0).alias("halo"))
    leads = (F.col("key") == F.col("top")) & (F.col("h") == F.col("top_h"))
    d = d.withColumn("x", F.explode(F.when(leads, F.array(own, F.struct(F.col("above").alias("part"), F.lit(1).alias("halo")))).otherwise(F.array(own))))
    d = d.select("x.part", "x.halo", "key", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "h")
    n = int(first[-1])
    return d.repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", F.desc("key"), F.desc("h")), n


def fingerprints(docs: DataFrame, part_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row. ``part_bytes``
    of text make a task."""
    slim = text_only(docs)
    counts, size = entropy_counts(slim)
    rank = rarity(counts)
    dealt = _dealt(slim, max(1, -(-size // part_bytes)))[0] if slim.limit(1).count() else slim.select(F.lit(0).alias("part"), F.lit(0).alias("halo"), F.lit(0).cast("long").alias("key"), "doc_id", "text", F.lit(0).cast("long").alias("h"))

    def run(batches):
        held: list = []  # the last row, waiting for the one that follows
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True))
            yield from emit(held + rows, False)
            held = [rows[-1]] if len(rows) else held
        yield from emit(held, True)

    def emit(rows, last):
        # a row is reported once the row after it is known: in its part, own or halo
        for a in range(0, max(len(rows) - 1, 0), 512):
            r = rows[a : a + 513]
            use = [i for i in range(len(r) - 1) if r[i][1] == 0 and r[i + 1][0] == r[i][0]]
            if not use:
                continue
            plain = digests(*column(pa.array([x[3] for x in r], pa.large_string())), rank)
            texts = [edit(r[i][3], r[i + 1][3]) for i in use]
            edited = digests(*column(pa.array(texts, pa.large_string())), rank)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i][2] for i in use], pa.int64()), pa.array([len(r[i][3]) for i in use], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array([plain[i].text() for i in use]), pa.array([e.text() for e in edited]),
                    pa.array([likeness(plain[i], e) for i, e in zip(use, edited, strict=True)]), pa.array([likeness(plain[i], plain[i + 1]) for i in use]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return map_arrow(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4(docs: DataFrame, **options) -> DataFrame:
    return fingerprints(docs, **options)
