"""Packing of token sequences into few bins of fixed capacity, by a configuration linear program over lengths.

The lengths' histogram (at most ``capacity`` rows) is all the driver sees. Columns of the program are configurations
(multisets of lengths that fit one bin); multiplicative weights over the lengths price them, and a knapsack dynamic program
finds the best one. One pass covers every length exactly; where it isn't within a tenth of a per cent of the best dual
bound, weights with small steps follow. The fractional solution is rounded down, and the few pieces that leaves go best-fit into the
room of its bins and new ones. The plan is a list of (configuration, multiplicity), so its size depends on the number of lengths, not of documents.

Rows find their place without moving by length: each task numbers its own pieces of a length, a prefix sum over
(task, length) counts makes that a global rank, and the rank falls into one slot range of the broadcast plan.

Edge cases: a null or empty text is one piece holding only the end id; null and repeated ids are packed like others; an
empty table gives no rows; other columns, whatever their names, aren't looked at. The first piece of a long document is the
shorter one, the others are full; a text of any length is cut whole."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.text import chunks, column, text_only
from tessera.llm.tokens import encoder
from tessera.session import map_arrow, stored

CAPACITY, END_ID = 2048, 0
Plan = list[tuple[tuple[int, ...], int]]


def price(value: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The most valuable multiset of lengths that fits: an unbounded knapsack. value[l] is a length's worth."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = value[1 : c + 1] + best[c - 1 :: -1] if c > 1 else value[1:2] + best[:1]
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], take[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if take[c]:
            out.append(int(take[c]))
            c -= int(take[c])
        else:
            c -= 1
    return tuple(out)


Solution = list[tuple[tuple[int, ...], float]]


def cover_once(need: np.ndarray, capacity: int) -> tuple[Solution, float]:
    """Configurations that cover every length's need and none beyond it, and a lower bound. The weights price the lengths, and
    each round's configuration grows until its scarcest length is covered, whose weight then is 0: no more rounds than lengths."""
    cover = np.zeros(len(need))
    start = (np.arange(len(need)) / capacity) ** 1.05  # nearly the volume bound's prices; long lengths first, short ones fill up
    out: dict[tuple[int, ...], float] = {}
    open_, bound = need > 0, 0.0
    while open_.any():
        c = price(np.where(open_, start * np.exp(-cover / np.maximum(need, 1)), 0.0), capacity)
        if not c:
            break
        bound = bound or float(start @ need) / float(start[list(c)].sum())
        k = np.bincount(c, minlength=len(need))
        used = np.flatnonzero(k)
        room = (need - cover)[used] / k[used]
        x = float(room.min())
        out[c] = out.get(c, 0.0) + x
        cover[used] += x * k[used]
        open_[used[room <= x * (1 + 1e-12)]] = False
    return list(out.items()), bound


def cover_by_weights(need: np.ndarray, capacity: int, steps: int, rate: float) -> tuple[Solution, float]:
    """Multiplicative weights with small steps: a length's price falls exponentially with how often it is covered, the best
    configuration grows by a ``steps``-th of its scarcest length's need, and in the end all are scaled until the scarcest
    length is just covered. The bound is the best over the rounds' prices: what all lengths are worth over what fits a bin."""
    lengths = np.flatnonzero(need > 0)
    start = np.where(need > 0, (np.arange(len(need)) / capacity) ** 1.05, 0.0)
    cover, bound, out = np.zeros(len(need)), 0.0, {}
    while (least := cover[lengths].min()) < 1:
        y = start * np.exp(-rate * (cover - least))
        c = price(y, capacity)
        k = np.bincount(c, minlength=len(need))
        used = np.flatnonzero(k)
        bound = max(bound, float(y @ need) / float(y[used] @ k[used]))
        x = float((need[used] / k[used]).min()) / steps
        out[c] = out.get(c, 0.0) + x
        cover[used] += x * k[used] / need[used]
    return [(c, x / least) for c, x in out.items()], bound


def solve(demand: np.ndarray, capacity: int, gap: float = 0.001, pricings: int = 2400) -> tuple[Solution, float]:
    """Fractional configurations that cover the demand, and a lower bound on any such solution (the dual's value at the best
    prices seen, the volume's among them). Where one pass leaves more than ``gap`` between the two, small steps follow, in
    about ``pricings`` rounds: slow prices for the bound, fast ones for the configurations."""
    need = demand.astype(float)
    if not need.any():
        return [], 0.0
    best, bound = cover_once(need, capacity)
    cost = lambda s: sum(x for _, x in s)
    bound = max(bound, float(np.arange(len(need)) @ need) / capacity)
    for rate in (5.0, 60.0):
        if cost(best) > bound * (1 + gap):
            other, b = cover_by_weights(need, capacity, max(2, pricings // (2 * int((need > 0).sum()))), rate)
            best, bound = min(best, other, key=cost), max(bound, b)
    return best, bound


def solve_lp(demand: np.ndarray, capacity: int) -> Solution:
    return solve(demand, capacity)[0]


def best_fit(left: np.ndarray, capacity: int, begun: Plan | None = None) -> Plan:
    """Best fit by descending length over classes of equal bins, into the room of the bins ``begun`` first."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for c, m in begun or []:
        by_room[capacity - sum(c)].append([c, m])
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        room = length
        while n and room <= capacity:
            while n and by_room[room]:
                cls = by_room[room][-1]
                m = min(n, cls[1])
                cls[1] -= m
                if not cls[1]:
                    by_room[room].pop()
                by_room[room - length].append([(*cls[0], length), m])
                n -= m
                if room - length >= length:
                    room = length - 1
                    break
            room += 1
        if n:
            k = capacity // length
            for size, count in ((k, n // k), (n % k, 1)):
                if size and count:
                    by_room[capacity - size * length].append([(length,) * size, count])
    return [(tuple(c), m) for cls in by_room for c, m in cls if m]


def rounded(solution: Solution, left: np.ndarray) -> Plan:
    """The solution's whole configurations, largest shares first, taken from ``left``; a length that runs out leaves its room."""
    out: Plan = []
    for c, x in sorted(solution, key=lambda s: -s[1]):
        m = int(x + 1e-6)
        while m and c:
            k = np.bincount(c, minlength=len(left))
            used = np.flatnonzero(k)
            n = min(m, int((left[used] // k[used]).min()))
            if n:
                out.append((c, n))
                left -= k * n
                m -= n
            if m:
                c = tuple(v for v in sorted(set(c), reverse=True) for _ in range(min(int(k[v]), int(left[v]))))
    return out


def plan(demand: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Configurations with multiplicities that hold exactly ``demand``[length] pieces of each length: the program's whole
    ones, and what their rounding leaves by best fit into their room and new bins."""
    left = demand.astype(np.int64).copy()
    full: Plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    kept = rounded(solve_lp(left, capacity), left)
    return full + best_fit(left, capacity, kept)


def slots(p: Plan) -> tuple[np.ndarray, ...]:
    """The plan as slot ranges sorted by (length, first rank): length, first, sequence base, offset."""
    length, count, base, off = [], [], [], []
    seq = 0
    for c, m in p:
        at = 0
        for x in c:
            length.append(x)
            count.append(m)
            base.append(seq)
            off.append(at)
            at += x
        seq += m
    length, count, base, off = (np.array(x, np.int64) for x in (length, count, base, off))
    o = np.argsort(length, kind="stable")
    length, count, base, off = length[o], count[o], base[o], off[o]
    first = np.cumsum(count) - count
    if len(length):
        lead = np.searchsorted(length, length, side="left")
        first -= first[lead]
    return length, first, base, off


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut: doc_id, piece, start, length, ids_crc32, task and rank among the task's
    pieces of that length; with_ids adds the ids themselves."""

    def cut(batches):
        e, seen, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            buf, off = column(whole.column(1))
            for i, j in chunks(off, 4 << 20):  # bounds what a task holds beside the batch
                b = whole.slice(i, j - i)
                flat, o = e.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(o) + 1
                ids = np.insert(flat.astype("<u4"), o[1:], end_id)
                at = np.cumsum(n) - n
                k = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                head = n - (k - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                a = at[row] + start
                crc = [zlib.crc32(ids[x : x + y]) for x, y in zip(a, length, strict=True)]
                s = np.argsort(length, kind="stable")
                nth = np.empty(len(s), np.int64)
                nth[s] = np.arange(len(s)) - np.searchsorted(length[s], length[s], side="left")
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(nth)]
                if with_ids:
                    cols.append(pa.array([ids[x : x + y].tolist() for x, y in zip(a, length, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<long>" * with_ids
    return map_arrow(text_only(docs), cut, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset. A sequence's tokens are its pieces by offset."""
    cut = stored(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        demand[r.length] = r.n
    length, first, base, off = slots(plan(demand, capacity))
    b = docs.sparkSession.sparkContext.broadcast((length, first, base, off))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("task", "length", before.alias("before")), ["task", "length"])
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*keep, (F.col("nth") + F.col("before")).alias("rank"))

    def place(batches):
        length, first, base, off = b.value
        width = np.int64(1) << 44
        key = length * width + first
        for x in batches:
            n = x.column(3).to_numpy(zero_copy_only=False)
            rank = x.column(len(keep)).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, n * width + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array(base[i] + rank - first[i]), pa.array(off[i])], [*keep, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    return map_arrow(ranked, place, schema)


def op3(docs: DataFrame, **options) -> DataFrame:
    return pack(docs, **options)


stage = pack
