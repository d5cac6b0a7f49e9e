"""Near duplicates by circulant MinHash, banding and exact verification.

Two permutations make all signature coordinates: the first places a shingle in the universe, the second, shifted
circularly by k, ranks it for coordinate k. So a shingle's K ranks are one contiguous slice of a table, and a text's
signature is the minimum over slices. Signatures are cut into bands; texts that share a band value are candidates, and
every reported link is confirmed on the full shingle sets.

Texts with equal sets form a class, and only its smallest id goes on. Groups are never expanded into all pairs: in each
band bucket the members are first held against one hub (a star), links join components, and further stars with other
hubs follow only where a bucket still holds several components. What is left open after ``star_rounds`` is settled
exactly: the members outside a bucket's largest component go against all others, as pairs in small buckets and block by
block with a sparse product in large ones. Pairs
within a component need no test. With 64 bands of 8 rows a pair at exactly 0.8 is missed with probability below 1e-5.

Edge cases: null or empty texts, or ones of white space alone, have no shingles, link with nothing and are their own
component; a null id takes no part in linking (null component, kept false; the pipeline stage retains such rows); rows
that repeat an id are one node; a very long text is shingled whole; an empty table gives no rows; op8 looks at doc_id and
text alone, and the stage hands all other columns, whatever their names, through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.text import chunks, column, mix, shingles, text_only
from tessera.session import importable, map_arrow, own_name, stored, trim

BANDS, ROWS, UNIVERSE = 64, 8, 1 << 20
K = BANDS * ROWS
WORDS = 8
_tables: dict[int, np.ndarray] = {}


def _ranks(seed: int) -> np.ndarray:
    """The second permutation, with its first K entries repeated at the end, as (universe, K) windows."""
    if seed not in _tables:
        p = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
        _tables[seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: K - 1]]), K)
    return _tables[seed]


def signatures(h: np.ndarray, off: np.ndarray, seed: int = 11, block: int = 256) -> np.ndarray:
    """(rows, K) circulant MinHash values of shingle hashes; rows without shingles hold the maximum."""
    t = _ranks(seed)
    first = ((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(44)).astype(np.int64)  # the first permutation, to 20 bits
    out = np.full((len(off) - 1, K), np.uint32(0xFFFFFFFF))
    for r in range(len(off) - 1):
        for a in range(off[r], off[r + 1], block):  # blocks that stay in the processor's cache
            np.minimum(out[r], t[first[a : min(a + block, off[r + 1])]].min(axis=0), out=out[r])
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit values, different between bands."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    acc = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019), (len(sig), 1))
    for i in range(ROWS):
        acc = mix(acc ^ (s[:, :, i] + np.uint64((i + 1) * 0xD6E8FEB86659FD93 % (1 << 64))))
    return acc


def occupancy(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, WORDS) 64-bit words: which of 64 * WORDS cells a set's shingles fall in. A cell that only one of two sets
    occupies holds a shingle of that set alone, so these words bound an intersection from above."""
    cells = np.zeros((len(off) - 1, 64 * WORDS), np.uint8)
    cells[np.repeat(np.arange(len(off) - 1), np.diff(off)), (mix(h ^ np.uint64(5)) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(cells, axis=1).view(np.int64)


def may_link(n, bits, m, other, percent: int):
    """Column: false only where sizes and occupancies prove that two sets are below the similarity."""
    alone = lambda a, b: sum((F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(WORDS)), F.lit(0))
    both = F.least(n - alone(bits, other), m - alone(other, bits))
    return 100 * both >= percent * (n + m - both)


def profile(docs: DataFrame, words: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (a 128-bit digest of the set) bits (occupancy) and bands (64 values; empty without shingles)."""

    def run(batches):
        for b in batches:
            buf, off = column(b.column(1))
            for i, j in chunks(off, 1 << 19):
                h, o = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], words)
                n = np.diff(o)
                c1, c2 = (np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(k)))]) for k in (1, 2))
                bands = band_values(signatures(h, o, seed)).view(np.int64)
                some = n > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(bands[some].ravel()))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * WORDS), pa.array(occupancy(h, o).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array((c1[o[1:]] - c1[o[:-1]]).view(np.int64)), pa.array((c2[o[1:]] - c2[o[:-1]]).view(np.int64)), bits, lists], ["doc_id", "n_shingles", "s1", "s2", "bits", "bands"])

    return map_arrow(text_only(docs), run, "doc_id long, n_shingles long, s1 long, s2 long, bits array<long>, bands array<long>")


def _overlaps(big: np.ndarray, h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Size of each row's intersection with one sorted set."""
    at = np.searchsorted(big, h)
    np.minimum(at, len(big) - 1, out=at)
    c = np.concatenate([[0], np.cumsum(big[at] == h)])
    return c[off[1:]] - c[off[:-1]]


def verify(pairs: DataFrame, texts: DataFrame, words: int = 2, percent: int = 80, per_task: int = 256) -> DataFrame:
    """The pairs(id, hub) whose full sets reach the similarity. Members travel to their hub in salted groups of about
    ``per_task``; a task streams them and holds one hub set."""
    many = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select(F.col("hub").alias("h"), F.ceil(F.col("n") / per_task).cast("int").alias("parts"))
    hot = _if_small(stored(many.where("parts > 1").select(F.col("h").alias("of"), F.col("parts").alias("lanes")), "hot-hubs"))  # one row for per_task pairs at least
    p = pairs.join(hot, pairs.hub == hot.of, "left").select("id", "hub", F.pmod(F.xxhash64("id"), F.coalesce("lanes", F.lit(1))).cast("int").alias("part"))
    t = texts.select(F.col("doc_id").alias("d"), "text")
    members = p.join(t, p.id == t.d).select("hub", "part", F.lit(1).alias("role"), "id", "text")
    hubs = many.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(t, F.col("h") == F.col("d")).select(F.col("h").alias("hub"), "part", F.lit(0).alias("role"), F.col("h").alias("id"), "text")
    spread = members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def run(batches):
        hub, sets = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key, part, role, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            h, off = shingles(*column(b.column(4)), words)
            n = np.diff(off)
            lead = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            hit = np.zeros(len(key), bool)
            for a, z in zip(lead, np.append(lead[1:], len(key)), strict=True):
                if (key[a], part[a]) != hub:
                    hub, sets = (key[a], part[a]), []
                while a < z and role[a] == 0:
                    sets.append(h[off[a] : off[a + 1]].copy())
                    a += 1
                for s in sets:
                    if a < z and len(s):
                        both = _overlaps(s, h[off[a] : off[z]], off[a : z + 1] - off[a])
                        hit[a:z] |= (100 * both >= percent * (n[a:z] + len(s) - both)) & (n[a:z] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(key[hit])], ["a", "b"])

    return map_arrow(spread, run, "a long, b long")


def block_pairs(members: DataFrame, texts: DataFrame, words: int = 2, percent: int = 80, block: int = 256) -> DataFrame:
    """All links across components within large buckets (bh, id, n, component, main), without emitting pairs. Every such
    pair has a member outside the bucket's main component, so members too large or too small for any of those stay out, and blocks of about ``block`` of those meet blocks of all
    members; each two blocks are one group, and a sparse product over the shingles in both counts every intersection."""
    outside = F.col("component") != F.col("main")
    span = _if_small(stored(members.where(outside).groupBy(F.col("bh").alias("s")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "spans"))
    fits = (F.col("bh") == F.col("s")) & (100 * F.col("n") >= percent * F.col("lo")) & (percent * F.col("n") <= 100 * F.col("hi"))
    members = stored(members.join(span, fits, "left_semi"), "blocks")
    size = members.groupBy("bh").agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("k"))
    size = _if_small(stored(size.select(F.col("bh").alias("b"), F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("k") / block).cast("int").alias("lanes")), "sizes"))
    m = members.join(size, members.bh == size.b)
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    outer = m.where("component <> main").select("bh", place("lanes").alias("x"), every("blocks").alias("y"), F.lit(0).alias("side"), "id", "component")
    whole = m.select("bh", every("lanes").alias("x"), place("blocks").alias("y"), F.lit(1).alias("side"), "id", "component")
    t = texts.select(F.col("doc_id").alias("d"), "text")
    m = outer.unionByName(whole)
    rows = m.join(t, m.id == t.d).select("bh", "x", "y", "side", "id", "component", "text")

    def run(batches):
        import pandas as pd

        pdf = pd.concat([b.to_pandas() for b in batches])
        h, off = shingles(*column(pa.array(pdf.text, pa.string())), words)
        n, ids, comp, side = np.diff(off), pdf.id.to_numpy(), pdf.component.to_numpy(), pdf.side.to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        both = np.zeros((len(left), len(right)), np.float32)
        u, inv = np.unique(h, return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        often = np.bincount(inv, minlength=len(u)) > 1
        rank = np.cumsum(often) - 1
        place = np.full(len(n), -1)
        for a in range(0, int(often.sum()), 8192):
            use = often[inv] & (rank[inv] >= a) & (rank[inv] < a + 8192)
            d = [np.zeros((len(s), 8192), np.float32) for s in (left, right)]
            for s, z in zip((left, right), d, strict=True):
                place[:] = -1
                place[s] = np.arange(len(s))
                k = use & (place[row] >= 0)
                z[place[row[k]], rank[inv[k]] - a] = 1
            both += d[0] @ d[1].T
        both = both.astype(np.int64)
        ok = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        r, c = np.nonzero(ok)
        if len(r):  # one link for each two components is enough to join them
            _, one = np.unique(np.sort(np.column_stack([comp[left[r]], comp[right[c]]]), axis=1), axis=0, return_index=True)
            r, c = r[one], c[one]
        yield pa.RecordBatch.from_arrays([pa.array(ids[left[r]]), pa.array(ids[right[c]])], ["a", "b"])

    def group(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(run([x for x in table.to_batches() if x.num_rows]), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        trim()
        return out

    importable(rows.sparkSession)
    return rows.groupBy("bh", "x", "y").applyInArrow(group, "a long, b long")


def _if_small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast where it has at most ``most`` rows, so that what it is joined to stays
    where it is and no large bucket meets in one task; else to be joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, star_rounds: int = 3, large: int = 64, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    slim = text_only(docs)
    prof = stored(profile(slim, words, seed), "profile")
    live = prof.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(live.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    c = classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), "rep")
    reps = live.join(c, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    banded = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bh"))
    hubs = banded.groupBy("bh").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").select(F.col("bh").alias("k"), "hub")
    members = stored(banded.join(hubs, banded.bh == hubs.k).select("bh", "id", "n", "hub"), "buckets")
    pairs = stored(members.where("id <> hub").select("id", "hub").distinct(), "pairs")
    wanted = members.select(F.col("id").alias("w")).distinct()
    texts = stored(slim.join(wanted, slim.doc_id == wanted.w, "left_semi"), "candidates")
    links = verify(pairs, texts, words, percent)
    comp = components(links)
    tried, buckets = pairs, members.drop("hub")
    for r in range(1, star_rounds + 2):
        cc = comp.select(F.col("id").alias("x"), "component")
        m = buckets.join(cc, buckets.id == cc.x, "left").select("bh", "id", "n", F.coalesce("component", "id").alias("component"))
        mixed = m.groupBy("bh").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("o"), F.col("id").alias("hub"), F.col("component").alias("hc"), F.col("n").alias("hn"))).alias("h"))
        mixed = mixed.where("lo <> hi").select(F.col("bh").alias("k"), "size", "h.hub", "h.hc", "h.hn")
        m = m.join(mixed, m.bh == mixed.k)
        if r <= star_rounds:
            new = m.where((F.col("component") != F.col("hc")) & (100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")))
            new = new.select(F.greatest("id", "hub").alias("id"), F.least("id", "hub").alias("hub")).distinct()
            new = stored(new.join(tried, ["id", "hub"], "left_anti"), "pairs")
            fresh = verify(new, texts, words, percent)
            tried = tried.unionByName(new)
            none = not new.limit(1).count()
        else:
            rest = stored(m.select("bh", "id", "n", "component", "size"), "open")
            part = rest.groupBy("bh", "component").agg(F.count(F.lit(1)).alias("c"))
            main = part.groupBy("bh").agg(F.max(F.struct("c", "component")).alias("m"))
            main = stored(main.select(F.col("bh").alias("b"), F.col("m.component").alias("main")), "main")
            rest = stored(rest.join(_if_small(main), rest.bh == main.b).drop("b"), "open-by-main")
            few, big = rest.where(F.col("size") <= large), rest.where(F.col("size") > large)
            cells = live.select(F.col("doc_id").alias("of"), "bits")
            few = few.join(cells, few.id == cells.of)
            o = few.where("component <> main").select(F.col("bh").alias("bo"), F.col("id").alias("io"), F.col("n").alias("no"), F.col("component").alias("co"), F.col("bits").alias("other"))
            new = few.join(o, (few.bh == o.bo) & (F.col("component") != F.col("co")) & may_link(F.col("n"), F.col("bits"), F.col("no"), F.col("other"), percent))
            new = new.select(F.greatest("id", "io").alias("id"), F.least("id", "io").alias("hub"))
            new = stored(new.select("id", "hub").distinct().join(tried, ["id", "hub"], "left_anti"), "pairs")
            fresh = verify(new, texts, words, percent)
            if big.limit(1).count():
                fresh = fresh.unionByName(block_pairs(big.select("bh", "id", "n", "component", "main"), texts, words, percent))
            none = False
        if not none:
            star = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
            fresh = stored(fresh, "links")
            if fresh.limit(1).count():
                comp = components(star.unionByName(fresh))
    cc = comp.select(F.col("id").alias("x"), "component")
    final = classes.join(cc, classes.rep == cc.x, "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), F.coalesce("component", "rep").alias("component"))
    p = prof.drop("bands", "bits")
    out = p.join(final, (p.s1 == final.c1) & (p.s2 == final.c2) & (p.n_shingles == final.cn), "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op8(docs: DataFrame, **options) -> DataFrame:
    return near_duplicates(docs, **options)


def stage(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, the one with the smallest id; documents without an id or without words stay.
    Where an id comes again its rows are told apart: of a group, the first by id, text hash and the other columns stays."""
    twice = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count()
    row, gone_ = own_name(docs, "row", "gone")
    if not twice:
        gone = near_duplicates(docs, words, percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(gone_))
        return docs.join(gone, F.col("doc_id") == F.col(gone_), "left_anti")
    order = ["doc_id", F.sha2("text", 256), F.xxhash64(*docs.columns)]
    rows = docs.where("doc_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn(row, F.monotonically_increasing_id()), "rows")  # ranges come in order, so do their numbers
    gone = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).where(~F.col("kept")).select(F.col("doc_id").alias(gone_))
    out = rows.join(gone, F.col(row) == F.col(gone_), "left_anti").drop(row)
    return out.unionByName(docs.where("doc_id is null"))
