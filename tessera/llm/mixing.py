"""Mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by hash and laid end to end for ``most`` rounds; an item (document, round) finishes
at the virtual time (source words up to and with it) / target, its j-th word at (source words up to and with that word) /
target. What is taken is decided by one global order, that of the words by virtual finish time, cut off at the total
budget (the whole words in the targets). To find that cut without a row for every word, the items are range-sorted by
virtual finish time with running sums of their words. An item far enough before the budget that not even all items in
service together reach it is taken whole; an item that starts after the order has used up the budget isn't taken. Only the items
between, a few for each source, are laid out word by word, range-sorted again and truncated at what is left of the budget.

Running sums never gather a source in one task: rows fall into small hash buckets within their source, and sums over
buckets and over groups of buckets give each bucket its start. Range-sorted rows get global positions by range.

Edge cases: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in order;
null and repeated ids are separate rows (of rows alike in id, size and text, either may come first); a very long text is
counted whole; an empty table gives no rows; if all sizes are 0 every target is 0; extra columns, whatever their names,
aren't looked at by op7 and are handed through by the stage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import chunks, column, word_counts, words
from tessera.session import map_arrow, own_name, stored

CYCLE = (5, 2, 1)
FAN = 1024


def targets(sizes: dict[str | None, int], share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> dict[str | None, float]:
    """Shares of ``share`` times all words by weight, none above ``most`` times its source; excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row (a number of its own, or the column named), doc_id, source, h (text hash) and size, written once."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"), *([F.col(row).alias("row")] if row else []))

    def run(batches):
        for b in batches:
            buf, off = column(b.column(3))
            n = [word_counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
            n = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n, *b.columns[4:]], ["doc_id", "source", "h", "size", *["row"] * bool(row)])

    out = map_arrow(src, run, "doc_id long, source string, h long, size long" + ", row long" * bool(row))
    return stored(out if row else out.withColumn("row", F.monotonically_increasing_id()), "sizes")


def positioned(d: DataFrame, keys: list[str], words_: str, parts: int) -> DataFrame:
    """``d`` range-sorted by ``keys``, written, with position: the sum of ``words_`` over all rows before."""
    spark = d.sparkSession
    at = d.columns.index(words_)

    def running(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            w = b.column(at).to_numpy(zero_copy_only=False)
            c = np.cumsum(w) - w + done
            done += int(w.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(c)], names)

    names = [*d.columns, "part", "before"]
    schema = T.StructType([*d.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    flat = d.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = stored(map_arrow(flat, running, schema), "mix")
    base, total = [], 0
    for r in ordered.groupBy("part").agg(F.sum(words_).alias("w")).orderBy("part").collect():  # one row a range
        base.append((r.part, total))
        total += r.w
    b = F.broadcast(spark.createDataFrame(base, "of int, base long"))  # 12 bytes a range
    return ordered.join(b, ordered.part == b.of).withColumn("position", F.col("before") + F.col("base")).drop("part", "of", "base", "before")


def schedule(rows: DataFrame, share: float = 1.5, most: int = 2, seed: int = 5, per_bucket: int = 512, per_range: int = 200_000) -> DataFrame:
    """rows(row, doc_id, source, h, size) to items in mixing order: row, doc_id, source, size, source_size, target, round, start and finish
    (virtual times), position (words taken from items before), words (taken). Items that aren't reached have 0 words."""
    spark = rows.sparkSession
    total, n, longest = {}, 0, {}
    for r in rows.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).collect():  # one row a source
        total[r.source], longest[r.source] = r.s, r.m
        n += r.n
    goal = targets(total, share, most)
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    per = spark.createDataFrame([(s, i, total[s], float(goal[s])) for i, s in enumerate(order)], "src string, sid int, source_size long, target double")
    per = F.broadcast(per) if len(order) <= 100_000 else per
    buckets = max(1, -(-n // per_bucket))
    u = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 52))
    d = rows.join(per, rows.source.eqNullSafe(F.col("src"))).drop("src").withColumn("u", u).withColumn("bucket", F.floor(F.col("u") / float(1 << 52) * buckets).cast("long"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("s")).withColumn("fan", F.floor(F.col("bucket") / FAN))
    fans = sums.groupBy("sid", "fan").agg(F.sum("s").alias("fs"))
    before = lambda c, part, o: F.coalesce(F.sum(c).over(W.partitionBy(*part).orderBy(o).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fans = fans.select(F.col("sid").alias("fsid"), F.col("fan").alias("ffan"), before("fs", ["sid"], "fan").alias("f0"))
    start = sums.withColumn("b0", before("s", ["sid", "fan"], "bucket")).join(fans, (F.col("sid") == F.col("fsid")) & (F.col("fan") == F.col("ffan")))
    start = start.select(F.col("sid").alias("bsid"), F.col("bucket").alias("bb"), (F.col("b0") + F.col("f0")).alias("base"))
    inner = W.partitionBy("sid", "bucket").orderBy("u", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("c0", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(start, (d.sid == F.col("bsid")) & (d.bucket == F.col("bb"))).withColumn("c0", F.col("c0") + F.col("base"))
    d = d.select("row", "doc_id", "source", "size", "source_size", "target", "sid", "u", "c0", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round"))
    d = d.withColumn("begun", F.col("c0") + F.col("source_size") * F.col("round")).drop("c0")
    time = lambda w: F.when(F.col("target") > 0, w / F.col("target")).otherwise(F.lit(float("inf")))
    d = d.withColumns({"start": time(F.col("begun")), "finish": time(F.col("begun") + F.col("size"))})
    keys = ["finish", "sid", "round", "u", "row"]
    items = positioned(d, keys, "size", max(1, -(-n * most // per_range)))
    budget = sum(int(g) for g in goal.values())
    slack = sum(longest.values())  # what the items in service at one time hold together, at most
    sure = F.col("position") + F.col("size") + slack <= budget
    whole = items.where(sure).withColumn("words", F.col("size"))
    rest = items.where(~sure)
    # by the finish of the item in which the running sum reaches the budget, so many words have finished
    end = rest.where(F.col("position") + F.col("size") >= budget).agg(F.min("finish")).collect()[0][0]
    begins = rest.agg(F.min("position")).collect()[0][0]
    if end is None or end == float("inf"):
        end = 1e300
    near = rest.where((F.col("start") < end) & (F.col("size") > 0)).drop("position")
    each = near.select("sid", "round", "u", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))).alias("j"), "begun", "target")
    each = each.select("sid", "round", "u", "row", "j", ((F.col("begun") + F.col("j")) / F.col("target")).alias("finish"), F.lit(1).cast("long").alias("one")).where(F.col("finish") <= end)
    each = positioned(each, ["finish", "sid", "round", "u", "row", "j"], "one", max(1, -(-3 * slack // (5 * per_range))))
    served = each.where(F.col("position") < budget - (begins or 0)).groupBy(F.col("row").alias("r"), F.col("round").alias("rr")).agg(F.count(F.lit(1)).alias("words"))
    cut = near.join(served, (near.row == served.r) & (near["round"] == served.rr)).drop("r", "rr")
    cut = positioned(cut, keys, "words", 1 + len(order) // per_range)
    cut = cut.select(F.col("row").alias("r"), F.col("round").alias("rr"), "words", (F.col("position") + F.lit(begins or 0)).alias("at"))
    tail = rest.join(cut, (rest.row == F.col("r")) & (rest["round"] == F.col("rr")), "left").drop("r", "rr")
    tail = tail.withColumns({"words": F.coalesce("words", F.lit(0)), "position": F.coalesce("at", "position")}).drop("at")
    return whole.unionByName(tail).drop("sid", "u", "begun")


def taken(docs_rows: DataFrame, **options) -> DataFrame:
    """One row a document: row, doc_id, size, source_size, target, taken."""
    items = schedule(docs_rows, **options)
    return items.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("words").alias("taken"))


def op7(docs: DataFrame, **options) -> DataFrame:
    return taken(sized(docs), **options).select("doc_id", "size", "source_size", "target", "taken")


def stage(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a document comes as often as it is taken whole; the one in service at the cut comes with its first
    words only (n_chars follows). A document that isn't reached goes. Columns stay those of ``docs``."""
    cols, schema = docs.columns, docs.schema
    at = cols.index("text")
    chars = cols.index("n_chars") if "n_chars" in cols else -1
    row, r, whole_, rest_, part_ = own_name(docs, "row", "r", "whole", "rest", "part")
    whole = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    got = taken(sized(whole, row), **options)
    got = got.where("taken > 0").select(F.col("row").alias(r), F.floor(F.col("taken") / F.col("size")).alias(whole_), (F.col("taken") % F.col("size")).alias(rest_))
    joined = whole.join(got, F.col(row) == F.col(r))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col(whole_).cast("int")), F.when(F.col(rest_) > 0, F.array(F.col(rest_))).otherwise(F.array().cast("array<long>")))
    out = joined.select(*cols, F.explode(copies).alias(part_))

    def cut(batches):
        for b in batches:
            part = b.column(len(cols)).to_numpy(zero_copy_only=False)
            arrays = list(b.columns[: len(cols)])
            k = np.flatnonzero(part >= 0)
            if len(k):
                texts = arrays[at].to_pylist()
                n = arrays[chars].to_pylist() if chars >= 0 else None
                for i in k:
                    raw = texts[i].encode()
                    buf = np.frombuffer(raw, np.uint8)
                    texts[i] = raw[: words(buf, np.array([0, len(buf)]))[1][part[i] - 1]].decode()
                    if n is not None:
                        n[i] = len(texts[i])
                arrays[at] = pa.array(texts, arrays[at].type)
                if n is not None:
                    arrays[chars] = pa.array(n, arrays[chars].type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return map_arrow(out, cut, schema)
