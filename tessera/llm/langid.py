"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled: the text is cut into windows, a gated recurrent layer runs over each window in both
directions, and a softmax over both states gives each position its language probabilities. A document's probabilities
are the mean over its positions. The network is trained in numpy by backpropagation through time on a bounded sample
(``per_lang`` windows of each language, drawn by id hash and position hash). Every learnable language is learned, so the
driver's time and memory grow with their number.

Cell, for state h, byte embedding e: g = hard_sigmoid(Ug h + Wg e + bg), c = hard_tanh(Uc h + Wc e + bc), h' = c + g (h - c).

Edge cases: null text or a text without a letter gives ``und`` with score 0; a table without labelled text gives
``und`` for all; null lang rows are never learned from; ties between languages go to the first in sorted order; rows that
repeat an id are labelled each by its text; a very long text is read whole, window by window; an empty table gives no rows;
op1 looks at no other columns, and the stage hands all columns, whatever their names, through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.text import chunks, column, held_out, learnable
from tessera.session import map_arrow, own_name

T, H, E = 64, 10, 6


class Net:
    """Parameters of both directions and the output layer."""

    def __init__(self, langs: list[str], seed: int = 1):
        r = np.random.default_rng(seed)
        self.langs = langs
        n = len(langs)
        self.emb = r.normal(0, 0.5, (E, 256)).astype(np.float32)
        self.m = [r.normal(0, 0.35, (2 * H, H + E + 1)).astype(np.float32) for _ in range(2)]
        for m in self.m:
            m[:H, -1] = 1.5  # gates start open to memory
            m[H:, -1] = 0
        self.out = r.normal(0, 0.3, (n, 2 * H + 1)).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.m, self.out]

    def states(self, x: np.ndarray, keep: bool = False):
        """x: bytes (T, B). States of both directions at every position, (2H, T, B)."""
        t, n = x.shape
        e = self.emb[:, x]
        hs = np.empty((2 * H, t, n), np.float32)
        kept = []
        s = np.empty((H + E + 1, n), np.float32)
        z = np.empty((2 * H, n), np.float32)
        for d in range(2):
            m, mine = self.m[d], []
            s[:H] = 0
            s[-1] = 1
            h = s[:H]
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                s[H : H + E] = e[:, k]
                np.matmul(m, s, out=z)
                g, c = z[:H], z[H:]
                if keep:
                    mine.append((s.copy(), z.copy()))
                g *= 0.25
                g += 0.5
                np.maximum(g, 0, out=g)
                np.minimum(g, 1, out=g)
                np.maximum(c, -1, out=c)
                np.minimum(c, 1, out=c)
                h -= c
                h *= g
                h += c
                hs[d * H : (d + 1) * H, k] = h
            kept.append(mine)
        return (hs, kept) if keep else hs

    def probabilities(self, hs: np.ndarray) -> np.ndarray:
        """(langs, T, B), one distribution a position."""
        f = hs.reshape(2 * H, -1)
        z = self.out[:, :-1] @ f
        z += self.out[:, -1:]
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z.reshape(len(self.langs), *hs.shape[1:])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        t, n = x.shape
        hs, kept = self.states(x, keep=True)
        p = self.probabilities(hs)
        loss = float(-np.log(np.maximum(p[y, :, np.arange(n)], 1e-9)).mean())
        dz = p
        dz[y, :, np.arange(n)] -= 1
        dz /= t * n
        flat = dz.reshape(len(self.langs), -1)
        f = hs.reshape(2 * H, -1)
        g_out = np.concatenate([flat @ f.T, flat.sum(1, keepdims=True)], 1)
        dh_out = (self.out[:, :-1].T @ flat).reshape(2 * H, t, n)
        g_emb = np.zeros_like(self.emb)
        g_m = [np.zeros_like(m) for m in self.m]
        for d in range(2):
            m, dh = self.m[d], np.zeros((H, n), np.float32)
            order = range(t) if d == 0 else range(t - 1, -1, -1)
            for k, (s, z) in reversed(list(zip(order, kept[d], strict=True))):
                dh += dh_out[d * H : (d + 1) * H, k]
                ga, ca = z[:H] * 0.25 + 0.5, z[H:]
                g, c = np.clip(ga, 0, 1), np.clip(ca, -1, 1)
                dzz = np.empty_like(z)
                dzz[:H] = dh * (s[:H] - c) * 0.25 * ((ga > 0) & (ga < 1))
                dzz[H:] = dh * (1 - g) * ((ca > -1) & (ca < 1))
                g_m[d] += dzz @ s.T
                back = m.T @ dzz
                for i in range(E):
                    g_emb[i] += np.bincount(x[k], back[H + i], 256)
                dh = dh * g + back[:H]
        return loss, [g_emb, *g_m, g_out]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, seed: int = 2) -> Net:
        """Adam with a decaying step and clipped gradients. x: windows (N, T), y: language index."""
        r = np.random.default_rng(seed)
        ps = self.params()
        m1, m2 = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            o = r.permutation(len(x))
            for a in range(0, len(o), batch):
                i = o[a : a + batch]
                _, gs = self.gradients(np.ascontiguousarray(x[i].T), y[i])
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in gs))
                lr = rate * (1 - step / (steps + 1)) * min(1.0, 1.0 / max(norm, 1e-6)) if norm > 1 else rate * (1 - step / (steps + 1))
                for p, g, a1, a2 in zip(ps, gs, m1, m2, strict=True):
                    a1 *= 0.9
                    a1 += 0.1 * g
                    a2 *= 0.99
                    a2 += 0.01 * g * g
                    p -= (lr * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, b: np.ndarray, off: np.ndarray, columns: int = 2048) -> np.ndarray:
        """Pooled probabilities (rows, langs) over every byte of every text; an empty text has zeros."""
        n = np.diff(off)
        k = np.maximum(-(-n // T), (n > 0).astype(np.int64))
        row = np.repeat(np.arange(len(n)), k)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        start = np.minimum(nth * T, np.maximum(n[row] - T, 0))  # the last window reaches back, its old positions don't count
        fresh, most = nth * T - start, np.minimum(n[row], T)
        total = np.zeros((len(n), len(self.langs)))
        pos = np.arange(T)[:, None]
        for a in range(0, len(row), columns):
            s = slice(a, a + columns)
            at = pos + (off[row[s]] + start[s])[None, :]
            np.minimum(at, len(b) - 1, out=at)
            x = b[at]
            short = pos >= most[s][None, :]
            x[short] = 32
            p = self.probabilities(self.states(x))
            p *= (pos >= fresh[s][None, :]) & ~short
            sums = p.sum(1)
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(row[s], sums[j], len(n))
        return total / np.maximum(n, 1)[:, None]


def sample_windows(docs: DataFrame, per_lang: int, seed: int) -> list[tuple[str, bytes]]:
    """About ``per_lang`` windows of each language from learnable rows: a bounded training sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.2 * per_lang / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    each = -(-per_lang // max(1, min(counts.values()))) if min(counts.values()) < per_lang else 1
    picks = F.explode(F.sequence(F.lit(0), F.lit(min(each, 8) - 1)))
    rows = rows.where(u < F.try_element_at(rate, F.col("lang"))).select("doc_id", "lang", "text", picks.alias("k"))
    at = F.pmod(F.xxhash64("doc_id", "k", F.lit(seed + 1)), F.greatest(F.length("text") - T, F.lit(1)).cast("long")).cast("int") + 1
    cut = rows.select("lang", "doc_id", "k", F.substring(F.col("text"), at, F.lit(T)).alias("w")).orderBy("lang", "doc_id", "k").limit(10 * per_lang * len(counts))
    seen: dict[str, int] = {}
    out = []
    for r in cut.collect():
        if seen.get(r.lang, 0) < 4 * per_lang:
            seen[r.lang] = seen.get(r.lang, 0) + 1
            out.append((r.lang, r.w.encode()[:T].ljust(T, b" ")))
    return out


def train(docs: DataFrame, per_lang: int = 900, epochs: int = 12, seed: int = 7) -> Net | None:
    """Languages weigh alike: a rarer one's windows are repeated."""
    got = sample_windows(docs, per_lang, seed)
    if not got:
        return None
    langs = sorted({lang for lang, _ in got})
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, T)
    y = np.array([langs.index(lang) for lang, _ in got])
    r = np.random.default_rng(seed)
    pick = np.concatenate([r.choice(np.flatnonzero(y == i), per_lang) for i in range(len(langs))])
    return Net(langs, seed).fit(x[pick], y[pick], epochs)


def identify(docs: DataFrame, net: Net | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and the score (its pooled probability) under ``names``, in place of columns of these
    names; other columns stay."""
    extra = [c for c in docs.columns if c.lower() not in names]
    letter_, = own_name(docs, "letter")
    src = docs.select(*extra).withColumn(letter_, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*src.drop(letter_).schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    at, letter = src.columns.index("text"), len(src.columns) - 1

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            if net is not None and n:
                b, off = column(batch.column(at))
                ok = batch.column(letter).to_numpy(zero_copy_only=False).astype(bool)
                for i, j in chunks(off, 1 << 20):
                    p = net.documents(b[off[i] : off[j]], off[i : j + 1] - off[i])
                    best = p.argmax(1)
                    pred[i:j] = np.array(net.langs, object)[best]
                    score[i:j] = np.clip(p[np.arange(j - i), best], 0, 1)
                pred[~ok], score[~ok] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(letter)], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:letter], *names])

    return map_arrow(src, run, schema)


def op1(docs: DataFrame, **train_options) -> DataFrame:
    net = train(docs, **train_options)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return identify(slim, net).select("doc_id", "held_out", "lang_pred", "score")


def stage(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """Keeps the documents in a known language: rejected are ``und`` and those whose best language has less than ``min_score``."""
    pred, score = own_name(docs, "lang_pred", "score")
    return identify(docs, train(docs), (pred, score)).where((F.col(pred) != "und") & (F.col(score) >= min_score)).drop(pred, score)
