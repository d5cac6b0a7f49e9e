import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import fingerprint, mixing, secrets, topk
from tessera.llm.text import column

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, part int, size long, h long, key long"


def make(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, 1, 1, 1, 1, 1) for d, t, s in rows], DOCS)


# --- fingerprints


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoé") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_entropy_is_exact():
    b = np.frombuffer(prose(random.Random(1), 400).encode(), np.uint8)
    got = fingerprint.entropy_buckets(b)
    for i in (0, 1, 63, 500, len(b) - 64):
        c = np.bincount(b[i : i + 64])
        p = c[c > 0] / 64
        assert abs(got[i] - 1000 * -(p * np.log2(p)).sum() / 6) <= 1.01


@pytest.mark.parametrize("part_bytes", [1 << 24, 4000])
def test_op4(spark, part_bytes):
    r = random.Random(4)
    rows = [(i * 3 % 101, prose(r, r.choice([0, 1, 5, 30, 300])), "a") for i in range(80)]
    rows += [(500, None, "a"), (501, rows[3][1], "a"), (502, "x" * 5000, "a"), (None, "no id here", "a"), (600, prose(r, 3000), "a")]
    out = fingerprint.op4(make(spark, rows).repartition(4), part_bytes=part_bytes).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda x: -(1 << 63) if x[0] is None else x[0], reverse=True)
    by = {x.doc_id: x for x in out}
    near = []
    for (d, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        assert by[d].n_chars == len(t)
        assert by[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest(), d
        if len(t) > 1000 and len(set(t)) > 1:
            near.append((by[d].near_edited, by[d].near_next))
        a, b = fingerprint.Digest.parse(by[d].fingerprint), fingerprint.Digest.parse(by[d].edited_fingerprint)
        assert a.text() == by[d].fingerprint and fingerprint.likeness(a, b) == by[d].near_edited
        assert 0 <= by[d].near_next <= 1
    assert by[501].fingerprint == by[rows[3][0]].fingerprint
    assert min(x for x, _ in near) > 0.4 and max(x for _, x in near) < 0.35


def test_op4_deals_one_hot_id_among_parts(spark):
    r = random.Random(9)
    rows = [(None if i % 2 else i, prose(r, 30), "a") for i in range(600)]
    df = make(spark, rows)
    dealt, n = fingerprint._dealt(fingerprint.text_only(df), 12)
    sizes = [x["count"] for x in dealt.where("doc_id is null and halo = 0").groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 100
    part = -(-sum(len(t) for _, t, _ in rows) // 12)
    out = fingerprint.op4(df, part_bytes=part).collect()
    assert len(out) == len(rows)
    order = sorted((x for x in rows if x[0] is not None), key=lambda x: -x[0])
    by = {x.doc_id: x for x in out if x.doc_id is not None}
    for (d, t, _), (_, nxt, _) in zip(order, order[1:], strict=False):
        k = len(t) // 3
        assert by[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    texts = sorted(len(t) for d, t, _ in rows if d is None)
    assert sorted(x.n_chars for x in out if x.doc_id is None) == texts
    # every row with the hot id is followed by another one, by the last of them the first row of all
    hot = [t for d, t, _ in rows if d is None]
    after = [*hot, order[0][1]]
    can = {hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest() for t in hot for o in after if o is not t}
    assert all(x.edited_sha256 in can for x in out if x.doc_id is None)


def test_op4_small(spark):
    assert fingerprint.op4(make(spark, [(1, "abc", "a")]).where("false")).count() == 0
    one = fingerprint.op4(make(spark, [(1, "abcdef", "a")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    assert fingerprint.likeness(fingerprint.Digest.parse("sd1:0::"), fingerprint.Digest.parse(one.fingerprint)) == 0.0


def test_texts_of_every_length_have_features():
    r = random.Random(8)
    texts = [prose(r, 200).encode()[:n] for n in range(1, 401) for _ in range(2)] + [b"x" * 5000]
    off = np.cumsum([0, *map(len, texts)])
    b = np.frombuffer(b"".join(texts), np.uint8)
    rank = fingerprint.rarity(np.bincount(fingerprint.entropy_buckets(b), minlength=fingerprint.BUCKETS))
    out = fingerprint.digests(b, off, rank)
    assert [len(t) for t, d in zip(texts, out, strict=True) if not len(d.counts)] == []
    for n in range(8, 401):
        x, y = 2 * n - 2, 2 * n - 1
        assert texts[x] != texts[y] and fingerprint.likeness(out[x], out[y]) < 0.5, n
    alone = [fingerprint.digests(np.frombuffer(t, np.uint8), np.array([0, len(t)]), rank)[0].text() for t in texts]
    assert alone == [d.text() for d in out]


# --- secrets


def brute_secrets(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    spans.sort()
    said = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in spans)
    return [sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(said.encode()).hexdigest(), said


def test_op6(spark):
    r = random.Random(5)
    bits = ["password", "Token", "API_KEY", "apikey", " = ", "=", ":", '"', "'", " ", "é", "日", "\n", "AKIA", "AKIA" + "X9" * 9, "f3" * 14, "0" * 23, "abc", "hunter2x", "ſecret", "toKen", "value", "x="]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14))), "a") for i in range(800)]
    rows += [(900, None, "a"), (901, "password = abcdef " * 5000, "a"), (None, "token: 'abcdefgh'", "a")]
    out = {x.doc_id: x for x in secrets.op6(make(spark, rows).repartition(3)).collect()}
    for d, t, _ in rows:
        n, digest, said = brute_secrets(t)
        x = out[d]
        assert [x.n_assign, x.n_access, x.n_hex] == n and x.base_sha256 == digest, t
        assert ",".join(s for s in x.spans.split(",") if not s.startswith("literal")) == said
    assert secrets.op6(make(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('db_pwd = "Zk93hqLw"', ["Zk93hqLw"]),
        ('base = "9fK2mQ7x"\nclient_credential: base + "Lp8Zt4Wn"', ["9fK2mQ7x", "Lp8Zt4Wn"]),
        ('{"privateKey": "MIIEvQIBADANBg9"}', ["MIIEvQIBADANBg9"]),
        ("export AUTH_CREDENTIAL=Qm9vb3RzMTIz", ["Qm9vb3RzMTIz"]),
        ('pwd_length = "12345678"', []),
        ('user_pwd = "changeme"', []),
        ('title = "Zk93hqLw8s"', []),
        ("the keys to this: nothing", []),
    ],
)
def test_assignments(text, want):
    raw = text.encode()
    assert [raw[a:z].decode() for a, z in secrets.literals(raw)] == want


def test_redaction(spark):
    rows = [(1, 'é token = "abcdefgh" rest', "a"), (2, "clean", "a"), (3, None, "a"), (4, "AKIA" + "B2" * 10 + " " + "0f" * 16, "a")]
    out = {x.doc_id: x for x in secrets.stage(make(spark, rows)).collect()}
    assert out[1].text == 'é token = "[SECRET]" rest' and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text) == ("clean", None, "[SECRET] [SECRET]")


@pytest.mark.parametrize("c", list("&!@#$%^*"))
def test_special_characters_in_quoted_secrets(spark, c):
    rows = [(1, f'password = "Tr0ub4dor{c}3xyz" rest', "a"), (2, 'password = "Tr0ub4dor3xyz"', "a")]
    found = {x.doc_id: x for x in secrets.op6(make(spark, rows)).collect()}
    assert found[1].spans == "assign:0:21,literal:12:26" and found[1].n_literal == 1
    assert found[2].spans == "assign:0:25" and found[2].n_literal == 0
    out = {x.doc_id: x.text for x in secrets.stage(make(spark, rows)).collect()}
    assert out == {1: 'password = "[SECRET]" rest', 2: 'password = "[SECRET]"'}


def test_no_literal_is_cut():
    r = random.Random(6)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2000))
    parts = [key[i : i + 50] for i in range(0, 2000, 50)]
    found = lambda t: [t[a:z] for a, z in secrets.literals(t.encode())]
    for text in (f'{{"privateKey": "{key}"}}', f"credentials = '{key}'", f"credentials = {key}", f"credentials{' ' * 300}={' ' * 300}{key}", f"{'a' * 300}_pwd = {key}"):
        assert found(text) == [key], text[:40]
    assert found("db_credential = " + " + ".join(f'"{p}"' for p in parts)) == parts
    chain = "part = ''\n" + "".join(f"part = part + '{p}'\n" for p in parts) + "db_credential = part"
    assert found(chain) == parts
    assert found("pwd = " + "x" * 2000) == found("pwd = '<" + key + ">'") == found(f"pwd = 'your_{key}'") == []
    assert found("a = 'Zk93hqLw'\n" + "a = a + a\n" * 3000 + "pwd = a") == ["Zk93hqLw"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('private_key = """\nMIIEvQIBADANBg9q2\nZz81kkPq\n"""', ["\nMIIEvQIBADANBg9q2\nZz81kkPq\n"]),
        ("db_pwd = '''Zk93hqLw8s'''", ["Zk93hqLw8s"]),
        ('db_pwd = b"Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('alpha = "9fK2mQ7x"\nbeta = "Lp8Zt4Wn"\nclient_credential = alpha+beta', ["9fK2mQ7x", "Lp8Zt4Wn"]),
        ('base = "9fK2mQ7x"\ndb_pwd = base+"Zk93"', ["9fK2mQ7x", "Zk93"]),
        ("client_credential = base\nbase = \"9fK2mQ7xLp\"", ["9fK2mQ7xLp"]),
        ("db_pwd = base+\"Zk93\"\nbase = \"9fK2mQ7x\"", ["Zk93", "9fK2mQ7x"]),
        ("private_key: |\n  -----BEGIN KEY-----\n  MIIEvQIBADANBg9q2\n  Zz81kkPqAb3\n  -----END KEY-----\nother: x", ["MIIEvQIBADANBg9q2", "Zz81kkPqAb3"]),
        ("<dbPassword>Zk93hqLw8s</dbPassword>", ["Zk93hqLw8s"]),
        ("<db:Pwd scope=\"x\"><![CDATA[Zk93hqLw8s]]></db:Pwd>", ["Zk93hqLw8s"]),
        ('<add key="DbPwd" value="Zk93hqLw8s"/>', ["Zk93hqLw8s"]),
        ("- name: DB_PWD\n  value: Zk93hqLw8s", ["Zk93hqLw8s"]),
        ('db_pwd = /* prod */ "Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('db_pwd:  # prod\n  "Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('# db_pwd = "Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('os.environ["DB_PWD"] = "Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('db_pwd: str = "Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('char db_pwd[] = "Zk93hqLw8s";', ["Zk93hqLw8s"]),
        ('db_pwd = x = "Zk93hqLw8s"', ["Zk93hqLw8s"]),
        ('db_pwd = ("Zk93h"\n   "qLw8sQ")', ["Zk93h", "qLw8sQ"]),
        ('db_pwd = os.getenv("DB_PASSWORD")', []),
        ("a = b\nb = a\ndb_pwd = a", []),
        ("client_credential: Zm9vYmFyMTIz=", ["Zm9vYmFyMTIz="]),
        ('client_signing = "Zx9Qw7Kp2Lm4"', ["Zx9Qw7Kp2Lm4"]),
    ],
)
def test_syntax(spark, text, want):
    raw = text.encode()
    assert [raw[a:z].decode() for a, z in secrets.literals(raw)] == want
    left = secrets.stage(make(spark, [(1, text, "a")])).collect()[0].text
    assert not any(w in left for w in want)


def test_lexer_time_is_in_proportion():
    import time

    for text in ("a" * 400_000, "a " + " " * 400_000, '"' + "a" * 400_000, "0." * 200_000, "a='b=\"" * 60_000, "x=" + "\\" * 400_000, "<a>" * 100_000, "<![CDATA[" * 40_000, "k: |\n" * 60_000, "x = /*" * 60_000, "a = (" * 60_000, 'p = """' * 60_000, "a: b" * 100_000, "a = b + " * 60_000, "a=" * 150_000, "k: |\n  x\n" * 40_000, "token = token + 'abc'\n" * 20_000):
        t0 = time.perf_counter()
        secrets.literals(text.encode())
        assert time.perf_counter() - t0 < 10, text[:20]


@pytest.mark.parametrize("name", ["client_access", "api_access", "accessSigning", "signing_client"])
def test_names_without_a_common_word(spark, name):
    rows = [(1, f'{name} = "Zk93hqLw8sQ"', "a"), (2, f'see pass and key, {name} = "Zk93hqLw8sQ"', "a")]
    assert [x.n_literal for x in secrets.op6(make(spark, rows)).collect()] == [1, 1]


def test_hints_reach_every_sensitive_part():
    assert all(any(h in s.encode() for h in secrets._HINTS) for s in secrets.SENSITIVE)


# --- mixing


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    t = {}
    while len(t) < len(names):
        left = 1.5 * sum(sizes.values()) - sum(t.values())
        rest = [s for s in names if s not in t]
        unit = left / sum(w[s] for s in rest)
        over = [s for s in rest if unit * w[s] > 2 * sizes[s]]
        t |= {s: 2 * sizes[s] for s in over} if over else {s: unit * w[s] for s in rest}
    return t


def mixed_rows(seed=0, n=700):
    r = random.Random(seed)
    rows = [(i, "wörd " * r.choice([0, 1, 3, 50, 400]), r.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(n)]
    return rows + [(n, None, "b"), (None, "x y", "c"), (None, "z", "zz"), (5, "dup", "a"), (n + 1, " \n", "only blank")]


def test_op7(spark):
    rows = mixed_rows()
    df = make(spark, rows).repartition(4)
    out = mixing.op7(df, per_bucket=20).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, src = {}, {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
        src.setdefault((d, count(t)), []).append(s)
    want = brute_targets(sizes)
    got = dict.fromkeys(sizes, 0)
    for x in out:
        s = next(s for s in src[(x.doc_id, x.size)] if sizes[s] == x.source_size)
        assert abs(x.target - want[s]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        got[s] += x.taken
    for s in sizes:
        assert int(want[s]) - 1 <= got[s] <= want[s] + 1e-6
    again = mixing.op7(make(spark, rows[::-1]).repartition(2), per_bucket=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.op7(df.where("false")).count() == 0


def test_schedule_order(spark):
    rows = mixed_rows(2, 300)
    items = mixing.schedule(mixing.sized(make(spark, rows)), per_bucket=16).orderBy("position", "finish").collect()
    served = [x for x in items if x.words]
    assert [x.position for x in served] == np.cumsum([0, *[x.words for x in served[:-1]]]).tolist()
    f = [x.finish for x in served]
    assert f == sorted(f) and all(x.words == x.size for x in served if x.finish <= 1)


def served_items(spark, rows, per_bucket=16):
    items = mixing.schedule(mixing.sized(make(spark, rows)), per_bucket=per_bucket).collect()
    assert len(items) == 2 * len(rows)
    return items


def test_words_are_served_as_by_a_priority_queue(spark):
    import heapq

    items = served_items(spark, mixed_rows(4, 250))
    goal = {x.source: x.target for x in items}
    names = sorted(s for s in goal if s is not None) + [None]
    lines = {s: sorted((x for x in items if x.source == s), key=lambda x: (x["round"], x.start)) for s in names}
    words = {s: [(x.row, x["round"]) for x in lines[s] for _ in range(x.size)] for s in names}
    heap = [(1 / goal[s], i, 0) for i, s in enumerate(names) if goal[s] > 0 and words[s]]
    heapq.heapify(heap)
    want = {}
    for _ in range(sum(int(g) for g in goal.values())):
        _, i, k = heapq.heappop(heap)
        s = names[i]
        want[words[s][k]] = want.get(words[s][k], 0) + 1
        if k + 1 < len(words[s]):
            heapq.heappush(heap, ((k + 2) / goal[s], i, k + 1))
    assert {(x.row, x["round"]): x.words for x in items if x.words} == want
    assert any(0 < x.words < x.size for x in items)


def test_another_order_takes_other_words(spark, monkeypatch):
    rows, plain = mixed_rows(4, 250), mixing.positioned
    want = {(x.row, x["round"]): x.words for x in served_items(spark, rows)}
    monkeypatch.setattr(mixing, "positioned", lambda d, keys, words, parts: plain(d, keys[1:], words, parts))
    got = {(x.row, x["round"]): x.words for x in served_items(spark, rows)}
    assert sum(got.values()) != sum(want.values()) or got != want


def test_mix_keeps_columns_of_any_name(spark):
    rows = mixed_rows(3, 60)
    df = make(spark, rows).selectExpr("*", "'a' as _row", "1 as r", "2 as whole", "3 as rest", "'b' as position", "4 as words", "5 as target")
    out = mixing.stage(df)
    assert out.columns == df.columns and out.count() > 0
    assert {(x._row, x.r, x.whole, x.rest, x.position, x.words, x.target) for x in out.collect()} == {("a", 1, 2, 3, "b", 4, 5)}


def test_mix_stage(spark):
    rows = mixed_rows(3, 200)
    df = make(spark, rows)
    out = mixing.stage(df)
    assert out.columns == df.columns
    n = sum(len(x.text.split()) for x in out.collect())
    want = brute_targets({s: sum(len((t or "").split()) for _, t, z in rows if z == s) for s in {r[2] for r in rows}})
    assert abs(n - sum(want.values())) < len(want) + 1


# --- products


@pytest.mark.parametrize("block", [4096, 3])
def test_op10(spark, block):
    r = np.random.default_rng(7)
    v = r.normal(0, 0.2, (900, 16)) * np.exp(r.normal(0, 0.5, (900, 1)))
    v[100:400] = v[100]  # a very common vector
    rows = [(i, [float(x) for x in np.float32(v[i])], 0, "x") for i in range(900)]
    rows += [(900, None, 0, "x"), (950, [None] * 16, 0, "x"), (1000, [float("nan")] * 16, 0, "x"), (1001, [float("inf")] + [0.0] * 15, 0, "x"), (None, [1.0] * 16, 0, "x"), (1050, [], 0, "x"), (1100, [0.5] * 9, 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string").repartition(3)
    got = {}
    for x in topk.op10(df, query_block=block, longest=50, part_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    g = {i: np.floor(np.float32(v[i]).astype(float) * 256).astype(int) for i in range(900)}
    g[1100] = np.array([128] * 9 + [0] * 7)
    want = {}
    for q in g:
        if q % 50 == 0:
            best = sorted(((-int(g[q] @ g[c]), c) for c in g if c != q))[:5]
            want[q] = [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert got == want
    assert topk.op10(df.where("false")).count() == 0 and topk.op10(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_op10_repeated_ids_are_separate_queries(spark, tmp_path):
    import duckdb

    from tessera.llm.queries import ORACLE

    r = np.random.default_rng(9)
    v = r.normal(0, 1, (300, 64)).astype(np.float32)
    rows = [(int(i), [float(x) for x in v[k]]) for k, i in enumerate([*range(200), *[50] * 60, *range(300, 340)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "e"))
    got = topk.op10(df, part_rows=64, query_block=20, longest=30).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = duckdb.sql(ORACLE["op10_products"]).df()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == sorted(map(tuple, want[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist()))
    assert sum(x.query_id == 50 for x in got) == 61 * 5


def test_search_memory_on_vectors_without_structure():
    import tracemalloc

    r = np.random.default_rng(3)
    x, q = r.normal(0, 256, (20_000, 64)).astype(np.int64), r.normal(0, 256, (4096, 64)).astype(np.int64)
    low = topk.thresholds(np.arange(4096) - 5000, q, np.arange(50), x[:50], 5)
    tracemalloc.start()
    row, _, score = topk.search(np.arange(4096) - 5000, q, low, np.arange(20_000), x, np.eye(64), 16, 5)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    for k in (0, 77, 4095):
        assert score[row == k].tolist() == np.sort(x @ q[k])[::-1][:5].tolist()


def test_columns_of_arrow_slices():
    a = pa.array(["ab", None, "", "é"])
    for arr in (a, a.slice(1), pa.chunked_array([a, a])):
        b, off = column(arr)
        assert [b[off[i] : off[i + 1]].tobytes().decode() for i in range(len(off) - 1)] == [x or "" for x in arr.to_pylist()]
