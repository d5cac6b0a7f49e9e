"""The same results in plain SQL, for comparison."""

from __future__ import annotations

from tessera.config import FEATURES
from tessera.operators.features import GRID_COLUMNS as G

E_COLS = [f"e{i}" for i in range(64)]


def _half(y: str) -> str:
    return f"(floor({y}) + CASE WHEN ({y}) - floor({y}) >= 0.5e0 THEN 1 ELSE 0 END)"


def _clamp01(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) < 0 THEN 0e0 WHEN ({x}) > 1 THEN 1e0 ELSE {_half(f'({x})*1e4')} / 1e4 END)"


def _grid(x: str) -> str:
    return f"CAST({_half(f'CAST({x} AS DOUBLE)*1e4')} AS BIGINT)"


_BASE = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
w AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts,
 row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS seen,
 count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS tx FROM ev),
ua AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS user_avg FROM ev GROUP BY 1),
ka AS (SELECT k, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS k_avg FROM ev GROUP BY 1),
tx AS (SELECT w.*, user_avg, k_avg, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
 CASE k % 10 WHEN 0 THEN 0.15e0 WHEN 1 THEN 0.2e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.3e0 WHEN 4 THEN 0.35e0 WHEN 5 THEN 0.45e0 WHEN 6 THEN 0.6e0 WHEN 7 THEN 0.85e0 ELSE 0.5e0 END AS risk
 FROM w JOIN ua USING (user_id) JOIN ka USING (k))"""
_MIN = "date_diff('minute', date_trunc('minute', last_ts), date_trunc('minute', ts))"
_EXPR = [
    _clamp01("value / 500e0"), _clamp01("(1 + event_id % 12) / 12e0"),
    _clamp01("(CASE WHEN user_avg = 0 THEN CASE WHEN value > 0 THEN 1e300 WHEN value < 0 THEN -1e300 ELSE 0 END ELSE value / user_avg END) / 10e0"),
    _clamp01("hour(ts) / 23e0"), _clamp01("(isodow(ts) - 1) / 6e0"), f"CASE WHEN last_ts IS NULL THEN -1e0 ELSE {_clamp01(f'{_MIN} / 1440e0')} END",
    f"CASE WHEN last_ts IS NULL THEN -1e0 ELSE {_clamp01('(event_id*53 % 1200) / 1000e0')} END", _clamp01("(event_id*37 % 1500) / 1000e0"), _clamp01("tx / 20e0"),
    "CASE WHEN event_type IN ('click','view') THEN 1e0 ELSE 0e0 END", "CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END", "CASE WHEN seen = 1 THEN 1e0 ELSE 0e0 END", "risk", _clamp01("k_avg / 500e0"),
]
_FEAT = f"{_BASE},\nfeat AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(_EXPR, FEATURES, strict=True))} FROM tx)"
_GRIDDED = f"{_FEAT},\ngr AS MATERIALIZED (SELECT event_id, label, {', '.join(f'{_grid(n)} AS {g}' for n, g in zip(FEATURES, G, strict=True))} FROM feat)"


def _dist(a: str, b: str, cols) -> str:
    return " + ".join(f"({a}.{c}-{b}.{c})*({a}.{c}-{b}.{c})" for c in cols)


_NEAR = f"""{_GRIDDED},
near AS (SELECT * FROM (SELECT q.event_id AS query_id, r.event_id AS ref_id, r.label, {_dist('q', 'r', G)} AS dist,
 CAST(row_number() OVER (PARTITION BY q.event_id ORDER BY {_dist('q', 'r', G)}, r.event_id) AS INT) AS rank
 FROM gr q, gr r WHERE q.event_id % 200 = 0 AND r.event_id % 200 <> 0) WHERE rank <= 5),
sc AS (SELECT query_id, CAST(sum(label) AS BIGINT) AS fraud_count, CAST(sum(dist) AS BIGINT) AS dist_sum, min(label) = max(label) AS unanimous,
 sum(label) / 5e0 AS fraud_score, sum(label) / 5e0 < 0.6e0 AS approved FROM near GROUP BY 1)"""
_EVAL = f"""{_NEAR},
evl AS (SELECT gr.*, sc.*, label = 0 AS expected, CASE WHEN approved AND label = 0 THEN 'TN' WHEN NOT approved AND label <> 0 THEN 'TP' WHEN NOT approved THEN 'FP' ELSE 'FN' END AS grp FROM sc JOIN gr ON query_id = event_id)"""
_E = "[" + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)) + "]"
_EG = "emb AS (SELECT vec_id, coalesce(label, 0) AS label, " + ", ".join(f"{_grid(f'embedding[{i + 1}]')} AS {c}" for i, c in enumerate(E_COLS)) + " FROM embeddings)"
_CEN = f"{_EG},\ncen AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, * FROM (SELECT * FROM emb ORDER BY vec_id LIMIT 10))"
_ASG = f"""{_CEN},
asg AS (SELECT e.*, b.cluster_id, b.dist FROM emb e JOIN (SELECT vec_id, cluster_id, dist FROM (SELECT e.vec_id, c.cluster_id, {_dist('e', 'c', E_COLS)} AS dist,
 row_number() OVER (PARTITION BY e.vec_id ORDER BY {_dist('e', 'c', E_COLS)}, c.cluster_id) AS rn FROM emb e, cen c) WHERE rn = 1) b USING (vec_id))"""
_LONG = f"{_ASG},\nlg AS (SELECT cluster_id, unnest(range(64)) AS dim, unnest([{', '.join(E_COLS)}]) AS x FROM asg)"


def _probe(n: int) -> str:
    return f"""{_ASG},
pr AS (SELECT query_id, cluster_id, probe FROM (SELECT e.vec_id AS query_id, c.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_dist('e', 'c', E_COLS)}, c.cluster_id) AS probe
 FROM emb e, cen c WHERE e.vec_id % 25 = 0) WHERE probe <= {n})"""


def _scan(where: str) -> str:
    return f"""SELECT p.query_id, r.vec_id AS ref_id, r.label, {_dist('q', 'r', E_COLS)} AS dist FROM pr p JOIN emb q ON q.vec_id = p.query_id JOIN asg r ON r.cluster_id = p.cluster_id WHERE r.vec_id % 25 <> 0 AND {where}"""


def _knn(expr: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, {_E} AS v FROM embeddings)
SELECT query_id, ref_id, label, dist, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS INT) AS rank FROM (
 SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label, {expr} AS dist FROM e q, e r WHERE q.vec_id % 25 = 0 AND r.vec_id % 25 <> 0)) WHERE rank <= 5"""


def _sum(f: str) -> str:
    return f"list_reduce(list_prepend(0e0, list_transform(range(1, 65), lambda i: {f})), lambda s, x: s + x)"


_DOT, _NQ, _NR = (_sum(x) for x in ("q.v[i]*r.v[i]", "q.v[i]*q.v[i]", "r.v[i]*r.v[i]"))
_SQ = _knn(_sum("(q.v[i]-r.v[i])*(q.v[i]-r.v[i])"))
_TOP = "SELECT query_id, ref_id, label, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS INT) AS rank FROM"
_TOP_IN_FILE = _TOP.replace("dist, ref_id) AS INT", "dist, cluster_id, ref_id) AS INT")  # the containers number rows by cluster and id
_EXACT = f"WITH {_NEAR} SELECT query_id, ref_id, label, dist, rank FROM near"
_JSON = "'{\"approved\":' || CASE WHEN approved THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CAST(fraud_score AS VARCHAR) || '}'"
_AFF = f"""WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings), p AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM e),
c AS (SELECT (hi + lo) / 2e0 AS ce, CASE WHEN hi = lo THEN 1e0 ELSE (hi - lo) / 65534e0 END AS st FROM p),
l AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(v) AS x FROM e),
q AS (SELECT vec_id, dim, CAST(least(greatest({_half('(x - ce) / st')}, -32767), 32767) AS INT) AS q, ce, st FROM l, c)
SELECT vec_id, CAST(dim AS INT) AS dim, q, q * st + ce AS back FROM q"""


def _rounds(n: int) -> str:
    out = [_CEN]
    for i in range(n):
        prev = f"cen{i}" if i else "cen"
        out.append(f"a{i} AS (SELECT vec_id, cluster_id FROM (SELECT e.vec_id, c.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_dist('e', 'c', E_COLS)}, c.cluster_id) AS rn FROM emb e, {prev} c) WHERE rn = 1)")
        mean = ", ".join(f"CAST(floor(CAST(sum({c}) AS DOUBLE) / count(*) + 0.5e0) AS BIGINT) AS {c}" for c in E_COLS)
        out.append(f"cen{i + 1} AS (SELECT cluster_id, {mean} FROM a{i} JOIN emb USING (vec_id) GROUP BY 1 UNION ALL SELECT cluster_id, {', '.join(E_COLS)} FROM {prev} WHERE cluster_id NOT IN (SELECT cluster_id FROM a{i}))")
    return ",\n".join(out)


_F32 = "CAST({} AS FLOAT)".format
_LATTICE = f"""rf AS (SELECT * FROM asg WHERE vec_id % 25 <> 0),
rg AS (SELECT {_F32(f"least({', '.join(f'min({c})' for c in E_COLS)}) / 1e4")} AS lo, {_F32(f"greatest({', '.join(f'max({c})' for c in E_COLS)}) / 1e4")} AS hi FROM rf),
pm AS (SELECT (hi + lo) / {_F32(2)} AS ce, CASE WHEN hi = lo THEN {_F32(1)} ELSE (hi - lo) / {_F32(65534)} END AS st FROM rg),
mn AS (SELECT cluster_id, {', '.join(f"CAST({_F32(f'(CAST(sum({c}) AS DOUBLE) / count(*)) / 1e4')} AS DOUBLE) AS {c}" for c in E_COLS)} FROM rf GROUP BY 1),
lt AS (SELECT vec_id, label, cluster_id, {', '.join(f"CAST(least(greatest(floor(({_F32(f'{c} / 1e4')} - ce) / st + {_F32(0.5)}), -32767), 32767) AS BIGINT) AS {c}" for c in E_COLS)} FROM asg, pm),
qp AS (SELECT query_id, cluster_id, probe FROM (SELECT e.vec_id AS query_id, m.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {' + '.join(f'(e.{c} / 1e4 - m.{c}) * (e.{c} / 1e4 - m.{c})' for c in E_COLS)}, m.cluster_id) AS probe
 FROM emb e, mn m WHERE e.vec_id % 25 = 0) WHERE probe <= 4),
hits AS (SELECT p.query_id, p.probe, p.cluster_id, r.vec_id AS ref_id, r.label, {_dist('q', 'r', E_COLS)} AS dist FROM qp p JOIN lt q ON q.vec_id = p.query_id JOIN lt r ON r.cluster_id = p.cluster_id AND r.vec_id % 25 <> 0)"""

ORACLE = {
    "flagship_score": f"WITH {_NEAR} SELECT query_id, fraud_count, dist_sum, fraud_score, approved FROM sc",
    "features_vector": f"WITH {_FEAT} SELECT event_id, {', '.join(FEATURES)} FROM feat",
    "clamp01_edges": f"""WITH l AS (SELECT *, CASE WHEN l_quantity = 25 THEN CASE WHEN l_extendedprice > 20000 THEN 1e300 WHEN l_extendedprice < 20000 THEN -1e300 ELSE 0e0 END ELSE (l_extendedprice - 20000e0) / (l_quantity - 25e0) END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, {_clamp01('x / 5000e0')} AS ratio, {_clamp01('l_discount / 3e0')} AS third, CASE WHEN l_quantity / 30e0 > 1 THEN 1e0 WHEN l_quantity < 0 THEN 0e0 ELSE l_quantity / 30e0 END AS plain FROM l""",
    "date_features": f"""WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts FROM events)
SELECT event_id, CAST(hour(ts) AS INT) AS hh, CAST(minute(ts) AS INT) AS mi, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(day(ts) AS INT) AS dd, CAST(month(ts) AS INT) AS mm, CAST(year(ts) AS INT) AS yy, {_MIN} AS gap FROM e""",
    "json_parse": f"WITH {_FEAT} SELECT event_id, {', '.join(FEATURES)} FROM feat",
    "mcc_lookup": f"WITH {_FEAT} SELECT CAST(5411 + k % 10 AS VARCHAR) AS mcc, max(risk) AS risk, count(*) AS n FROM feat GROUP BY 1",
    "known_merchant": f"WITH {_FEAT} SELECT user_avg IS NULL AS no_customer, CAST(unknown_merchant AS INT) AS unknown, count(*) AS n FROM feat GROUP BY 1, 2",
    "grid_quantize": f"SELECT vec_id, CAST(dim AS INT) AS dim, CAST({_grid('x')} AS INT) AS q, {_grid('x')} / 1e4 AS back FROM (SELECT vec_id, unnest(range(64)) AS dim, unnest({_E}) AS x FROM embeddings)",
    "affine_quantize": _AFF,
    "dist_l2": _SQ,
    "dist_l1": _knn(_sum("abs(q.v[i]-r.v[i])")),
    "dist_cosine": _knn(f"CASE WHEN {_NQ} = 0 OR {_NR} = 0 THEN 1e0 ELSE 1e0 - {_DOT} / (sqrt({_NQ}) * sqrt({_NR})) END"),
    "knn_exact": _SQ,
    "knn_grid": _EXACT,
    "centroid_assign": f"WITH {_ASG} SELECT vec_id, CAST(cluster_id AS INT) AS cluster_id, dist FROM asg",
    "kmeans_step": f"WITH {_LONG} SELECT CAST(cluster_id AS INT) AS cluster_id, CAST(dim AS INT) AS dim, CAST(sum(x) AS DOUBLE) / count(*) AS mean, count(*) AS n FROM lg GROUP BY 1, 2",
    "cluster_bbox": f"WITH {_LONG} SELECT CAST(cluster_id AS INT) AS cluster_id, CAST(dim AS INT) AS dim, min(x) AS lo, max(x) AS hi FROM lg GROUP BY 1, 2",
    "cluster_sizes": f"WITH {_ASG}, n AS (SELECT CAST(cluster_id AS INT) AS cluster_id, count(*) AS n FROM asg GROUP BY 1) SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n",
    "row_in_cluster": f"WITH {_ASG} SELECT vec_id, CAST(cluster_id AS INT) AS cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 AS INT) AS pos FROM asg",
    "bbox_lower_bound": f"""WITH {_ASG}, bx AS (SELECT cluster_id, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in E_COLS)} FROM asg GROUP BY 1)
SELECT vec_id AS query_id, CAST(cluster_id AS INT) AS cluster_id, {' + '.join(f'greatest(lo_{c} - {c}, {c} - hi_{c}, 0) * greatest(lo_{c} - {c}, {c} - hi_{c}, 0)' for c in E_COLS)} AS lb FROM emb, bx WHERE vec_id % 25 = 0""",
    "ivf_probe": f"WITH {_probe(2)} SELECT query_id, CAST(cluster_id AS INT) AS cluster_id, CAST(probe AS INT) AS probe FROM pr",
    "unprobed_clusters": f"WITH {_probe(2)} SELECT qid AS query_id, CAST(c.cluster_id AS INT) AS cluster_id FROM (SELECT vec_id AS qid FROM emb WHERE vec_id % 25 = 0) e, cen c WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.query_id = e.qid AND pr.cluster_id = c.cluster_id)",
    "ivf_search": f"WITH {_probe(2)} SELECT * FROM ({_TOP} ({_scan('true')})) WHERE rank <= 5",
    "early_stop_unanimous": f"""WITH {_probe(4)}, h AS ({_scan('probe <= 2')}), ht AS (SELECT * FROM ({_TOP} h) WHERE rank <= 5),
done AS (SELECT query_id FROM ht GROUP BY 1 HAVING count(*) = 5 AND min(label) = max(label)),
f AS ({_scan('p.query_id NOT IN (SELECT query_id FROM done)')})
SELECT * FROM ht WHERE query_id IN (SELECT query_id FROM done) UNION ALL SELECT * FROM ({_TOP} f) WHERE rank <= 5""",
    "ivf_exact": _EXACT,
    "kmeans_rounds": f"WITH {_rounds(2)} SELECT CAST(cluster_id AS INT) AS cluster_id, CAST(unnest(range(64)) AS INT) AS dim, unnest([{', '.join(E_COLS)}]) AS value FROM cen2",
    "ivf_q16": f"WITH {_ASG},\n{_LATTICE} SELECT * FROM ({_TOP_IN_FILE} hits) WHERE rank <= 5",
    "ivf_q16_early": f"""WITH {_ASG},
{_LATTICE}, nq AS (SELECT query_id, greatest(1, (max(probe) + 1) // 2) AS half, max(probe) AS most FROM qp GROUP BY 1),
lv AS (SELECT nq.query_id, unnest(range(half, most + 1)) AS last, most FROM nq),
lh AS (SELECT lv.query_id, last, most, ref_id, label, dist, row_number() OVER (PARTITION BY lv.query_id, last ORDER BY dist, h.cluster_id, ref_id) AS rn FROM lv JOIN hits h ON h.query_id = lv.query_id AND h.probe <= last),
st AS (SELECT query_id, last, most, count(*) = 5 AND min(label) = max(label) AS stop FROM lh WHERE rn <= 5 GROUP BY 1, 2, 3),
en AS (SELECT query_id, coalesce(min(last) FILTER (WHERE stop), max(most)) AS last FROM st GROUP BY 1)
SELECT lh.query_id, ref_id, label, dist, CAST(rn AS INT) AS rank FROM lh JOIN en USING (query_id, last) WHERE rn <= 5""",
    "fraud_count": f"WITH {_NEAR} SELECT query_id, fraud_count, unanimous FROM sc",
    "decision": f"WITH {_NEAR} SELECT query_id, fraud_score, approved FROM sc",
    "response_json": f"WITH {_NEAR} SELECT query_id, {_JSON} AS response FROM sc",
    "confusion": f"""WITH {_EVAL}, g AS (SELECT unnest(['TN','TP','FP','FN']) AS "group"), c AS (SELECT "group", count(grp) AS n FROM g LEFT JOIN evl ON grp = "group" GROUP BY 1)
SELECT "group", n, n / CAST(sum(n) OVER () AS DOUBLE) AS rate FROM c""",
    "feature_stats": f"""WITH {_EVAL}, l AS (SELECT grp, unnest(range(14)) AS dim, unnest([{', '.join(G)}]) AS x FROM evl), s AS (SELECT grp, dim, count(*) AS n, sum(x) AS sx, sum(x*x) AS sxx FROM l GROUP BY 1, 2)
SELECT grp AS "group", CAST(dim AS INT) AS dim, n, CAST(sx AS DOUBLE) / n / 1e4 AS mean, sqrt(CAST(greatest(n*sxx - sx*sx, 0) AS DOUBLE)) / n / 1e4 AS std FROM s""",
    "failures": f"""WITH {_EVAL} SELECT query_id, grp AS "group", expected, approved AS predicted, fraud_score FROM evl WHERE grp IN ('FP', 'FN')""",
    "zip_eval": """WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, CAST(doc_id AS VARCHAR) AS value FROM labels),
b AS (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS line, quality = 1 AS expected FROM labels WHERE doc_id IS NOT NULL) SELECT line, value, expected FROM a JOIN b USING (line)""",
    "score_requests": f"WITH {_NEAR} SELECT query_id, fraud_score, approved, {_JSON} AS response FROM sc",
}
