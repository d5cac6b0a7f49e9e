"""Registered queries of the ten operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import fingerprint, langid, minhash, mixing, packing, quality, secrets, topk, toxicity, wavelet
from tessera.session import table


def _docs(op):
    return lambda spark, d: op(table(spark, d, "documents"))


def _labelled(op):
    return lambda spark, d: op(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {
    "op1_language": _docs(langid.op1),
    "op2_tokens": _docs(wavelet.op2),
    "op3_packing": _docs(packing.op3),
    "op4_fingerprints": _docs(fingerprint.op4),
    "op5_quality": _labelled(quality.op5),
    "op6_secrets": _docs(secrets.op6),
    "op7_mixing": _docs(mixing.op7),
    "op8_minhash": _docs(minhash.op8),
    "op9_toxicity": _labelled(toxicity.op9),
    "op10_products": lambda spark, d: topk.op10(table(spark, d, "embeddings")),
}

ORACLE = {
    "op10_products": """WITH v AS (SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, q.rn, c.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
}
