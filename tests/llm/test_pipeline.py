import random

from tests.llm.test_minhash import brute

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_together(spark, tmp_path):
    r = random.Random(1)
    en, fr = "the and that with from this have which".split(), "le la les que dans pour avec être".split()
    rows = []
    for i in range(160):
        w = [r.choice(en if i % 2 else fr) + str(r.randint(0, 60)) for _ in range(r.randint(20, 120))]
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", f"s{i % 4}", 0))
    rows += [(200, rows[7][1], "en", "s1", 0), (201, rows[7][1] + " more", "en", "s1", 0), (202, None, "en", "s0", 0), (203, "12 34", "fr", "s0", 0), (204, rows[9][1] + ' token = "abcdefgh1234"', "en", "s2", 0), (205, 'le que la token = "abcdefgh1234" et le pour dans une autre chose', "fr", "s2", 0)]
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {k: {x.doc_id for x in v} for k, v in seen.items()}
    assert ids["language"] == {x[0] for x in rows} - {202, 203}
    texts = [(x.doc_id, x.text) for x in seen["language"]]
    assert ids["near_duplicates"] == {c for _, _, c in brute(texts, 5)}
    assert ids["secrets"] == ids["near_duplicates"] and not any("abcdefgh1234" in x.text for x in seen["secrets"])
    assert ids["mixing"] <= ids["secrets"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == ids["mixing"] and len(out) >= len(seen["mixing"])


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
