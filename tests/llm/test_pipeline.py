"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline as cp
from millrace.llm import byte_bpe
from test_secrets import slow as slow_secrets
from test_simhash import slow_fingerprint, slow_groups
from test_winnow import slow as slow_hits


def corpus(spark, folder):
    rng = random.Random(12)
    words = ["".join(rng.choice(["ti", "on", "er", "the", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passage = " ".join(f"{w}q" for w in words[:15])
    docs, labels = [], []
    for i in range(240):
        t, good = " ".join(rng.choice(words) for _ in range(rng.randint(40, 90))), 1
        if i % 3 == 0:
            t, good = " ".join(w.upper() + "%%%" for w in t.split()), 0
        elif i % 10 == 1:
            t += " " + passage
        elif i % 10 == 4:
            t += " token=0a1b2c3d4e5f60718293"
        elif i % 10 == 7 and docs[-1][1]:
            t = docs[i - 3][1]
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, good, 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id " * 9, "en", "s", 54)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, labels, [(1, passage)]


def test_stages_and_run(spark, tmp_path):
    rows, labels, items = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, d = docs.columns, str(tmp_path)
    good = cp.good_quality(spark, docs, d)
    ids = {r["doc_id"] for r in good.collect()}
    marked = {i: q for i, q, _ in labels}
    wrong = sum((i in ids) != bool(q) for i, q in marked.items())
    assert good.columns == columns and wrong <= 5

    kept = cp.one_of_each(spark, docs, d)
    groups = slow_groups([slow_fingerprint(r[1]) for r in rows])
    first = {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    want = set(first.values()) | {r[0] for r, g in zip(rows, groups) if g not in first}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == want

    clean = cp.no_benchmark(spark, docs, d)
    assert clean.columns == columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in rows if not slow_hits(r[1], items, 10)[-1])

    masked = cp.no_secrets(spark, docs, d)
    got = {r["doc_id"]: r for r in masked.collect()}
    assert masked.columns == columns and len(got) == len(rows)
    for i, t, *_ in rows:
        assert (got[i]["text"] == t) == (slow_secrets(t)[-1] == "")

    out = cp.run(spark, d)
    assert out.columns == byte_bpe.SCHEMA.names and 0 < out.count() < len(rows)
    step = docs
    for _, stage in cp.STAGES:
        step = stage(spark, step, d).cache()
    assert sorted(map(str, step.collect())) == sorted(map(str, out.collect()))
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


DDL = "doc_id long, text string, lang string, source string, n_chars long, _h int, _spans string, y int, score double"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == byte_bpe.SCHEMA.names and out.collect() == []


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, long = some(60), some(60_000)
    texts = [(1, a), (1, some(40)), (1, a), (2, a + " more"), (3, None), (4, ""), (None, None), (None, some(30)), (5, long), (6, long + " end"), (7, "password: 0a1b2c3d4e5f60718293 " + some(20))]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 0.5) for i, t in texts]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, texts[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns
        docs = got.cache()
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:8]) for r in docs.collect())
    # one of the equal and near texts, each of the different ones under an id, one text without words, no benchmark item
    assert kept == sorted([("1", a[:8]), ("1", texts[1][1][:8]), ("3", ""), ("5", long[:8]), ("7", "[secret]")])
    assert sorted(str(r["doc_id"]) for r in cp.run(spark, d).collect()) == ["1", "1", "3", "5", "7"]
