"""Toxicity and quality: exact parts against brute force, held-out accuracy on planted texts."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity


def corpus(n=400, seed=11):
    """Texts with toxic passages and junk, and their labels."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ti", "on", "er", "the", "an", "in", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            at = rng.randint(0, len(w) - 20)
            for j in range(at, at + 20, 4):
                w[j] = rng.choice(["blarg", "zorgish", "vlimmer", "kruntly"]) + rng.choice(["", "s", "ed"])
        if bad:
            w = rng.choice([[x + "$$$" for x in w], [x.upper() + "!!" for x in w], [rng.choice(words[:3])] * len(w)])
        rows.append((i, " ".join(w), int(toxic), int(not bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _, _ in rows] + [(10_000, None, "x", 0.5), (10_001, "", "x", 0.5), (None, "odd", "x", 0.5), (1, rows[1][1], "x", 0.5), (10_002, "long words " * 20_000, "x", 0.5)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows] + [(None, 1, 1), (5, None, None), (77_777, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(scored, rows, at):
    got = {r["doc_id"]: r for r in scored.collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    return sum(got[r[0]]["predicted"] == r[at] for r in held) / len(held)


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    rule = F.col("doc_id") % 4 != 0
    tox = toxicity.train(docs, labels, rule)
    scored = toxicity.score(docs, tox)
    assert scored.count() == docs.count() and accuracy(scored, rows, 2) >= 0.95
    good = quality.train(docs, labels, rule)
    scored = quality.score(docs, good)
    assert scored.count() == docs.count() and accuracy(scored, rows, 3) >= 0.9
    assert toxicity.score(docs.limit(0), tox).collect() == [] == quality.score(docs.limit(0), good).collect()
    found = toxicity.score(docs.where("doc_id < 400"), tox, passages=True).where("size(passages) > 0").collect()
    assert found and all(0 <= p["start"] < p["end"] for r in found for p in r["passages"])


def test_one_class_or_no_labels(spark):
    docs, labels = frames(spark, corpus(40))
    for none in (labels.limit(0), labels.where("toxic = 0 and quality = 1")):
        for kind, label in ((toxicity, "toxic"), (quality, "quality")):
            got = kind.score(docs, kind.train(docs, none, F.lit(True), label)).select("score").distinct().collect()
            assert len(got) == 1


def slow_segments(x):
    """Maximal segments by their definition: best segment, then left and right of it."""
    best = None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            s = sum(x[i:j])
            if s > 0 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return slow_segments(x[:i]) + [best] + [(a + j, b + j, c) for a, b, c in slow_segments(x[j:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(200):
        n, other = rng.randint(1, 25), -rng.choice([0.37, 1.13])
        hits = sorted((i, rng.choice([0.71, 1.93, 3.17]) + rng.random() / 100) for i in rng.sample(range(n), rng.randint(0, n)))
        x = [other] * n
        for i, s in hits:
            x[i] = s
        got = toxicity.segments(hits, n, other)
        assert [(i, j, round(s, 6)) for i, j, s in got] == [(i, j, round(s, 6)) for i, j, s in slow_segments(x)]


def test_log_odds_and_lambda():
    d, z = toxicity.log_odds(50, 10, 1000, 10_000)
    assert d > 2 and z > 3 and toxicity.log_odds(10, 100, 1000, 10_000)[0] == 0
    lam = toxicity.karlin(np.array([0.1, 0.9]), np.array([2.0, -1.0]))
    assert abs(0.1 * math.exp(2 * lam) + 0.9 * math.exp(-lam) - 1) < 1e-6


def test_empty_text_has_no_features():
    s = quality.Sizer(b"good words here " * 20, b"bad words there " * 20)
    assert s.features("") == [0.0, 0.0, quality.USUAL] and s.features("good words here")[0] > 0


def test_long_labelled_texts_teach_quality(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(["ti", "on", "er", "the", "an", "in", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(5000)]
        rows.append((i, " ".join([x.upper() + "!!" for x in w] if i % 3 == 0 else w), 0, int(i % 3 != 0)))
    assert min(len(r[1]) for r in rows) > 16_384
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 4 != 0)
    assert model.good and accuracy(quality.score(docs, model), rows, 3) == 1
    assert len(quality.some_blocks("é" * 100_000)) == quality.TEXT_BLOCKS and b"".join(quality.some_blocks("abc" * 900)) == b"abc" * 900


def slow_quality(text, model):
    """A score from the collected model alone, in plain Python."""
    import zstandard as zs

    def size(data, d):
        return len(zs.ZstdCompressor(level=quality.LEVEL, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_AUTO), write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))

    data = text.encode()
    pairs = [(size(data[i : i + 1024], model.good), size(data[i : i + 1024], model.bad)) for i in range(0, len(data), 1024)]
    lean = sorted((b - g) / (g + b + 80) for g, b in pairs)
    low = lean[: max(1, len(lean) // 10)]
    g, b = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
    plain = len(zs.ZstdCompressor(level=1, write_checksum=False, write_content_size=False).compress(data)) if data else 0
    squeezed = (plain + 32 * 0.45) / (len(data) + 32)
    x = [1, 10 * (b - g) / (g + b + 80) if data else 0, 10 * sum(low) / len(low) if data else 0, squeezed]
    x += [max(0, 0.3 - x[3]), max(0, 0.2 - x[3])]
    return 1 / (1 + math.exp(-sum(a * c for a, c in zip(x, model.weights))))


def slow_toxicity(text, model):
    """A score from the collected model alone: maximal segments by their definition, the extreme-value law, the fit."""
    words = toxicity.words_of(text)
    x = [next((model.odds[t] for t in [w + "."] + [w[:n] for n in (8, 7, 6, 5, 4) if len(w) >= n] if t in model.odds), model.other) for w in words]
    normal = [model.lam * s + math.log(0.05) - math.log(max(1, len(words))) - model.log_k for _, _, s in (slow_segments(x) if any(v > 0 for v in x) else [])]
    return 1 / (1 + math.exp(-(model.bias + model.weight * math.log1p(sum(s for s in normal if s > 0)))))


def test_registered_queries_against_plain_python(spark, tmp_path, monkeypatch):
    import zlib

    from millrace.llm import queries

    rows = corpus(300)
    docs = [(i, t, "x") for i, t, _, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "odd one", "x"), (7, rows[7][1], "x"), (7, "another text under the same id", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, t, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for kind, query, slow, mod, rest in ((quality, queries.op7_quality, slow_quality, 3, 1), (toxicity, queries.op3_toxicity, slow_toxicity, 5, 0)):
        seen, train = [], kind.train
        monkeypatch.setattr(kind, "train", lambda *a, f=train, s=seen: s.append((f(*a), a)) or s[-1][0])
        got = query(spark, str(tmp_path))
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        model, (_, labels, rule) = seen[0]
        taught = {r["doc_id"] for r in labels.where(rule).collect()}
        crc = {i: zlib.crc32(str(i).encode()) % mod for i, *_ in docs if i is not None}
        assert taught == {i for i, *_ in rows if crc[i] != rest}
        want = sorted((str(i), i is not None and crc[i] == rest, round(slow(t or "", model), 6)) for i, t, _ in docs)
        assert sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 6)) for r in got.collect()) == want
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.collect())
