"""Top-k search against brute force."""

import math
import random

import numpy as np

from millrace.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k, **args).collect()
    return sorted(tuple(r) for r in got)


def test_matches_brute_force_with_ties_nulls_and_many_shards(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.13) for _ in range(16)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(60)]
    rows += [(900, None), (950, [0.1, None] + [0.0] * 14), (1000, [math.nan] * 16), (1050, [math.inf] + [0.0] * 15), (None, [0.5] * 16), (1100, []), (1150, [0.25, -0.5])]
    rows = [(i, v, 1, "x") for i, v in rows]
    assert run(spark, rows, shard_rows=100, query_rows=4) == brute([r[:2] for r in rows], 5)


def test_few_candidates_and_empty_table(spark):
    assert run(spark, [(0, [1.0, 2.0], 0, ""), (1, [0.5, -1.0], 0, "")]) == [(0, 1, 1, 256 * 128 + 512 * -256)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0, "")]) == []


def test_repeated_ids_are_the_querys_own(spark):
    rows = [(50, [1.0, 0.0], 0, ""), (50, [0.0, 1.0], 0, ""), (3, [1.0, 1.0], 0, "")]
    assert run(spark, rows) == [(50, 1, 3, 65536)] * 2


def test_large_components_stay_exact():
    q = np.floor(256 * np.array([1e6, -3.0]))
    x = np.floor(256 * np.array([[1e6, 2.0], [2e6, 1.0]]))
    assert topk.exact(q, x).tolist() == [sum(int(a) * int(b) for a, b in zip(q, r)) for r in x]


def test_scoring_stops_early_only_on_proof():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 2, (500, 8)))
    x[::50] *= 200
    ids = np.arange(500)
    got = topk.Shard(ids, x).search(np.array([-1]), x[:1] + 1, 5)
    s = x @ (x[0] + 1)
    want = sorted(zip(-s, ids))[:5]
    assert [(j, int(v)) for _, j, v in got] == [(j, int(-v)) for v, j in want]


def test_work_stops_before_the_last_level_on_skewed_postings():
    rng = np.random.default_rng(5)
    n, d = 2000, 512
    x = np.floor(rng.normal(0, 3, (n, d)))
    at = rng.random((n, d)) < 0.01
    x[at] = np.floor(rng.normal(0, 900, int(at.sum())))
    ids, q = np.arange(n), x[:20]
    shard = topk.Shard(ids, x)
    got = shard.search(ids[:20], q, 5)
    s = (q @ x.T).astype(np.int64)
    want = [(i, j, int(s[i, j])) for i in range(20) for j in sorted((j for j in range(n) if j != i), key=lambda j: (-s[i, j], j))[:5]]
    assert got == want
    assert shard.work < 0.1 * np.count_nonzero(x)


def test_only_empty_vectors_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [], 1, 2, 3), (50, [], 1, 2, 3), (1, [], 1, 2, 3)], "vec_id long, embedding array<float>, block int, ids int, set int")
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
