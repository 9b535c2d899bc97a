"""SimHash and its groups against brute force."""

import random

import numpy as np
import xxhash

from millrace.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps):
    lead = list(range(len(fps)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                lead[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice(["Ab", "cd", "éf", "GH", "ij k", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    long = " ".join(str(rng.randint(0, 500)) for _ in range(4000))
    return base + base[:9] + [t.upper().replace("É", "é") for t in base[:4]] + [None, "", "  \n", "one", "one two", long, long + " end", long.replace(" 7 ", " 8 ", 1), "a\x1cb c d e"]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = [(i, t, "l", "fp") for i, t in enumerate(texts())] + [(3, texts()[3], "l", "dup"), (None, "", "l", "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fps = [slow_fingerprint(r[1]) for r in rows]
    groups = slow_groups(fps)
    ids = {g: min(r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None) for g in set(groups)}
    assert got == sorted(((r[0], f"{f:016x}", ids[g]) for r, f, g in zip(rows, fps, groups)), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def near_points(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    for i in range(0, n - 1, 3):
        flips = rng.choice(64, rng.integers(0, 5), replace=False)
        x[i + 1] = x[i] ^ np.uint64(sum(1 << int(b) for b in flips))
    return np.unique(x)


def pairs(x, radius=3):
    return {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= radius) + i + 1}


def test_every_link_meets_in_a_shard_and_in_its_tree():
    x = near_points()
    want = pairs(x)
    assert len(want) > 300
    met = set()
    for half in (0, 1):
        row, shard = simhash.deal(x, half, 4)
        assert len(set(shard.tolist())) == 16 and len(row) < 2.2 * len(x)
        for s in set(shard.tolist()):
            own = row[shard == s]
            lead = simhash.link_shard(x[own], half)
            for i in np.flatnonzero(lead != np.arange(len(own))):
                met.add((own[i], own[lead[i]]))
    whole, cut = simhash.Groups(len(x)), simhash.Groups(len(x))
    for groups, links in ((whole, want), (cut, met)):
        i, j = (np.array(v) for v in zip(*links))
        groups.link(i, j)
    assert (whole.label == cut.label).all()


def test_dense_cluster_in_one_shard():
    rng = np.random.default_rng(2)
    x = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    both = simhash.Groups(len(x))
    for half in (0, 1):
        lead = simhash.link_shard(x, half)
        both.link(np.arange(len(x)), lead)
    assert set(both.label.tolist()) == {0}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 140)] + [(139, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{j: 100 for j in range(101, 140)}, 200: 100}


def test_a_shard_of_equal_halves_still_splits(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, 900, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]) << np.uint64(32) | np.uint64(0xABCD1234))
    most = []
    compare = simhash._compare
    monkeypatch.setattr(simhash, "_compare", lambda f, idx, *a: most.append(len(idx)) or compare(f, idx, *a))
    lead = simhash.link_shard(fp, 0)
    assert max(most) < len(fp)
    want = slow_groups([int(x) for x in fp])
    first = {}
    for i, g in enumerate(want):
        first.setdefault(g, i)
    assert lead.tolist() == [first[g] for g in want]
