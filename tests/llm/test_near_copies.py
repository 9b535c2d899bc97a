"""Near copies against all pairs compared on their whole sets."""

import random

import corpus_pipeline as cp
from millrace.llm import near_copies


def slow_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(rows):
    sets, lead = [slow_set(t) for t in rows], list(range(len(rows)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                lead[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def texts():
    rng = random.Random(4)
    line = " ".join(f"common{i}" for i in range(25))
    out = []
    for i in range(70):
        w = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(6, 160))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):  # near copies on both sides of the threshold
            w = list(w)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(w))
    out += [f"{line} " + " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(20)) for _ in range(30)]
    return out + [None, "", " \n", "one", "ONE", "one two"] + out[:5]


def test_groups_match_all_pairs(spark, monkeypatch):
    rows = texts()
    want = slow_groups(rows)
    assert 20 < len(set(want)) < len(rows) - 40
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(df).collect()}
    first = {}
    for i in range(len(rows)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(rows))] == want
    kept = {r["doc_id"] for r in cp.one_of_each(spark, df, "").collect()}
    assert kept == set(want)


def test_tiles_and_hot_shingles_lose_nothing(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 3), ("TILE_SHINGLES", 150), ("HOT", 3), ("STAR_ROUNDS", 1)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = texts()
    for _ in range(40):  # one large group of near copies, many beyond the threshold from each other
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
        rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(df).collect()}
    first = {}
    for i in range(len(rows)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(rows))] == slow_groups(rows)


def test_pairs_are_made_where_they_meet_first():
    """Texts that share their whole prefixes make each pair in the first run only, and every pair is made in some run."""
    import numpy as np

    rng, made, met = np.random.default_rng(8), [], set()
    sets = [np.sort(rng.choice(60, 40, replace=False)).astype(np.int64) for _ in range(12)] + [np.arange(40)] * 3
    runs = {t: [(k, int(np.flatnonzero(s == t)[0])) for k, s in enumerate(sets) if t in s] for t in range(60)}
    for run in runs.values():
        k, at = (np.array(x, np.int64) for x in zip(*run))
        known = np.arange(near_copies.BEFORE)[None, :] < np.minimum(at, near_copies.BEFORE)[:, None]
        before = np.zeros(known.shape, np.int64)
        for i, (x, place) in enumerate(run):
            own = sets[x][max(0, place - near_copies.BEFORE) : place]
            before[i, : len(own)] = own
        # sizes that rule no pair out
        for x, y in near_copies.cross(k, np.full(len(k), 10**6), at, k, np.zeros(len(k), np.int64), np.zeros((len(k), 8), np.uint64), before, known):
            made += [frozenset(p) for p in zip(x.tolist(), y.tolist())]
        met |= {frozenset((a, b)) for a, _ in run for b, _ in run if a != b}
    assert set(made) == met and len(made) == len(met)


def test_clashing_columns_stay(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, 5, 6, 7, 8, 9), (2, t + " end", 5, 6, 7, 8, 9), (3, "alone here", 5, 6, 7, 8, 9)], "doc_id long, text string, _h int, _id int, h int, sig int, _bucket int")
    kept = cp.one_of_each(spark, df, "")
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.where("doc_id <> 2").collect())


def test_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_survivors_with_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (2, b), (None, a + " end"), (None, c), (None, c + " end")]
    got = cp.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in got) == [(0, "c"), (1, "a"), (1, "b")]
