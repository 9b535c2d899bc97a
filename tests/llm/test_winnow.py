"""Winnowing against every window of every item."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from millrace.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def slow(doc, items, window):
    w = slow_words(doc)
    hit, found = set(), []
    for name, text in items:
        v = slow_words(text)
        n = min(window, len(v))
        spots = [i for j in range(len(v) - n + 1) for i in range(len(w) - n + 1) if n and w[i : i + n] == v[j : j + n]]
        hit |= {p for i in spots for p in range(i, i + n)}
        if spots:
            found.append("" if name is None else str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus():
    rng = random.Random(6)
    some = lambda n: [rng.choice(["a", "b", "É", "d1", "漢"]) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(4, 24)] + [(1, None), (2, ""), (3, "?!"), (None, "q r s t"), (24, "u " * 30), (24, "u " * 30)]
    docs = [" ".join(some(rng.randint(0, 50))) for _ in range(60)]
    for _ in range(60):
        v = rng.choice(items)[1] or ""
        v = v.split(" ")
        i = rng.randint(0, len(v))
        docs.append(" ".join(some(8)) + " x, " + ".".join(v[i:]).upper() + "! " + " ".join(some(8) + v[:i]))
    return docs + [None, "", "...", "u " * 500, "Q-r_s/T", "z " * 20_000 + "q r s t"], items


@pytest.mark.parametrize("chunk", [10**6, 60])
def test_matches_brute_force(spark, chunk):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(docs)] + [(None, docs[70], 0, "x"), (2, docs[2], 0, "x")], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, winnow.decontaminate(d, b, chunk_words=chunk).collect()), key=str)
    assert got == sorted(((i, *slow(t, items, 10)) for i, t, *_ in d.collect()), key=str)
    kept = winnow.keep_clean(d, b, chunk_words=chunk)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if not slow(r["text"], items, 10)[-1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in winnow.decontaminate(docs, none).collect()] == [(1, 3, 0, 0, empty, False)]
    assert winnow.decontaminate(docs.limit(0), none).collect() == []


def test_spans(spark):
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(1, "x y " + " ".join(words[5:18]) + " z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert winnow.decontaminate(d, b, spans=True).first()["spans"] == [2, 15]


def test_long_items_of_repeated_words(spark):
    item = "x " * 3000
    cases = ["x " * 5000, "y " + "x " * 9 + "y " + "x " * 4000 + "z", "x y " * 3000, "a b c " * 2000]
    items = [(1, item), (2, "x y " * 2000), (3, "a b c " * 700 + "d"), (4, " ".join(f"w{i}" for i in range(50)))]
    began = time.perf_counter()
    index = winnow.Index([(i, winnow.words_of(t)) for i, t in items])
    got = [(winnow.covered(spans), rows) for spans, rows in (index.hits(winnow.words_of(t)) for t in cases)]
    assert got == [(5000, {1}), (4000, {1}), (6000, {2}), (6000, {3})]
    assert time.perf_counter() - began < 20


def test_both_ways_of_extending_agree():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.choice([1, 1, 2]) for _ in range(rng.randint(3, 40))]
        seq = [rng.choice([0, 1, 1, 2]) for _ in range(rng.randint(3, 60))]
        every = [(p, list(range(len(item)))) for p in range(len(seq))]
        got = winnow.runs_of(np.array(seq, np.uint64), item, 3)
        want = winnow.extended(seq, item, every, 3)
        inside = lambda s: {p for i, j in s for p in range(i, j)}
        assert inside(got) == inside(want) and bool(got) == bool(want)
