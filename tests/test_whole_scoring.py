"""Scoring of every order against plain loops."""

import glob
import os
from collections import Counter

import pytest

from millrace.plans import registry, scoring

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")


@pytest.fixture(scope="module")
def orders(spark):
    return scoring.graded(spark, SF).collect()


def rows(spark, name):
    return Counter(map(tuple, registry.QUERIES[name](spark, SF).collect()))


def hit(g, w):
    return w["words"][0] in " ".join(g["deskripsi"].lower().split())


def fits(g, w):
    hint = g["tanggal_hint"] in ("tidak_jelas", w["tanggal_hint"])
    return g["type"] == w["type"] and g["jumlah"] == w["jumlah"] and hint and (not w["ambigu"] or g["ambigu"]) and hit(g, w)


def strict(o):
    left = list(o["got"])
    for w in o["want"]:
        at = next((i for i, g in enumerate(left) if fits(g, w)), None)
        if at is None:
            return False
        left.pop(at)
    return not left and not o["flagged"]


def credit(g, w):
    if g["type"] != w["type"]:
        return 0
    a, b = sorted((g["jumlah"], w["jumlah"]))
    date = 15 if g["tanggal_hint"] == w["tanggal_hint"] else 8 if g["tanggal_hint"] == "tidak_jelas" else 0
    return min(100, 35 + (40 if a == b else 30 if a * 10 >= max(b, 1) * 9 else 0) + date + (10 if hit(g, w) else 0))


def copied(o):
    want = o["want"]
    for g in o["got"] if len(want) >= 2 else []:
        own = next((i for i, w in enumerate(want) if hit(g, w)), None)
        if own is not None and g["jumlah"] != want[own]["jumlah"] and any(w["jumlah"] == g["jumlah"] for i, w in enumerate(want) if i != own):
            return True
    return False


def principal(o):
    total = sum(w["jumlah"] for w in o["want"] if w["type"] == "pengeluaran")
    out = [g["jumlah"] for g in o["got"] if g["type"] == "pengeluaran"]
    return sum(out) == total or (total - 500 in out and 500 in out)


def merged(o):
    top = max(w["jumlah"] for w in o["want"])
    got = [g["jumlah"] for g in o["got"]]
    return got.count(top) == len(o["want"]) or bool(got) and sum(got) == top * len(o["want"])


def own_share(o):
    wanted = [w["jumlah"] for w in o["want"]]
    whole = next((g for g in o["got"] if g["jumlah"] == max(wanted)), None)
    return any(g["jumlah"] == min(wanted) for g in o["got"]) or bool(whole and whole["ambigu"])


def test_alt_strict_of_every_order(spark, orders):
    want = Counter((o["l_orderkey"], principal(o), merged(o), own_share(o)) for o in orders)
    for at in (1, 2, 3):
        assert {k[at] for k in want} == {True, False}
    assert rows(spark, "alt_strict") == want


def test_strict_credit_and_copies_of_every_order(spark, orders):
    assert any(len({w["n"] for w in o["want"]}) < len(o["want"]) for o in orders)
    assert rows(spark, "strict_pass") == Counter((o["l_orderkey"], strict(o)) for o in orders)
    assert rows(spark, "price_copy") == Counter((o["l_orderkey"], copied(o)) for o in orders)
    assert rows(spark, "partial_credit") == Counter((o["l_orderkey"], w["n"], credit(g, w)) for o in orders for w in o["want"] for g in o["got"] if g["n"] == -w["n"])
