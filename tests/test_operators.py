"""DataFrame operators on small tables."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import scoring
from millrace.operators import batches, boards, ledger, sampling, similarity
from millrace.sources import files


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


LEDGER = "id long, org_id string, type string, jumlah long, deskripsi string, tanggal string, vendor string, source string, ambigu boolean, catatan string"


def book(spark):
    data = [(1, "p", "pemasukan", 100, "gaji", "2026-07-01", "pt", "a", False, None), (2, "p", "pengeluaran", 40, "kopi", "2026-07-02", "w", "a", True, None), (3, "q", "pengeluaran", 60, "teh", None, "w", "a", False, "NO_RECEIPT"), (4, "p", "pengeluaran", 40, "kopi", "2026-07-02", "w", "a", False, None), (5, "q", None, 7, None, "2026-07-08", None, "b", False, None)]
    return spark.createDataFrame(data, LEDGER)


def test_summary_and_periods(spark):
    b = book(spark)
    got = {(r["org_id"], r["type"]): (r["n_rows"], r["total"]) for r in ledger.summary(b, "p").collect()}
    assert got == {("*", "pemasukan"): (1, 100), ("*", "pengeluaran"): (2, 80), ("p", "pemasukan"): (1, 100), ("p", "pengeluaran"): (2, 80), ("q", "pengeluaran"): (1, 60), ("q", None): (1, 7)}
    assert tuple(ledger.period_sum(b, "2026-07-01", "2026-07-02", "pengeluaran", "p").first()) == (80, 2)
    assert tuple(ledger.period_sum(b, "2030", "2031").first()) == (0, 0)
    assert rows(b.groupBy("org_id").agg(ledger.net().alias("n")), "org_id") == [("p", 20), ("q", -67)]


def test_duplicates_anomalies_and_asserts(spark):
    b = book(spark)
    assert sorted((r["id"], r["copies"]) for r in ledger.deduplicate(b).collect()) == [(1, 1), (2, 2), (3, 1), (5, 1)]
    flags = {r["id"]: r["flags"] for r in ledger.anomalies(b, 1.1, 30).collect()}
    assert flags == {3: "no_receipt"}
    assert b.agg(ledger.has_amount(b, "pengeluaran", 40, ["kop", "w"]).alias("x")).first()["x"] and not b.agg(ledger.has_amount(b, "pengeluaran", 40, ["zz"]).alias("x")).first()["x"]
    have = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    ok = spark.range(1).select(ledger.amounts_ok(have(5000, 5000, 5000, 5000, 9), [20000, 9]).alias("a"), ledger.amounts_ok(have(5000, 5000), [20000]).alias("b"), ledger.amounts_ok(have(1, 2), [2]).alias("c"), ledger.assert_score(F.lit(1), F.lit(3)).alias("d"), ledger.assert_score(F.lit(0), F.lit(0)).alias("e")).first()
    assert tuple(ok) == (True, False, True, 13, 0)


def test_reconcile_change_log_and_statements(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, jumlah long"), spark.createDataFrame([("x", 1), ("y", 5), ("w", 4)], "k string, jumlah long")
    assert {r["k"]: r["status"] for r in ledger.reconcile(a, b, "k").collect()} == {"x": "matched", "y": "amount_diff", "z": "left_only", "w": "right_only"}
    log = spark.createDataFrame([(1, 1, "put", 5), (1, 2, "put", 6), (2, 1, "put", 7), (2, 3, "delete", None)], "id long, n long, op string, v long")
    assert [(r["id"], r["v"]) for r in ledger.latest(log, "id", ["n"]).collect()] == [(1, 6)]
    st = spark.createDataFrame([("d", "gaji", 10, "pemasukan", "p"), ("d", "kopi", -4, "pengeluaran", "q"), ("d", "self", -9, "internal", "p")], "tanggal string, keterangan string, jumlah long, arah string, org_hint string")
    assert sorted(r["jumlah"] for r in ledger.import_statement(st).collect()) == [4, 10] and ledger.import_statement(st, "q").count() == 1


def test_boards(spark):
    base = spark.createDataFrame([("a", 20, 10.0), ("b", 25, 5.0)], "model string, base_pass long, base_ms double")
    hard = spark.createDataFrame([("b", 5, 70.04, 9.0), ("c", 5, 70.05, 9.0)], "model string, hard_strict long, composite double, hard_ms double")
    assert [(r["model"], r["rank"], r["composite"]) for r in boards.merge_boards(base, hard).orderBy("rank").collect()] == [("c", 1, 70.1), ("b", 2, 70.0), ("a", 3, None)]
    assert spark.range(1).select(boards.public_score(F.lit(36), F.lit(85)).alias("x")).first()["x"] == 68.9
    runs = spark.createDataFrame([("m", "2026", "a", 1), ("m", "2026", "b", 2), ("n", "2025", "z", 3)], "model string, at string, path string, v long")
    assert sorted((r["model"], r["v"]) for r in boards.newest(runs, ["model"], ["at", "path"]).collect()) == [("m", 2), ("n", 3)]


@pytest.mark.parametrize("values", [[1.0], [3.0] * 50, [float(i) for i in range(20)], [0.0] * 500 + [1e6], [random.Random(1).random() for _ in range(300)]])
def test_index_percentile(spark, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("j", 1.5)], "k string, v double")
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r["k"]: r for r in boards.index_percentile(df, "k", "v", shares, 10**9).collect()}
    s = sorted(values)
    for name, p in shares.items():
        assert got["k"][name] == pytest.approx(s[min(int(len(s) * p), len(s) - 1)], abs=1e-8) and got["j"][name] == 1.5


def test_rates(spark):
    a, r = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("x",), ("z",)], "k string")
    assert rows(boards.rates(a, r, "k"), "k") == [("x", 2, 1, 0.667), ("y", 1, 0, 1.0), ("z", 0, 1, 0.0)]


def slow_features(t):
    import re

    n = re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", (t or "").lower())).strip()
    from millrace.functions.text import STOPWORDS

    s = n.replace(" ", "")
    return n, {w for w in n.split(" ") if len(w) > 1 and w not in STOPWORDS}, {s[i : i + 4] for i in range(len(s) - 3)}


def test_leaks_match_a_plain_loop(spark):
    rng = random.Random(3)
    words = ["beli", "kopi", "teh", "susu", "ya", "102500", "63.700", "yang", "ke", "é"]
    mk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [mk(rng.randint(1, 6)) for _ in range(15)] + ["ya", "x"]
    docs = [mk(rng.randint(0, 10)) for _ in range(60)] + items[:3] + ["oh " + items[4] + " lagi", None, "ok x", "", "k"]
    D, B = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d, b = similarity.features(D, "doc_id").cache(), similarity.features(B, "item_id").cache()
    amounts = lambda t: {int(w.replace(".", "")) for w in (t or "").split(" ") if w in ("102500", "63.700")}
    df = Counter(v for t in items for v in amounts(t))
    want = {}
    for i, x in enumerate(docs):
        n, t, g = slow_features(x)
        for j, y in enumerate(items):
            m, u, h = slow_features(y)
            jac = len(t & u) / len(t | u) if t and u else 0
            con = len(g & h) / min(len(g), len(h)) if g and h else 0
            shared = sum(1 for v in amounts(x) & amounts(y) if df[v] <= 2 and v % 1000)
            if n and n == m:
                want[i, j] = ("exact", 1)
            elif n and m and (n in m or m in n):
                want[i, j] = ("substring", 1)
            elif jac >= 0.5:
                want[i, j] = ("jaccard", jac)
            elif con >= 0.7:
                want[i, j] = ("ngram", con)
            elif shared:
                want[i, j] = ("amount", shared)
    got = {(r["doc_id"], r["item_id"]): (r["reason"], r["score"]) for r in similarity.leaks(d, b).collect()}
    assert {k: (v[0], pytest.approx(v[1])) for k, v in got.items()} == want
    own = similarity.features(B, "item_id")
    self_hits = similarity.leaks(own.withColumnRenamed("item_id", "doc_id"), own).where("doc_id = item_id and reason = 'exact'").count()
    assert self_hits == len(items)
    assert similarity.max_similarity(d, b).count() == len(docs)


def small_tables(tmp_path, docs, items):
    con = duckdb.connect()
    for name, key, texts in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        pq.write_table(pa.table({key: list(range(len(texts))), "text": pa.array(texts, pa.string()), "lang": ["x"] * len(texts)}), f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    return con


LEAK_QUERIES = ["leak_clean", "leak_report", "max_similarity", "ngram_containment", "token_jaccard"]


@pytest.mark.parametrize("name", LEAK_QUERIES)
def test_leak_queries_on_short_texts_and_amounts(spark, tmp_path, name):
    """Short texts inside an item without a token or gram of it, and shared amounts, are no leaks by the SQL."""
    from millrace.plans import registry

    registry.load()
    items = ["Se que osllra ñezll del does", "In. The thtion reed harga 102500", "x", "de", "𝒳𝒴𝒵𝒲 𐐷𐐷 plain", "kopi susu teh manis"]
    docs = ["A.", "De.", "Re.", "x", "bayar 102500", "in the thtion reed harga", "kopi susu", "𝒳𝒴𝒵𝒲 𐐷𐐷 plain", "𝒳𝒴𝒵 other words", "ñezll del", None, "", "  ", "kopi susu teh manis sekali", "e"]
    con = small_tables(tmp_path, docs, items)
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", LEAK_QUERIES)
def test_leak_queries_keep_and_shuffle_no_keys(spark, tmp_path, name):
    """Neither features nor keys of documents are kept, exploded or joined."""
    from millrace.plans import registry

    registry.load()
    small_tables(tmp_path, ["kopi susu teh", "a"], ["kopi susu teh manis"])
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Generate" not in plan


def test_large_corpora_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    words = ["beli", "kopi", "teh", "susu", "ya", "x", "é", "ßä", "gula", "manis"]
    mk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, items = [mk(rng.randint(0, 9)) for _ in range(40)] + [None, "k"], [mk(rng.randint(1, 6)) for _ in range(20)]
    D = spark.createDataFrame([*enumerate(docs), (None, "kopi susu")], "doc_id long, text string")
    d, b = similarity.features(D, "doc_id"), similarity.features(spark.createDataFrame([*enumerate(items), (None, "teh")], "item_id int, text string"), "item_id")

    def all_of():
        out = [similarity.leaks(d, b), similarity.leaks(d, b, by_keys=True), similarity.close_pairs(d, b), similarity.token_pairs(d, b, 0.1), similarity.max_similarity(d, b)]
        return [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.where("doc_id is not null").collect()) for x in out]

    one = all_of()
    assert all(one) and {r[0]: r[1] for r in one[4]} == pytest.approx({i: max(max(_measures(x, y)) for y in items) for i, x in enumerate(docs)}, abs=1e-8)
    monkeypatch.setattr(similarity, "BROADCAST_KEYS", 40)  # several chunks, and candidates by a shuffle
    assert all_of() == one


def _measures(x, y):
    (_, t, g), (_, u, h) = slow_features(x), slow_features(y)
    return len(t & u) / len(t | u) if t and u else 0, len(g & h) / min(len(g), len(h)) if g and h else 0


def test_exact_dedup(spark):
    df = spark.createDataFrame([(3, "A"), (1, "b"), (2, "a"), (4, None), (5, "")], "doc_id long, text string")
    assert rows(similarity.first_of_each(df), "doc_id") == [(1, 1), (2, 2), (4, 2)]


def test_batches(spark):
    e, a = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(3,), (1,), (1,), (9,)], "id long")
    assert {r["id"]: r["phase"] for r in batches.reconcile_ids(e, a, "id").collect()} == {1: "batch:duplicate", 2: "batch:missing", 3: "ok"}
    with pytest.raises(ValueError):
        batches.chunk_plan(e, "id", "id", 0)
    assert [r["id"] for r in batches.claim(e, a, "id", "id", 5).collect()] == [2]


def slow_apportion(weights, total, floor):
    s = sum(weights)
    exact = [w / s * total for w in weights]
    base = [max(floor, int(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (-(exact[i] - int(exact[i])), i))
    k = 0
    while sum(base) < total:
        base[order[k % len(order)]] += 1
        k += 1
    while sum(base) > total and max(base) > floor:
        base[base.index(max(base))] -= 1
    return base


@pytest.mark.parametrize("weights,total,floor", [([1, 2, 3], 10, 0), ([5, 5, 5], 10, 0), ([100, 1, 1, 1], 10, 2), ([50, 30, 1, 1, 1, 1], 20, 3), ([1, 1], 7, 0), ([9, 1, 1], 3, 2), ([40, 40, 1, 1], 10, 2)])
def test_apportion(spark, weights, total, floor):
    df = spark.createDataFrame(list(enumerate(weights)), "i long, w long")
    assert [r["share"] for r in sampling.apportion(df, "w", "i", total, floor).orderBy("i").collect()] == slow_apportion(weights, total, floor)


def test_holdouts(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice("abc"), rng.choice("xyz"), rng.choice("mnopq")) for i in range(120)] + [(200, "only", "x", "m")], "id long, a string, b string, c string")
    split = sampling.stratified_holdout(df, "a", "id", 0.08, 42)
    n = {(r["a"], r["split"]): r["count"] for r in split.groupBy("a", "split").count().collect()}
    assert n.get(("only", "eval_iid"), 0) == 0 and all(n[x, "eval_iid"] == max(1, int((n[x, "eval_iid"] + n[x, "train"]) * 0.08 + 0.5)) for x in "abc")
    comp = sampling.compositional_holdout(df, ["a", "b", "c"], "id", 0.05, 42)
    held = [r for r in comp.collect() if r["split"] != "train"]
    kept = [r for r in comp.collect() if r["split"] == "train"]
    assert len(comp.collect()) == 121 and 0 < len(held) <= 6
    for r in held:
        assert all(any(k[x] == r[x] for k in kept) for x in "abc") and not any((k["a"], k["b"], k["c"]) == (r["a"], r["b"], r["c"]) for k in kept)
    plan = sampling.expand_plan(spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "id long, n int"), "id", "n", 5)
    assert sorted((r["plan_index"], ) for r in plan.collect()) == [(i,) for i in range(5)] and Counter(r["id"] for r in plan.collect()) == {1: 3, 3: 2}
    assert sampling.expand_plan(spark.createDataFrame([(1, 9)], "id long, n int"), "id", "n", 5, limit=4).count() == 4


WANT = "array<struct<type:string,jumlah:bigint,tanggal_hint:string,jumlah_min:bigint,jumlah_max:bigint,ambigu:boolean,words:array<string>>>"
GOT = "array<struct<type:string,jumlah:bigint,tanggal_hint:string,deskripsi:string,vendor:string,ambigu:boolean,catatan_ambigu:string>>"


def want(type_, n, hint=None, lo=None, hi=None, ambigu=False, words=()):
    return (type_, n, hint, lo, hi, ambigu, list(words))


def got(type_, n, hint="tidak_jelas", text="", vendor=None, ambigu=False):
    return (type_, n, hint, text, vendor, ambigu, None)


def slow_credit(g, w):
    if g[0] != w[0]:
        return 0
    c = 35
    inside = g[1] == w[1] and (w[3] is None or g[1] >= w[3]) and (w[4] is None or g[1] <= w[4])
    if inside:
        c += 40
    elif w[3] is None and w[4] is None and min(g[1], w[1]) / max(g[1], w[1], 1) >= 0.9:
        c += 30
    c += 10 if w[2] is None else 15 if g[2] == w[2] else 8 if g[2] == "tidak_jelas" else 0
    text = f"{g[3]} {g[4] or ''}".lower()
    return min(100, c + (10 if not w[6] or any(x.lower() in text for x in w[6]) else 0))


def slow_best(gs, ws):
    left, s = list(range(len(gs))), [0, 0, 0, 0]
    for w in ws:
        best, at = 0, None
        for i in left:
            c = slow_credit(gs[i], w)
            if c > best:
                best, at = c, i
        if at is None or best < 40:
            continue
        left.remove(at)
        g = gs[at]
        inside = g[1] == w[1] and (w[3] is None or g[1] >= w[3]) and (w[4] is None or g[1] <= w[4])
        s[0] += 100 if inside else 70 if min(g[1], w[1]) / max(g[1], w[1], 1) >= 0.9 else 20
        s[1] += 100 if g[0] == w[0] else 0
        s[2] += 100 if w[2] is None or g[2] == w[2] else 60 if g[2] == "tidak_jelas" else 0
        s[3] += 100 if not w[5] or g[5] else 40
    return [x / max(1, len(ws)) for x in s] + [len(left)]


def test_scoring_matches_plain_loops(spark):
    rng = random.Random(8)
    t, h = ["pengeluaran", "pemasukan"], ["hari_ini", "kemarin", None]
    cases = []
    for _ in range(80):
        ws = [want(rng.choice(t), rng.choice([0, 10, 1000, 1050]), rng.choice(h), *rng.choice([(None, None), (900, None), (None, 1100)]), rng.random() < 0.3, rng.choice([[], ["Kopi"], ["teh", "susu"]])) for _ in range(rng.randint(0, 4))]
        gs = [got(rng.choice(t), rng.choice([0, 10, 1000, 1050, 950]), rng.choice(["hari_ini", "tidak_jelas", "kemarin"]), rng.choice(["kopi", "teh manis", ""]), rng.choice([None, "susu"]), rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        cases.append((gs, ws))
    df = spark.createDataFrame(cases, f"got {GOT}, want {WANT}")
    out = df.select("got", "want", scoring.best_credit(F.col("got"), F.col("want")).alias("c"), scoring.greedy(F.col("got"), F.col("want")).alias("m")).collect()
    for r in out:
        gs, ws = [tuple(x) for x in r["got"]], [tuple(x) for x in r["want"]]
        assert list(r["c"]) == pytest.approx(slow_best(gs, ws))

        def fits(g, w):
            amount = (w[3] or w[1]) <= g[1] <= (w[4] or w[1]) if w[3] is not None or w[4] is not None else g[1] == w[1]
            hint = w[2] is None or g[2] in (None, "tidak_jelas", w[2])
            text = f"{g[3]} {g[4] or ''}".lower()
            return g[0] == w[0] and amount and hint and (not w[5] or g[5]) and (not w[6] or any(x.lower() in text for x in w[6]))

        left, n = list(gs), 0
        for w in ws:
            at = next((i for i, g in enumerate(left) if fits(g, w)), None)
            if at is not None:
                left.pop(at)
                n += 1
        assert tuple(r["m"]) == (n, len(left))


def test_composites_tiers_and_layouts(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert f(scoring.composite(*(lit(x) for x in (100, 100, 100, 100, 100, 100)), lit(False))) == 100
    assert f(scoring.composite(lit(20), lit(50), lit(10), lit(0), lit(0), lit(0), lit(True))) == 92
    assert f(scoring.no_hallucination(lit(2), lit(1), lit(True), lit(True))) == 0 and f(scoring.entry_count_score(lit(3), lit(2), lit(False))) == 75
    assert [f(scoring.tier(lit(s), lit(c), lit(1), lit(p), lit(False), lit(60))) for s, c, p in ((True, 1, False), (False, 70, True), (False, 50, True), (False, 49, True), (False, 49, False))] == ["excellent", "usable_with_edit", "partially_usable", "misleading", "broken"]
    df = spark.createDataFrame([([got("pengeluaran", 24, text="Bakmi ayam"), got("pengeluaran", 5, text="fee")], [want("pengeluaran", 12, words=["bakmi"]), want("pengeluaran", 24, words=["sarden"])])], f"got {GOT}, want {WANT}")
    rule = "named_struct('kind', '{}', 'keyword', 'bakmi', 'unit', 12L, 'count', 2, 'principal', 24L, 'fee', 5L, 'personal', 9L, 'total', 24L)"
    assert [df.select(scoring.alt_strict(F.col("got"), F.expr(rule.format(k)), F.lit(True)).alias("x")).first()["x"] for k in ("qtyMerge", "principalPlusFee", "personalShare", "other")] == [True, True, False, False]
    assert df.select(scoring.price_copied(F.col("got"), F.col("want")).alias("x")).first()["x"] is True


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('tanggal, jumlah ,x\n\n 1 , Rp -1.5,"a,b"\n2\n3,4,5,6\n')
    got_ = sorted(map(tuple, files.read_naive_csv(spark, str(tmp_path / "a.csv"), ["tanggal", "jumlah", "x"]).collect()))
    assert got_ == [("1", "Rp -1.5", '"a'), ("2", "", ""), ("3", "4", "5")]
    d = tmp_path / "runs"
    d.mkdir()
    (d / "b.json").write_text('{"kind": "parse-base", "modelId": "m", "runAt": "2026", "passCount": 3, "total": 28}')
    (d / "h.json").write_text('{"kind": "parse-hard-25", "model": "m", "results": [{"strictPass": true, "quality": {"compositeScore": 80}}, {"strictPass": false, "quality": {"compositeScore": 91}}]}')
    (d / "bad.json").write_text("{oops")
    (d / "no.txt").write_text("{}")
    a = files.artifacts(spark, str(d)).withColumn("kind", files.artifact_kind(F.col("doc"), F.col("path"))).cache()
    assert sorted(r["kind"] for r in a.collect()) == ["base", "hard"]
    assert tuple(a.where("kind = 'base'").select(files.base_snapshot(F.col("doc")).alias("s")).first()["s"]) == ("m", "2026", 3, 28, 0.0)
    s = a.where("kind = 'hard'").select(files.hard_snapshot(F.col("doc")).alias("s")).first()["s"]
    assert (s["model"], s["hard_strict"], s["hard_total"], s["composite"]) == ("m", 1, 2, 85.5)
    plan = spark.createDataFrame([(1, "a"), (2, "b")], "plan_index long, text string")
    for _ in range(2):
        files.append_lines(plan, str(tmp_path / "raw"), "plan_index")
    assert spark.read.json(str(tmp_path / "raw")).count() == 2
    files.write_splits(plan.withColumn("split", F.lit("train")), str(tmp_path / "out"), "plan_index")
    assert spark.read.json(str(tmp_path / "out")).where("split = 'train'").count() == 2
    files.write_csv(spark.createDataFrame([(1, 'say "x", y'), (2, None)], "n long, t string"), str(tmp_path / "q"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "q").glob("*.csv")))
    assert '1,"say ""x"", y"\n' in text and "2,\n" in text and text.startswith("n,t\n")
    kinds = spark.createDataFrame([("a.PNG",), ("b.csv",), ("c.pdf.txt",), ("d",)], "p string").select(files.file_kind(F.col("p")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["image", "csv", "pdf", "file"]


def test_receipts_and_statements(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"receipts": [{"file": "a.png", "path": "x/a.png", "vendor": "Warung Bu Sri", "total": 85000, "tanggal": "2026-07-01", "items": [{"name": "soto", "jumlah": 85000}]},\n {"file": "b.png", "vendor": "Toko Jaya", "total": 5000, "tanggal": null, "items": []}]}')
    r = files.receipts(spark, str(tmp_path / "m.json"))
    assert r.count() == 2
    images = spark.createDataFrame([("in/A.PNG",), ("in/struk-toko-02.jpg",), ("in/other.jpg",)], "path string")
    assert sorted(map(tuple, files.match_receipts(images, r).collect())) == [("in/A.PNG", "Warung Bu Sri", 85000), ("in/struk-toko-02.jpg", "Toko Jaya", 5000)]
    text = spark.createDataFrame([("p", "Bank\n01/07 Gaji bulan Rp 4.500.000\n 02/07 kopi Rp12.000 \nsaldo Rp 1")], "path string, value string")
    assert sorted(tuple(x)[1:] for x in files.statement_lines(text).collect()) == [("01/07", "Gaji bulan", 4500000), ("02/07", "kopi", 12000)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big").write_text("xxxx")
    (tmp_path / "d" / "small").write_text("")
    assert [x["path"].rsplit("/", 1)[1] for x in files.present_files(spark, str(tmp_path / "d"), 2).collect()] == ["big"]


def test_streams(spark, tmp_path):
    from millrace.streaming import log

    src = tmp_path / "in"
    data = spark.createDataFrame([(1, "2026-01-01 00:00:01", "ok"), (1, "2026-01-01 00:00:02", "ok"), (2, "2026-01-01 00:05:00", "bad")], "id long, t string, v string").select("id", F.to_timestamp("t").alias("t"), "v")
    data.write.parquet(str(src))
    stream = spark.readStream.schema(data.schema).parquet(str(src))
    q = log.split_sink(log.first_seen(stream, ["id"], "t"), str(tmp_path / "ok"), str(tmp_path / "no"), F.when(F.col("v") == "bad", "text:bad"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "ok")).count() == 1 and spark.read.json(str(tmp_path / "no")).first()["phase"] == "text:bad"
    c = log.windowed_counts(stream, "t", ["v"], "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    c.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]


@pytest.mark.parametrize("sent", [500_000, 0])
def test_vendors_match_a_plain_loop(spark, monkeypatch, sent):
    """Cells with repeated and missing ids, vendors and cells without a rail."""
    monkeypatch.setattr(sampling, "BROADCAST_VENDORS", sent)
    rng = random.Random(11)
    cells = [(rng.choice([None, *range(60)]), rng.choice([1, 2, 3, None]), *rng.choice([(0, 30), (30, 100), (None, 9)]), rng.choice(["in", "out", None]), rng.choice([0, 1, 2, None])) for _ in range(120)]
    vendors = [(k, rng.choice([1, 2, 4, None]), *(lambda x: (x, x + 5.0))(float(rng.randint(-20, 110))), rng.choice(["any", "in", "out", None]), rng.choice([0, 1, None])) for k in range(90)]
    C = spark.createDataFrame(cells, "cell_id long, region int, band_lo int, band_hi int, direction string, rail long")
    V = spark.createDataFrame(vendors, "s_suppkey long, v_region int, lo double, hi double, polarity string, v_rail long")
    pairs = []
    for i, region, a, b, way, rail in cells:
        for k, v_region, lo, hi, polarity, v_rail in vendors:
            if None not in (region, a, b, lo) and region == v_region and lo < b and a < hi + 1 and (polarity == "any" or polarity is not None and polarity == way):
                pairs.append((i, k, None if None in (rail, v_rail) else rail == v_rail))
    told = {i: {p[2] for p in pairs if p[0] == i and p[2] is not None} for i, *_ in pairs}
    want = [p[:2] for p in pairs if p[2] or told[p[0]] == {False}]
    assert 30 < len(want) < len(pairs) - 30
    df = sampling.vendors_for(C, V)
    assert Counter((r["cell_id"], r["s_suppkey"]) for r in df.collect()) == Counter(want)
    assert set(df.columns) == {*C.columns, *V.columns, "on_rail"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the pairs are made last


@pytest.mark.parametrize("sent", [500_000, 0])
def test_vendor_pairs_take_little_room(spark, monkeypatch, tmp_path, sent):
    """Pairs in many blocks and parts are those of a plain loop; written, they take under half a byte each."""
    monkeypatch.setattr(sampling, "BROADCAST_VENDORS", sent)
    monkeypatch.setattr(sampling, "NUMBERED_CELLS", 60, raising=False)
    rng = random.Random(5)
    cells = [(i, i % 2, *rng.choice([(0, 30), (30, 100)]), rng.choice(["in", "out"]), rng.choice([0, 1]), f"name {i}") for i in range(2000)]
    vendors = [(k, k % 2, *(lambda x: (x, x + 5.0))(float(rng.randint(-20, 110))), rng.choice(["any", "in", "out"]), rng.choice([0, 1, 2])) for k in range(1500)]
    rng.shuffle(cells)
    C = spark.createDataFrame(cells, "cell_id long, region int, band_lo int, band_hi int, direction string, rail long, name string")
    V = spark.createDataFrame(vendors, "s_suppkey long, v_region int, lo double, hi double, polarity string, v_rail long")
    want = set()
    for i, region, a, b, way, rail, _ in cells:
        fit = [(i, k, v_rail == rail) for k, v_region, lo, hi, polarity, v_rail in vendors if region == v_region and lo < b and a < hi + 1 and polarity in ("any", way)]
        want |= {x[:2] for x in fit if x[2] or not any(y[2] for y in fit)}
    df = sampling.vendors_for(C, V)
    df.select("cell_id", "s_suppkey").write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs")).toPandas()
    assert len(got) == len(want) > 100_000 and set(zip(got["cell_id"].tolist(), got["s_suppkey"].tolist())) == want
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < len(want) / 2
    odd = df.where("name <> concat('name ', cell_id) or region <> v_region or region <> cell_id % 2 or on_rail <> (rail = v_rail)")
    assert odd.count() == 0
