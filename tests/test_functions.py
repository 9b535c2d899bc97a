"""Column functions against small known vectors."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import amounts, labels, rng, text
from millrace.operators import sampling


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], [*cols]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


AMOUNTS = [
    ("kopi 12rb", [("12rb", 12000, "suffix")]), ("bonus 2,5jt", [("2,5jt", 2500000, "suffix")]), ("teh 27.5k", [("27.5k", 27500, "suffix")]), ("bayar 63.700", [("63.700", 63700, "dot")]),
    ("12.500 rb", [("12.500 rb", 12500000, "suspect-dot-suffix")]), ("ceban", [("ceban", 10000, "slang")]), ("setengah  juta", [("setengah  juta", 500000, "spelled")]), ("sejutaan", []), ("seket ewu", [("seket ewu", 50000, "spelled")]),
    ("Sewu", [("Sewu", 1000, "spelled")]), ("seket", []), ("beras 500 gram", []), ("2 lusin", []), ("500 grams", [("500", 500, "bare")]), ("Rp. 15.000 dan Rp7", [("Rp. 15.000", 15000, "rp"), ("Rp7", 7, "rp")]), ("99 100", [("100", 100, "bare")]),
    ("1.500,50 rb", [("1.500,50 rb", 1500500, "suffix")]), ("1.2.3 k", [("1.2.3 k", None, "suffix")]), ("kéban", []), ("😀 ceban 5000", [("ceban", 10000, "slang"), ("5000", 5000, "bare")]), ("", []), ("350.000rb", [("350.000rb", 350000000, "suspect-dot-suffix")]), ("25ribuan", []),
]


def test_amounts_in_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in AMOUNTS], "t string").select("t", amounts.amount_atoms(F.col("t")).alias("a"))
    for r in df.collect():
        want = dict(AMOUNTS)[r["t"]]
        assert [(x["raw"], x["value"], x["kind"]) for x in r["a"]] == want, r["t"]
        assert all(r["t"][x["start"] : x["end"]] == x["raw"] for x in r["a"])


def test_trace_and_excuses(spark):
    df = spark.createDataFrame([("teh 5rb",)], "t string").withColumn("a", amounts.amount_atoms(F.col("t")))
    got = df.select(*(amounts.trace(F.lit(v), F.col("a")).alias(f"v{v}") for v in (5000, 20000, 7))).first()
    assert [tuple(x) for x in got] == [("direct", "5rb"), ("derived", "5000×4"), ("none", None)]
    two = spark.createDataFrame([("10rb sama 3rb",)], "t string").withColumn("a", amounts.amount_atoms(F.col("t")))
    got = two.select(*(amounts.trace(F.lit(v), F.col("a")).alias(f"v{v}") for v in (13000, 7000, 6000))).first()
    assert [tuple(x) for x in got] == [("derived", "10000+3000"), ("derived", "|10000-3000|"), ("derived", "3000×2")]
    near, far = "bukan 20rb, tapi 5rb", "bukan" + " x" * 40 + " 20rb"
    d = spark.createDataFrame([(near,), (far,)], "t string").withColumn("a", amounts.amount_atoms(F.col("t")))
    left = d.select(F.size(amounts.unexcused(F.col("t"), F.col("a"), F.array(F.lit(5000).cast("long")))).alias("n")).collect()
    assert [r["n"] for r in left] == [0, 1]
    assert one(spark, amounts.ambiguous(amounts.amount_atoms(F.lit("12.500 rb"))))


def test_render_then_read_is_identity_on_a_ladder(spark):
    ladder = [500, 1000, 7500, 12500, 62500, 100000, 550000, 1000000, 1250000, 60000000]
    df = spark.createDataFrame([(v,) for v in ladder], "v long")
    for n in amounts.NOTATIONS:
        for r in df.select("v", amounts.render(F.col("v"), n).alias("s")).withColumn("a", amounts.amount_atoms(F.col("s"))).where("s is not null").collect():
            assert [x["value"] for x in r["a"]] == [r["v"]], (n, r["s"])


@pytest.mark.parametrize("raw,want", [("2,5jt", 2500000), ("12.500rb", 12500000), ("1.5rb", 1500), ("25k", 25000), ("Rp 15.000", 15000), ("", 0), (None, 0), ("3 juta", 3000000), ("abc", 0)])
def test_lenient_amount(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(amounts.lenient_amount(F.col("r")).alias("x")).first()["x"] == want


def test_bands_and_distinctive(spark):
    rows = spark.createDataFrame([(99,), (100,), (4999,), (5000,), (99999999,), (100000000,)], "v long").select(amounts.band(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in rows] == [None, "receh", "receh", "kecil", "jumbo", None]
    d = spark.createDataFrame([(25000, 1), (102500, 2), (102500, 3), (9500, 1), (102500, None)], "v long, df int").select(amounts.distinctive(F.col("v"), F.col("df")).alias("x")).collect()
    assert [r["x"] for r in d] == [False, True, False, False, True]


def test_text_sets(spark):
    assert one(spark, text.chat_norm(F.lit("  Beli KOPI!!  12rb,ya  é "))) == "beli kopi 12rb ya é"
    assert one(spark, text.grading_norm(F.lit(" A,  b\n"))) == "a, b"
    assert sorted(one(spark, text.content_tokens(F.lit("beli kopi yang kopi x")))) == ["beli", "kopi"]
    assert sorted(one(spark, text.char_grams(F.lit("ab cde")))) == ["abcd", "bcde"] and one(spark, text.char_grams(F.lit("abc"))) == []
    assert sorted(one(spark, text.word_grams(F.lit("a b c d")))) == ["a b c", "b c d"] and one(spark, text.word_grams(F.lit("a b"))) == []
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    assert one(spark, text.jaccard(a, b)) == 0.5 and one(spark, text.containment(a, b)) == 1.0 and one(spark, text.jaccard(a, F.array().cast("array<string>"))) == 0.0
    assert one(spark, text.batch_text(F.lit(' "halo kamu"\nlagi'))) == "halo kamu" and one(spark, text.batch_text(F.lit("``a``"))) is None
    assert one(spark, text.first_json_block(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}' and one(spark, text.first_json_block(F.lit('ok {"a": {"b": 2}} ok'))) == '{"a": {"b": 2}}'
    assert one(spark, text.js_round(F.lit(-2.5))) == -2 and one(spark, text.csv_cell(F.lit('a"b'))) == '"a""b"' and one(spark, text.csv_cell(F.lit("a b"))) == "a b"


def slow_draws(seed, n):
    out, a = [], seed
    for _ in range(n):
        a = (a + rng.STEP) % 2**32
        out.append(sampling._number(a))
    return out


def test_generator_matches_its_sequential_form(spark):
    got = [r["x"] for r in spark.range(1, 501).orderBy("id").select(rng.draw(F.lit(42), F.col("id")).alias("x")).collect()]
    assert got == slow_draws(42, 500)
    assert got[:2] == [0.6011037519201636, 0.44829055899754167]
    assert one(spark, rng.draw(F.lit(2**32 + 42), F.lit(1))) == got[0]
    assert sorted(sampling.shuffle_small(range(50), 7)) == list(range(50)) != sampling.shuffle_small(range(50), 7)


def test_coercions(spark):
    d = spark.createDataFrame([("Tadi", "0.9", "Income"), (None, None, None), ("minggu  ini", "0.6", "x"), ("??", "abc", "masuk"), ("kmrn", "low", "credit"), ("lusa", "0.1", "")], "h string, c string, t string")
    got = [tuple(r) for r in d.select(labels.date_hint(F.col("h")), labels.confidence(F.col("c")), labels.direction(F.col("t"))).collect()]
    assert got == [("hari_ini", "high", "pemasukan"), (None, "low", "pengeluaran"), ("minggu_ini", "medium", "pengeluaran"), ("tidak_jelas", "medium", "pemasukan"), ("kemarin", "low", "pemasukan"), ("lusa", "low", "pengeluaran")]


def test_lenient_label(spark):
    said = 'Sure! {"transaksi": [{"type": "income", "amount": "12rb", "description": "kopi", "ambigu": "false"}, {"jumlah": 5000, "ambigu": 0}], "ringkasan": null}'
    got = spark.createDataFrame([(said,), ("no json",), ("{broken",), ('{"entries": [], "bukan_transaksi": true}',)], "s string").select(labels.lenient_label(F.col("s")).alias("x")).collect()
    e = got[0]["x"]["entries"]
    assert [(x["type"], x["jumlah"], x["deskripsi"], x["ambigu"]) for x in e] == [("pemasukan", 12000, "kopi", True), ("pengeluaran", 5000, "", False)] and got[0]["x"]["bukan_transaksi"] is False
    assert got[1]["x"] is None and got[2]["x"] is None and got[3]["x"]["bukan_transaksi"] is True


def entry(**over):
    return {"type": "pengeluaran", "tanggal_hint": "kemarin", "deskripsi": "kopi", "jumlah": 5000, "kategori": None, "vendor": None, "confidence": "low", "ambigu": False, "catatan_ambigu": None} | over


def label_frame(spark, *cases):
    return spark.createDataFrame([({"entries": e, "bukan_transaksi": b, "ringkasan": None},) for e, b in cases], f"label struct<entries:array<{labels.ENTRY}>,bukan_transaksi:boolean,ringkasan:string>")


def test_strict_rules(spark):
    df = label_frame(spark, ([entry()], False), ([entry()], True), ([entry(jumlah=0)], False), ([entry(ambigu=True, confidence="high")], False), ([entry(deskripsi=" ")], False), ([entry(deskripsi="a b c d e f g h i", tanggal_hint="lusa")], False), ([entry(), entry()], False), ([entry(catatan_ambigu="x")], False))
    got = [r["x"] for r in df.select(labels.strict_issues(F.col("label")).alias("x")).collect()]
    assert got == [[], ["flag"], ["amount"], ["note_missing", "sure_but_ambiguous"], ["empty_text"], ["long_text", "future"], ["duplicate"], ["note_unflagged"]]


def test_agreement(spark):
    want = lambda *a: [{"type": "pengeluaran", "jumlah": x, "tanggal_hint": None, "ambigu": None} for x in a]
    df = label_frame(spark, ([entry(jumlah=2), entry(jumlah=1)], False))
    alt = "array<array<struct<type:string,jumlah:bigint,tanggal_hint:string,ambigu:boolean>>>"
    for alts, none, absent, diffs in (([want(1, 2)], False, [], []), ([want(3), want(2, 1)], False, [], []), ([want(1, 5)], False, [], ["jumlah"]), ([want(1)], False, [2], ["absent:2", "count"]), ([], True, [], ["non_transaction"])):
        spec = spark.createDataFrame([(alts, none, absent)], f"alts {alt}, none boolean, absent array<bigint>")
        assert df.crossJoin(spec).select(labels.agreement(F.col("label"), F.col("none"), F.col("alts"), F.col("absent")).alias("x")).first()["x"] == diffs
