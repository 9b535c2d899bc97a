"""Scoring queries: an order's lines are the wanted entries, altered lines the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scoring as fn
from millrace.plans.registry import query
from millrace.sources.tables import table


def graded(spark, d):
    """l_orderkey, want and got arrays, and whether the answer was flagged as no transaction."""
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "pemasukan").otherwise("pengeluaran")
    amount = (F.floor(F.col("l_extendedprice") / 1000) * 1000).cast("long")
    hint = F.when(F.col("l_linestatus") == "O", "hari_ini").otherwise("kemarin")
    none = F.lit(None).cast("long")
    want = F.struct(F.col("l_linenumber").alias("n"), kind.alias("type"), amount.alias("jumlah"), hint.alias("tanggal_hint"), none.alias("jumlah_min"), none.alias("jumlah_max"), (F.col("l_returnflag") == "A").alias("ambigu"), F.array(F.concat(F.lit("part"), "l_partkey")).alias("words"))
    off = F.when(F.col("l_linenumber") == 3, amount + 1000).when(F.col("l_linenumber") == 6, 0).otherwise(amount)
    turned = F.when(F.col("l_linenumber") == 4, F.when(F.col("l_returnflag") == "R", "pengeluaran").otherwise("pemasukan")).otherwise(kind)
    got = F.struct((-F.col("l_linenumber")).alias("n"), turned.alias("type"), off.cast("long").alias("jumlah"), F.when(F.col("l_linenumber") == 2, "tidak_jelas").otherwise(hint).alias("tanggal_hint"), F.concat(F.lit("Part"), F.col("l_partkey").cast("string"), F.lit("  x")).alias("deskripsi"), F.lit(None).cast("string").alias("vendor"), ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") != 1)).alias("ambigu"), F.lit(None).cast("string").alias("catatan_ambigu"))
    # an order has few lines by nature; sorted, so that grading meets them in a fixed order
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(want)).alias("want"), F.sort_array(F.collect_list(F.when(F.col("l_linenumber") != 5, got))).alias("got"))
    return g.withColumn("flagged", F.col("l_orderkey") % 13 == 0)


G = """WITH li AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'pemasukan' ELSE 'pengeluaran' END AS type, CAST(floor(l_extendedprice / 1000) * 1000 AS BIGINT) AS jumlah, l_returnflag = 'A' AS ambigu, l_partkey FROM lineitem),
got AS (SELECT l_orderkey, n, CASE WHEN n = 4 THEN CASE WHEN type = 'pemasukan' THEN 'pengeluaran' ELSE 'pemasukan' END ELSE type END AS type, CASE WHEN n = 3 THEN jumlah + 1000 WHEN n = 6 THEN 0 ELSE jumlah END AS jumlah, l_partkey FROM li WHERE n <> 5),
w AS (SELECT l_orderkey, type, jumlah, count(*) AS c FROM li GROUP BY ALL), g AS (SELECT l_orderkey, type, jumlah, count(*) AS c FROM got GROUP BY ALL),
m AS (SELECT w.l_orderkey, sum(least(w.c, coalesce(g.c, 0))) AS matched FROM w LEFT JOIN g USING (l_orderkey, type, jumlah) GROUP BY 1)
"""


@query(G + """SELECT l_orderkey, CAST(matched AS INTEGER) AS matched, CAST((SELECT count(*) FROM got WHERE got.l_orderkey = m.l_orderkey) - matched AS INTEGER) AS extra FROM m""")
def greedy_match(spark, d):
    """On amount and direction alone, where greedy matching has a closed form."""
    m = fn.greedy(F.col("got"), F.col("want"), lambda g, w: (g["type"] == w["type"]) & (g["jumlah"] == w["jumlah"]))
    return graded(spark, d).select("l_orderkey", m.alias("m")).select("l_orderkey", "m.matched", "m.extra")


#: Answers and wanted entries of every order as lists, in the order that grading meets them.
LISTS = """WITH RECURSIVE li AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'pemasukan' ELSE 'pengeluaran' END AS type, CAST(floor(l_extendedprice / 1000) * 1000 AS BIGINT) AS jumlah, CASE WHEN l_linestatus = 'O' THEN 'hari_ini' ELSE 'kemarin' END AS hint, l_returnflag = 'A' AS ambigu, 'part' || l_partkey AS word FROM lineitem),
ga AS (SELECT o, -n AS n, CASE WHEN n = 4 THEN CASE WHEN type = 'pemasukan' THEN 'pengeluaran' ELSE 'pemasukan' END ELSE type END AS type, CASE WHEN n = 3 THEN jumlah + 1000 WHEN n = 6 THEN 0 ELSE jumlah END AS jumlah, CASE WHEN n = 2 THEN 'tidak_jelas' ELSE hint END AS hint, word || ' x' AS said, ambigu AND n <> 1 AS ambigu FROM li WHERE n <> 5),
lists AS (SELECT o, want, coalesce(got, []) AS got FROM (SELECT o, list({'n': n, 'type': type, 'jumlah': jumlah, 'hint': hint, 'ambigu': ambigu, 'word': word} ORDER BY n, type, jumlah, hint, ambigu, word) AS want FROM li GROUP BY o)
LEFT JOIN (SELECT o, list({'n': n, 'type': type, 'jumlah': jumlah, 'hint': hint, 'ambigu': ambigu, 'said': said} ORDER BY n, type, jumlah, hint, said, ambigu) AS got FROM ga GROUP BY o) USING (o)),
"""
NEAR = "least({g}.jumlah, {w}.jumlah) * 10 >= greatest({g}.jumlah, {w}.jumlah, 1) * 9"
#: The rule of partial credit for an answer g and a wanted entry w.
CREDIT = f"""CASE WHEN {{g}}.type = {{w}}.type THEN 35 + CASE WHEN {{g}}.jumlah = {{w}}.jumlah THEN 40 WHEN {NEAR} THEN 30 ELSE 0 END
 + CASE WHEN {{g}}.hint = {{w}}.hint THEN 15 WHEN {{g}}.hint = 'tidak_jelas' THEN 8 ELSE 0 END + CASE WHEN contains({{g}}.said, {{w}}.word) THEN 10 ELSE 0 END ELSE 0 END"""
WITHOUT = "CASE WHEN place > 0 THEN list_concat(rest[1:place - 1], rest[place + 1:]) ELSE rest END"
#: Each wanted entry in order takes the first answer left that matches.
MATCHED = f"""matched AS (SELECT o, want, got AS rest, 1 AS i, 0 AS n FROM lists UNION ALL
SELECT o, want, {WITHOUT}, i + 1, n + CASE WHEN place > 0 THEN 1 ELSE 0 END FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda g: g.type = want[i].type AND g.jumlah = want[i].jumlah AND (g.hint = 'tidak_jelas' OR g.hint = want[i].hint) AND (NOT want[i].ambigu OR g.ambigu) AND contains(g.said, want[i].word)), true), 0) AS place FROM matched WHERE i <= len(want))),
strict AS (SELECT o, n = len(want) AND len(rest) = 0 AND o % 13 <> 0 AS strict FROM matched WHERE i = len(want) + 1)"""
#: Each wanted entry in order takes the answer left with the most credit, from 40 on.
BEST = f"""taken AS (SELECT o, want, got AS rest, 1 AS i, 0 AS amount, 0 AS type, 0 AS date, 0 AS ambigu FROM lists UNION ALL
SELECT o, want, {WITHOUT}, i + 1, amount + CASE WHEN place = 0 THEN 0 WHEN g.jumlah = w.jumlah THEN 100 WHEN {NEAR.format(g="g", w="w")} THEN 70 ELSE 20 END, type + CASE WHEN place > 0 AND g.type = w.type THEN 100 ELSE 0 END,
date + CASE WHEN place = 0 THEN 0 WHEN g.hint = w.hint THEN 100 WHEN g.hint = 'tidak_jelas' THEN 60 ELSE 0 END, ambigu + CASE WHEN place = 0 THEN 0 WHEN NOT w.ambigu OR g.ambigu THEN 100 ELSE 40 END
FROM (SELECT *, want[i] AS w, rest[place] AS g FROM (SELECT *, CASE WHEN coalesce(list_max(c), 0) >= 40 THEN list_position(c, list_max(c)) ELSE 0 END AS place FROM (SELECT *, list_transform(rest, lambda g: {CREDIT.format(g="g", w="want[i]")}) AS c FROM taken WHERE i <= len(want))))),
best AS (SELECT o, amount / len(want)::DOUBLE AS amount, type / len(want)::DOUBLE AS type, date / len(want)::DOUBLE AS date, ambigu / len(want)::DOUBLE AS ambigu, CAST(len(rest) AS INTEGER) AS extra FROM taken WHERE i = len(want) + 1)"""
#: An answer that carries another wanted line's amount than its own, which is the first whose word it has.
COPIED = """own AS (SELECT o, want, g, coalesce(list_position(list_transform(want, lambda w: contains(g.said, w.word)), true), 0) AS place FROM (SELECT o, want, unnest(got) AS g FROM lists)),
bled AS (SELECT DISTINCT o FROM own WHERE place > 0 AND g.jumlah <> want[place].jumlah AND list_contains(list_transform(list_concat(want[1:place - 1], want[place + 1:]), lambda w: w.jumlah), g.jumlah)),
copied AS (SELECT o, o IN (SELECT o FROM bled) AS copied FROM lists)"""


@query(LISTS + MATCHED + " SELECT o AS l_orderkey, strict FROM strict")
def strict_pass(spark, d):
    """Every order, ties and low prices too."""
    return graded(spark, d).select("l_orderkey", fn.strict_pass(F.col("flagged"), F.col("got"), F.col("want"), F.lit(False)).alias("strict"))


@query(LISTS.rstrip(",\n") + f" SELECT li.o AS l_orderkey, li.n AS l_linenumber, {CREDIT.format(g='ga', w='li')} AS credit FROM li JOIN ga ON ga.o = li.o AND ga.n = -li.n")
def partial_credit(spark, d):
    """Each wanted line against each line of the answer that has its number."""
    pairs = F.flatten(F.transform("want", lambda w: F.transform(F.filter("got", lambda x: x["n"] == -w["n"]), lambda x: F.struct(w["n"].alias("l_linenumber"), fn.partial_credit(x, w).alias("credit")))))
    return graded(spark, d).select("l_orderkey", F.inline(pairs))


@query(LISTS + BEST + " SELECT o AS l_orderkey, * EXCLUDE (o) FROM best")
def best_credit(spark, d):
    """Greedy by credit over every order."""
    return graded(spark, d).select("l_orderkey", fn.best_credit(F.col("got"), F.col("want")).alias("c")).select("l_orderkey", "c.*")


#: Points in whole millionths, so that rounding needs no floating point.
MICRO = "CAST(round({} * 1000000) AS HUGEINT)"
COMPOSITE = f""", s AS (SELECT o, strict, copied, b.*, len(got) AS n_got, len(want) AS n_want, len(list_filter(got, lambda g: g.jumlah = 0)) AS zero,
len(list_filter(got, lambda g: g.type = 'pemasukan')) > len(list_filter(want, lambda w: w.type = 'pemasukan')) OR len(list_filter(got, lambda g: g.type = 'pemasukan' AND g.jumlah = 0)) > 0 AS spurious
FROM lists JOIN strict USING (o) JOIN copied USING (o) JOIN (SELECT o, amount, type, date, ambigu, extra FROM best) b USING (o)),
c AS (SELECT *, greatest(0, 100 - extra * 25 - zero * 30 - CASE WHEN spurious THEN 40 ELSE 0 END - CASE WHEN copied THEN 35 ELSE 0 END) AS clean, CASE WHEN n_got = n_want THEN 100 ELSE greatest(0, 100 - abs(n_got - n_want) * 25) END AS cnt FROM s),
f AS (SELECT *, CAST(({MICRO.format('amount')} * 30 + {MICRO.format('type')} * 25 + (clean * 20 + cnt * 10 + 500)::HUGEINT * 1000000 + {MICRO.format('date')} * 5 + {MICRO.format('ambigu')} * 5 + 50000000) // 100000000 AS BIGINT) AS raw FROM c),
r AS (SELECT *, CASE WHEN strict AND extra = 0 AND NOT spurious AND NOT copied AND zero = 0 THEN greatest(raw, 92) ELSE raw END AS composite FROM f)
SELECT o AS l_orderkey, strict, composite, CASE WHEN strict THEN 'excellent' WHEN composite >= 70 THEN 'usable_with_edit' WHEN composite >= 50 THEN 'partially_usable' WHEN n_got > 0 AND (spurious OR copied OR type < 50) THEN 'misleading' ELSE 'broken' END AS tier FROM r"""


@query(LISTS + ", ".join([MATCHED, BEST, COPIED]) + COMPOSITE)
def composite_score(spark, d):
    """Scores, composite and tier of every order."""
    g = graded(spark, d).select("l_orderkey", "flagged", "got", "want", fn.best_credit(F.col("got"), F.col("want")).alias("c"), fn.strict_pass(F.col("flagged"), F.col("got"), F.col("want"), F.lit(False)).alias("strict"))
    zero = F.size(F.filter("got", lambda x: x["jumlah"] == 0))
    g = g.withColumns({"zero": zero, "spurious": fn.spurious_income(F.col("got"), F.col("want"), F.lit(False)), "copied": fn.price_copied(F.col("got"), F.col("want"))})
    clean = fn.no_hallucination(F.col("c.extra"), F.col("zero"), F.col("spurious"), F.col("copied"))
    count = fn.entry_count_score(F.size("got"), F.size("want"), F.lit(False))
    pure = F.col("strict") & (F.col("c.extra") == 0) & ~F.col("spurious") & ~F.col("copied") & (F.col("zero") == 0)
    s = g.withColumn("composite", fn.composite(F.col("c.amount"), F.col("c.type"), clean, count, F.col("c.date"), F.col("c.ambigu"), pure))
    return s.select("l_orderkey", "strict", "composite", fn.tier(F.col("strict"), F.col("composite"), F.size("got"), F.col("spurious"), F.col("copied"), F.col("c.type")).alias("tier"))


@query(LISTS + COPIED + " SELECT o AS l_orderkey, copied FROM copied")
def price_copy(spark, d):
    """Every order, those with repeated line numbers too."""
    return graded(spark, d).select("l_orderkey", fn.price_copied(F.col("got"), F.col("want")).alias("copied"))


@query(G + """SELECT o.l_orderkey, coalesce(n, 0) > (SELECT count(*) FROM li WHERE li.l_orderkey = o.l_orderkey AND type = 'pemasukan') OR coalesce(z, 0) > 0 AS spurious, CAST(coalesce(zero, 0) AS INTEGER) AS zero FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
LEFT JOIN (SELECT l_orderkey, count(*) FILTER (type = 'pemasukan') AS n, count(*) FILTER (type = 'pemasukan' AND jumlah = 0) AS z, count(*) FILTER (jumlah = 0) AS zero FROM got GROUP BY 1) g USING (l_orderkey)""")
def spurious_income(spark, d):
    """Every order, those without any answer too."""
    return graded(spark, d).select("l_orderkey", fn.spurious_income(F.col("got"), F.col("want"), F.lit(False)).alias("spurious"), F.size(F.filter("got", lambda x: x["jumlah"] == 0)).alias("zero"))


@query("""SELECT l_orderkey, CASE WHEN n = 0 THEN CASE WHEN l_orderkey % 13 = 0 THEN 100 ELSE 85 END ELSE CASE WHEN l_orderkey % 13 = 0 THEN 50 ELSE 0 END END AS score FROM (SELECT l_orderkey, count(*) FILTER (l_linenumber <> 5) AS n FROM lineitem GROUP BY 1)""")
def non_transaction_score(spark, d):
    return graded(spark, d).select("l_orderkey", fn.non_transaction(F.col("flagged"), F.size("got")).alias("score"))


@query(LISTS + """a AS (SELECT *, list_max(list_transform(want, lambda w: w.jumlah)) AS top, list_min(list_transform(want, lambda w: w.jumlah)) AS low FROM lists)
SELECT o AS l_orderkey, coalesce(list_sum(list_transform(list_filter(got, lambda g: g.type = 'pengeluaran'), lambda g: g.jumlah)), 0) = coalesce(list_sum(list_transform(list_filter(want, lambda w: w.type = 'pengeluaran'), lambda w: w.jumlah)), 0) AS principal,
len(list_filter(got, lambda g: g.jumlah = top)) = len(want) OR (len(got) > 0 AND list_sum(list_transform(got, lambda g: g.jumlah)) = top * len(want)) AS merged,
len(list_filter(got, lambda g: g.jumlah = low)) > 0 OR coalesce(list_filter(got, lambda g: g.jumlah = top)[1].ambigu, false) AS own_share FROM a""")
def alt_strict(spark, d):
    """Every order, changed and dropped lines too, by each of the layouts that pass: principal and fee, merged quantities, one's own share."""
    amounts_ = F.transform("want", lambda w: w["jumlah"])
    total = F.aggregate(F.filter("want", lambda w: w["type"] == "pengeluaran"), F.lit(0).cast("long"), lambda a, w: a + w["jumlah"])

    def rule(kind, **over):
        kinds = {"keyword": "string", "unit": "long", "count": "int", "principal": "long", "fee": "long", "personal": "long", "total": "long"}
        return F.struct(F.lit(kind).alias("kind"), *(over.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))

    rules = {"principal": rule("principalPlusFee", principal=total - 500, fee=F.lit(500)), "merged": rule("totalOrSplit", keyword=F.lit("PART"), unit=F.array_max(amounts_), count=F.size("want")), "own_share": rule("personalShare", personal=F.array_min(amounts_), total=F.array_max(amounts_))}
    return graded(spark, d).select("l_orderkey", *(fn.alt_strict(F.col("got"), r, F.lit(True)).alias(n) for n, r in rules.items()))


@query("""SELECT source AS style, count(*) FILTER (quality = 1) AS passed, count(*) AS total, floor(count(*) FILTER (quality = 1) * 1000.0 / count(*) + 0.5) / 1000 AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def style_rollup(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    ok = F.count(F.when(F.col("quality") == 1, 1))
    return j.groupBy(F.col("source").alias("style")).agg(ok.alias("passed"), F.count("*").alias("total"), fn.style_share(ok / F.count("*")).alias("share"))


@query(LISTS + ", ".join([MATCHED, BEST, COPIED]) + COMPOSITE.replace("SELECT o AS l_orderkey, strict, composite, CASE", "SELECT tier, count(*) AS n, min(composite) AS low, max(composite) AS high FROM (SELECT composite, CASE") + ") GROUP BY tier")
def tier_histogram(spark, d):
    """How many orders reach each tier, and the scores found there."""
    return composite_score(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.min("composite").alias("low"), F.max("composite").alias("high"))


@query(LISTS + MATCHED.replace("matched AS (SELECT o, want, got AS rest", "matched AS (SELECT o, want, got, got AS rest").replace("SELECT o, want, CASE WHEN place", "SELECT o, want, got, CASE WHEN place") + """, e AS (SELECT *, len(rest) AS left_over, coalesce(list_sum(list_transform(list_filter(got, lambda g: g.type = 'pengeluaran'), lambda g: g.jumlah)), 0) = coalesce(list_sum(list_transform(list_filter(want, lambda w: w.type = 'pengeluaran'), lambda w: w.jumlah)), 0) AS forgiven,
len(list_filter(got, lambda g: g.jumlah = list_max(list_transform(want, lambda w: w.jumlah)))) >= 2 AS cleared, n = len(want) AS whole, o % 13 = 0 AS flagged, o % 29 = 0 AS none FROM matched WHERE i = len(want) + 1)
SELECT o AS l_orderkey, CASE WHEN none THEN flagged AND len(got) = 0 WHEN cleared THEN true ELSE (whole OR forgiven) AND left_over = 0 AND ((forgiven AND NOT whole) OR NOT flagged) END AS passed,
CAST(CASE WHEN none THEN CAST(flagged AND len(got) = 0 AS INT) WHEN cleared OR forgiven THEN len(want) ELSE n END AS INTEGER) AS matched, CAST(CASE WHEN none THEN len(got) WHEN cleared THEN 0 ELSE left_over END AS INTEGER) AS extra FROM e""")
def strict_outcomes(spark, d):
    """Strict grading where a scenario accepts other layouts: sums that agree forgive, a doubled price clears."""
    total = lambda c: F.aggregate(F.filter(c, lambda x: x["type"] == "pengeluaran"), F.lit(0).cast("long"), lambda a, x: a + x["jumlah"])
    top = F.array_max(F.transform("want", lambda w: w["jumlah"]))
    cleared = F.size(F.filter("got", lambda g: g["jumlah"] == top)) >= 2
    out = fn.strict_outcome(F.col("flagged"), F.col("got"), F.col("want"), F.col("l_orderkey") % 29 == 0, total("got") == total("want"), cleared)
    return graded(spark, d).select("l_orderkey", out.alias("s")).select("l_orderkey", "s.*")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s THEN 'excellent' WHEN c >= 85 AND t >= 80 AND NOT sp THEN 'near_correct' WHEN c >= 70 THEN 'usable_with_edit' WHEN c >= 50 THEN 'partially_usable' WHEN e > 0 AND (sp OR t < 50) THEN 'misleading' ELSE 'broken' END AS tier,
CAST(CASE WHEN e = w THEN 100 WHEN a AND e = w + 1 THEN 90 ELSE greatest(0, 100 - abs(e - w) * 25) END AS INTEGER) AS counted
FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 10 = 0 AS s, l_partkey % 101 AS c, l_suppkey % 101 AS t, l_linestatus = 'O' AS sp, CAST(l_quantity AS INTEGER) % 4 AS e, l_linenumber % 4 AS w, l_returnflag = 'A' AS a FROM lineitem)""")
def suite_of_twelve(spark, d):
    """Tiers and count scores of the suite of twelve."""
    li = table(spark, d, "lineitem")
    entries, want = F.col("l_quantity").cast("int") % 4, F.col("l_linenumber") % 4
    tier_ = fn.tier_of_twelve(F.col("l_orderkey") % 10 == 0, F.col("l_partkey") % 101, entries, F.col("l_linestatus") == "O", F.lit(False), F.col("l_suppkey") % 101)
    return li.select("l_orderkey", "l_linenumber", tier_.alias("tier"), fn.count_score_of_twelve(entries, want, F.col("l_returnflag") == "A").cast("int").alias("counted"))
