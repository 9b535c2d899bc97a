"""Amount queries; chat texts are rendered from numeric columns, so the gold amounts are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import amounts as fn
from millrace.plans.registry import query
from millrace.sources.tables import table


def chats(spark, d):
    """One message per order: an amount in one of six notations, a quantity and a slang word."""
    v = (F.floor(F.col("o_totalprice") / 500) * 500).cast("long")
    o = table(spark, d, "orders").select("o_orderkey", v.alias("v"), (F.col("o_orderkey") % 6).alias("k"))
    said = F.coalesce(*(F.when(F.col("k") == i, fn.render(F.col("v"), n)) for i, n in enumerate(fn.NOTATIONS)), fn.render(F.col("v"), "rp_prefix"))
    t = F.concat(F.lit("beli beras 5 kg "), said, F.when(F.col("o_orderkey") % 3 == 0, F.lit(" eh bukan, ceban")).otherwise(F.lit(" sama seket ewu buat teh")))
    return o.select("o_orderkey", "v", "k", t.alias("text"))


DOTS = "replace(format('{:,}', v), ',', '.')"
K = "CASE WHEN v % 1000 = 0 THEN CAST(v // 1000 AS VARCHAR) ELSE (v // 1000) || ',5' END || 'k'"
CHATS = f"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 500) * 500 AS BIGINT) AS v, o_orderkey % 6 AS k FROM orders),
s AS (SELECT *, CASE WHEN k = 0 THEN v::VARCHAR WHEN k = 1 AND v >= 1000 THEN {DOTS} WHEN k = 3 AND v % 1000 = 0 AND v < 1000000 THEN (v // 1000) || 'rb' WHEN k = 4 AND v < 1000000 THEN {K} ELSE 'Rp ' || {DOTS} END AS said,
CASE WHEN k = 0 THEN 'bare' WHEN k = 1 AND v >= 1000 THEN 'dot' WHEN k = 3 AND v % 1000 = 0 AND v < 1000000 THEN 'suffix' WHEN k = 4 AND v < 1000000 THEN 'suffix' ELSE 'rp' END AS kind FROM o)
"""


@query(CHATS + """SELECT o_orderkey, concat_ws(',', CASE WHEN v >= 100 OR kind IN ('rp', 'suffix') THEN kind || '=' || v || '@16' END, CASE WHEN o_orderkey % 3 = 0 THEN 'slang=10000@' || (16 + length(said) + 11) ELSE 'spelled=50000@' || (16 + length(said) + 6) END) AS atoms FROM s""")
def tokenize_amounts(spark, d):
    t = chats(spark, d).select("o_orderkey", fn.amount_atoms(F.col("text")).alias("a"))
    return t.select("o_orderkey", F.array_join(F.transform("a", lambda x: F.concat(x["kind"], F.lit("="), x["value"].cast("string"), F.lit("@"), x["start"].cast("string"))), ",").alias("atoms"))


@query(CHATS + """, a AS (SELECT o_orderkey, v, v >= 100 OR kind IN ('rp', 'suffix') AS named, CASE WHEN o_orderkey % 3 = 0 THEN 10000 ELSE 50000 END AS w, CASE WHEN o_orderkey % 4 = 0 THEN v WHEN o_orderkey % 4 = 1 THEN v * 3 WHEN o_orderkey % 4 = 2 THEN v + CASE WHEN o_orderkey % 3 = 0 THEN 10000 ELSE 50000 END ELSE 7 END AS wanted FROM s),
t AS (SELECT *, wanted = w OR (named AND wanted = v) AS direct, coalesce(named AND v > 0 AND wanted % nullif(v, 0) = 0 AND wanted // nullif(v, 0) BETWEEN 2 AND 12, false) AS times_v, wanted % w = 0 AND wanted // w BETWEEN 2 AND 12 AS times_w, named AND (wanted = v + w OR (wanted = abs(v - w) AND wanted > 0)) AS pair FROM a)
SELECT o_orderkey, wanted, CASE WHEN direct THEN 'direct' WHEN times_v OR times_w OR pair THEN 'derived' ELSE 'none' END AS tier,
CASE WHEN direct THEN NULL WHEN times_v THEN v || '×' || (wanted // v) WHEN named AND wanted = v + w THEN v || '+' || w WHEN named AND wanted = abs(v - w) AND wanted > 0 THEN '|' || v || '-' || w || '|' WHEN times_w THEN w || '×' || (wanted // w) END AS via FROM t""")
def trace_amount(spark, d):
    k = F.col("o_orderkey") % 4
    other = F.when(F.col("o_orderkey") % 3 == 0, 10_000).otherwise(50_000)
    wanted = F.when(k == 0, F.col("v")).when(k == 1, F.col("v") * 3).when(k == 2, F.col("v") + other).otherwise(7).cast("long")
    t = chats(spark, d).select("o_orderkey", wanted.alias("wanted"), fn.amount_atoms(F.col("text")).alias("a"))
    t = t.select("o_orderkey", "wanted", fn.trace(F.col("wanted"), F.col("a")).alias("t"))
    return t.select("o_orderkey", "wanted", "t.tier", F.when(F.col("t.tier") == "derived", F.col("t.via")).alias("via"))


@query(CHATS + """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR v = 50000 THEN '' ELSE '50000' END AS unexcused FROM s""")
def excuse_window(spark, d):
    t = chats(spark, d).select("o_orderkey", "v", "text", fn.amount_atoms(F.col("text")).alias("a"))
    left = fn.unexcused(F.col("text"), F.col("a"), F.array("v"))
    return t.select("o_orderkey", F.array_join(F.transform(left, lambda x: x["value"].cast("string")), ",").alias("unexcused"))


@query("""WITH a AS (SELECT o_custkey AS item, CAST(floor(o_totalprice / 250) * 250 AS BIGINT) AS value FROM orders GROUP BY 1, 2), f AS (SELECT value, count(*) AS df FROM a GROUP BY 1)
SELECT value, df, value >= 10000 AND value % 1000 <> 0 AND df <= 2 AS distinctive FROM f""")
def distinctive_amounts(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), (F.floor(F.col("o_totalprice") / 250) * 250).cast("long").alias("value")).distinct()
    return a.groupBy("value").agg(F.count("*").alias("df")).withColumn("distinctive", fn.distinctive(F.col("value"), F.col("df")))


@query(CHATS + "SELECT o_orderkey, v AS parsed FROM s")
def lenient_amount(spark, d):
    """The amount of every message, suffixes too, against the amounts they were rendered from."""
    said = F.regexp_extract("text", "^beli beras 5 kg (.*?)(?: eh bukan, ceban| sama seket ewu buat teh)$", 1)
    return chats(spark, d).select("o_orderkey", fn.lenient_amount(said).alias("parsed"))


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 500) * 500 * (1 + 99 * CAST(l_linenumber = 1 AS INT)) AS BIGINT) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, v, v::VARCHAR AS polos, CASE WHEN v >= 1000 THEN {DOTS} END AS dot_sep, 'Rp ' || {DOTS} AS rp_prefix, CASE WHEN v % 1000 = 0 AND v < 1000000 THEN (v // 1000) || 'rb' END AS rb_suffix,
CASE WHEN v < 1000000 THEN {K} END AS k_suffix, CASE WHEN v >= 1000000 AND v % 50000 = 0 THEN (v // 1000000) || CASE WHEN v % 1000000 = 0 THEN '' ELSE ',' || rtrim(lpad(CAST(v % 1000000 // 10000 AS VARCHAR), 2, '0'), '0') END || 'jt' END AS jt_suffix FROM o""")
def render_surface(spark, d):
    v = (F.floor(F.col("l_extendedprice") / 500) * 500 * (1 + 99 * (F.col("l_linenumber") == 1).cast("int"))).cast("long")
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return o.select("*", *(fn.render(F.col("v"), n).alias(n) for n in fn.NOTATIONS))


BANDS_SQL = "(VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in fn.BANDS.items()) + ") b(band, lo, hi)"


@query(f"SELECT o_orderkey, b.band FROM orders LEFT JOIN {BANDS_SQL} ON floor(o_totalprice) >= lo AND floor(o_totalprice) < hi")
def magnitude_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.band(F.floor("o_totalprice")).alias("band"))


@query(f"SELECT p_partkey, b.band FROM (SELECT p_partkey, p_retailprice * 4 AS a, p_retailprice * 60 + 1 AS z FROM part) p JOIN {BANDS_SQL} ON a < hi AND lo < z")
def band_overlap(spark, d):
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for k, (a, b) in fn.BANDS.items()))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 4).alias("a"), (F.col("p_retailprice") * 60 + 1).alias("z"), F.inline(bands))
    return p.where(fn.bands_overlap(F.col("a"), F.col("z"), F.col("lo"), F.col("hi"))).select("p_partkey", "band")


@query("""WITH l AS (SELECT unnest([500, 1000, 7500, 12000, 62500, 100000, 550000, 1000000, 1250000, 5500000, 60000000]) AS v)
SELECT v, notation FROM l, (SELECT unnest(['polos', 'dot_sep', 'rp_prefix', 'rb_suffix', 'k_suffix', 'jt_suffix']) AS notation)
WHERE CASE notation WHEN 'dot_sep' THEN v >= 1000 WHEN 'rb_suffix' THEN v % 1000 = 0 AND v < 1000000 WHEN 'k_suffix' THEN v % 500 = 0 AND v < 1000000 WHEN 'jt_suffix' THEN v >= 1000000 AND v % 50000 = 0 ELSE true END""")
def renderable_ladder(spark, d):
    """Which notations can write which amounts of a ladder."""
    ladder = spark.createDataFrame([(v,) for v in (500, 1000, 7500, 12000, 62500, 100000, 550000, 1000000, 1250000, 5500000, 60000000)], "v int")
    each = F.array(*(F.struct(F.lit(n).alias("notation"), fn.render(F.col("v"), n).alias("surface")) for n in fn.NOTATIONS))
    return ladder.select("v", F.inline(each)).where(F.col("surface").isNotNull()).select("v", "notation")


@query(CHATS + """SELECT o_orderkey, v, CAST(v AS DOUBLE) AS direct, CASE WHEN v < 1000000 THEN v / 1000 END AS decimal_comma FROM s""")
def numeric_parse(spark, d):
    c = chats(spark, d)
    as_k = F.regexp_replace(fn.render(F.col("v"), "k_suffix"), "k$", "")
    return c.select("o_orderkey", "v", fn.number(fn.dotted(F.col("v")))[0].alias("direct"), fn.number(as_k)[0].alias("decimal_comma"))


@query(CHATS + """, a AS (SELECT v AS value FROM s WHERE v >= 100 OR kind IN ('rp', 'suffix') UNION SELECT 10000 FROM s WHERE o_orderkey % 3 = 0 UNION SELECT 50000 FROM s WHERE o_orderkey % 3 <> 0) SELECT value FROM a""")
def corpus_amounts(spark, d):
    """Distinct amounts named anywhere in a corpus."""
    return chats(spark, d).select(F.explode(F.transform(fn.amount_atoms(F.col("text")), lambda a: a["value"])).alias("value")).distinct()
