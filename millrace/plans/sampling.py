"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import amounts, rng
from millrace.operators import sampling as op
from millrace.operators import taxonomy
from millrace.plans.registry import query
from millrace.sources.tables import table

M = 4294967296


def draw_sql(seed: str, k: str) -> str:
    """The generator's k-th draw in SQL, as nested expressions over HUGEINT."""
    t = f"((({seed}) % {M} + ({k})::HUGEINT * {rng.STEP}) % {M})::BIGINT"
    return f"(SELECT xor(z, z >> 14) / {M}.0 FROM (SELECT xor(x, ((x + ((xor(x, x >> 7))::HUGEINT * (x | 61)) % {M}) % {M})::BIGINT) AS z FROM (SELECT (((xor(t, t >> 15))::HUGEINT * (t | 1)) % {M})::BIGINT AS x FROM (SELECT {t} AS t))))"


@query(f"SELECT event_id, {draw_sql('42', 'event_id + 1')} AS draw FROM events")
def mulberry32(spark, d):
    return table(spark, d, "events").select("event_id", rng.draw(F.lit(42), F.col("event_id") + 1).alias("draw"))


@query(f"SELECT doc_id, CASE WHEN r < 0.8 THEN 'full' WHEN r < 0.95 THEN 'short' ELSE 'none' END AS mode FROM (SELECT doc_id, {draw_sql('xor(doc_id, 42)', '1')} AS r FROM documents)")
def weighted_mode(spark, d):
    return table(spark, d, "documents").select("doc_id", rng.prompt_mode(F.lit(42), F.col("doc_id")).alias("mode"))


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, n * 1000 / sum(n) OVER () AS x FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, c_mktsegment) AS rn, 1000 - sum(floor(x)) OVER () AS rest FROM e)
SELECT c_mktsegment, n, CAST(floor(x) + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def apportion(spark, d):
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return op.apportion(s, "n", "c_mktsegment", 1000)


@query(f"""WITH r AS (SELECT doc_id, lang, {draw_sql('xor(doc_id, 7)', '1')} AS r FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM r)
SELECT doc_id, lang, CASE WHEN rn <= greatest(0, least(greatest(1, floor(n * 0.08 + 0.5)), n - 1)) THEN 'eval_iid' ELSE 'train' END AS split FROM k""")
def stratified_holdout(spark, d):
    return op.stratified_holdout(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.08, 7)


def cells(spark, d):
    """Parts as taxonomy cells with three axes."""
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 10).cast("string").alias("size"))


AXES = ["p_brand", "p_type", "size"]
#: Each axis in turn keeps the last row of a value of which all rows could be chosen.
_STEPS = ", ".join(f"""s{i + 1} AS (SELECT * EXCLUDE (ok), ok AND NOT (sum(ok::INT) OVER (PARTITION BY {a}) = count(*) OVER (PARTITION BY {a}) AND row_number() OVER (PARTITION BY {a}, ok ORDER BY r DESC, p_partkey DESC) = 1) AS ok FROM s{i})""" for i, a in enumerate(AXES))


@query(f"""WITH c AS (SELECT p_partkey, p_brand, p_type, CAST(p_size % 10 AS VARCHAR) AS size FROM part),
s0 AS (SELECT *, {draw_sql('xor(p_partkey, 42)', '1')} AS r, count(*) OVER (PARTITION BY p_brand, p_type, size) = 1 AND count(*) OVER (PARTITION BY p_brand) > 1 AND count(*) OVER (PARTITION BY p_type) > 1 AND count(*) OVER (PARTITION BY size) > 1 AS ok FROM c), {_STEPS},
k AS (SELECT p_partkey FROM s{len(AXES)} WHERE ok QUALIFY row_number() OVER (ORDER BY r, p_partkey) <= (SELECT floor(count(*) * 0.05 + 0.5) FROM c))
SELECT p_partkey, p_brand, p_type, size, CASE WHEN p_partkey IN (SELECT p_partkey FROM k) THEN 'eval_compositional' ELSE 'train' END AS split FROM c""")
def compositional_holdout(spark, d):
    return op.compositional_holdout(cells(spark, d), AXES, "p_partkey", 0.05, 42)


@query("""SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('cold', 'red') OR split_part(p_name, ' ', 2) IN ('cold', 'red') THEN 'eval_compositional' ELSE 'train' END AS split FROM part""")
def token_holdout(spark, d):
    return op.token_holdout(table(spark, d, "part").select("p_partkey", "p_name"), F.split("p_name", " "), ["cold", "red"]).select("p_partkey", "split")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, p_size % 5 = 0 AS held, p_size % 2 = 1 OR p_size % 5 = 0 AS eval FROM part), b AS (SELECT *, count(*) FILTER (NOT eval) OVER (PARTITION BY p_brand) AS train, row_number() OVER (PARTITION BY p_brand, eval AND NOT held ORDER BY p_partkey) AS k FROM p WHERE p_size >= 35 OR p_size % 2 = 1)
SELECT p_partkey, CASE WHEN eval AND NOT (NOT held AND train < 2 AND k <= 2 - train) THEN 'eval' ELSE 'train' END AS split FROM b""")
def holdout_backstop(spark, d):
    """Every brand keeps two rows to train on; rows with a held-out token never go back."""
    p = table(spark, d, "part").where("p_size >= 35 or p_size % 2 = 1")
    held = F.col("p_size") % 5 == 0
    p = p.select("p_partkey", "p_brand", held.alias("held"), F.when(held | (F.col("p_size") % 2 == 1), "eval").otherwise("train").alias("split"))
    return op.backstop(p, "p_brand", "p_partkey", "held", 2).select("p_partkey", "split")


@query("""WITH t(o_orderpriority, target) AS (VALUES ('1-URGENT', 0.3), ('2-HIGH', 0.2), ('3-MEDIUM', 0.2), ('5-LOW', 0.2), ('9-NEVER', 0.1)), n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT sum(n) FROM n)::DOUBLE AS share, target::DOUBLE AS target, (coalesce(n, 0) / (SELECT sum(n) FROM n)::DOUBLE - target::DOUBLE) * 100 AS delta_pp FROM t LEFT JOIN n USING (o_orderpriority)""")
def marginal_report(spark, d):
    return op.marginals(table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": 0.3, "2-HIGH": 0.2, "3-MEDIUM": 0.2, "5-LOW": 0.2, "9-NEVER": 0.1})


@query("""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es, concat_ws(',', CASE WHEN count(*) FILTER (lang = 'en') = 0 THEN 'en' END, CASE WHEN count(*) FILTER (lang = 'de') = 0 THEN 'de' END, CASE WHEN count(*) FILTER (lang = 'fr') = 0 THEN 'fr' END, CASE WHEN count(*) FILTER (lang = 'es') = 0 THEN 'es' END, CASE WHEN count(*) FILTER (lang = 'id') = 0 THEN 'id' END) AS gaps,
CAST(coalesce(sum(n_chars) FILTER (lang = 'en'), 0) AS DOUBLE) / sum(n_chars) AS weighted_en FROM documents GROUP BY source""")
def split_pivot(spark, d):
    """Rows of each source by language, the languages it lacks, and a language's share weighted by length."""
    langs = ["en", "de", "fr", "es", "id"]
    docs = table(spark, d, "documents")
    p = docs.groupBy("source").pivot("lang", langs).count()
    share = docs.groupBy("source").agg((F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0)).cast("double") / F.sum("n_chars")).alias("weighted_en"))
    gaps = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in langs))), ",")
    return p.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in langs[:4]), gaps.alias("gaps")).join(share, "source")


@query(f"""WITH e AS (SELECT p_partkey, unnest(range(1, p_size % 4 + 1)) AS copy FROM part WHERE p_size % 4 >= 1), r AS (SELECT p_partkey, CAST(copy AS INTEGER) AS copy, {draw_sql('xor(p_partkey, 11)', 'copy')} AS r FROM e)
SELECT p_partkey, copy, row_number() OVER (ORDER BY r, p_partkey, copy) - 1 AS plan_index FROM r""")
def plan_expand(spark, d):
    return op.expand_plan(table(spark, d, "part").withColumn("rows", F.col("p_size") % 4), "p_partkey", "rows", 11)


def part_cells(spark, d):
    """Parts as cells with amounts, dates and vendors; some can't stand."""
    k = F.col("p_partkey")
    pick = lambda m, *v: F.get(F.array(*map(F.lit, v)), (F.floor(k / m) % len(v)).cast("int"))
    price = F.floor("p_retailprice").cast("long") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 10).otherwise(700)
    values = F.slice(F.array(price, F.col("p_size").cast("long") * 90, price + 5), 1, (k % 4).cast("int"))
    surface = pick(2, "kemarin", "hari ini", "lusa", None, "tadi pagi", "kemarin malam, hari ini")
    c = table(spark, d, "part").select(k.alias("p_partkey"), pick(1, "in", "out", "mixed", "non_tx", "out").alias("direction"), pick(3, "zero", "single", "dua", "tiga").alias("cardinality"), pick(5, *amounts.BANDS).alias("magnitude"), pick(7, "kemarin", "hari_ini", "tidak_jelas", "lusa").alias("date_hint"), surface.alias("date_surface"), pick(11, "none", "amount", "magnitude", "cancel", "item").alias("correction"), values.alias("values"), F.col("p_brand").alias("aspect"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    vendor = F.struct(F.col("aspect").alias("id"), (k % 17 != 0).alias("known"), F.floor(F.col("price")).cast("long").alias("lo"), (F.floor(F.col("price")) * 3).cast("long").alias("hi"), pick(13, "any", "in", "out").alias("polarity"))
    return c.withColumn("surfaces", F.transform("values", lambda v: F.when(v % 13 == 0, " ").otherwise(v.cast("string")))).withColumn("vendors", F.when(k % 2 == 0, F.array(vendor)).otherwise(F.array().cast("array<struct<id:string,known:boolean,lo:bigint,hi:bigint,polarity:string>>")))


def cell_invariants(c):
    qty = F.when(F.col("size") % 9 == 0, 2 + F.col("size") % 4)
    extra = {"price_copy": F.col("size") % 5 == 0, "share": F.col("size") % 7 == 0, "discount": F.col("size") % 8 == 0, "fuzzy": F.col("size") % 6 == 0, "future": F.col("size") % 10 == 0, "phantom": F.col("size") % 11 == 0, "contested": F.exists("values", lambda v: v == 50_000)}
    keyword = F.when(F.col("size") % 2 == 0, "lusin").otherwise("botol")
    return c.withColumn("invariants", taxonomy.invariants((F.col("size") * 1000).cast("long"), qty, keyword, extra))


#: The same cells in SQL, with the facts that invariants and coherence are made of.
CELLS = """WITH p AS (SELECT p_partkey AS k, p_size AS size, p_retailprice AS price, p_brand AS aspect, CAST(floor(p_retailprice) AS BIGINT) * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 700 END AS a FROM part),
c AS (SELECT k, size, aspect, (['in', 'out', 'mixed', 'non_tx', 'out'])[k % 5 + 1] AS direction, (['zero', 'single', 'dua', 'tiga'])[k // 3 % 4 + 1] AS cardinality, (['receh', 'kecil', 'sedang', 'besar', 'jumbo'])[k // 5 % 5 + 1] AS magnitude,
(['kemarin', 'hari_ini', 'tidak_jelas', 'lusa'])[k // 7 % 4 + 1] AS date_hint, (['kemarin', 'hari ini', 'lusa', NULL, 'tadi pagi', 'kemarin malam, hari ini'])[k // 2 % 6 + 1] AS date_surface, (['none', 'amount', 'magnitude', 'cancel', 'item'])[k // 11 % 5 + 1] AS correction,
([a, size * 90, a + 5])[1 : k % 4] AS v, size * 1000 AS shadow, CASE WHEN size % 9 = 0 THEN 2 + size % 4 END AS qty, k % 2 = 0 AS sold, k % 17 <> 0 AS known, CAST(floor(price) AS BIGINT) AS lo, CAST(floor(price) AS BIGINT) * 3 AS hi, (['any', 'in', 'out'])[k // 13 % 3 + 1] AS polarity FROM p),
i AS (SELECT *, coalesce(v[1], 10000) AS unit, len(v) AS n, CASE direction WHEN 'in' THEN len(v) WHEN 'mixed' THEN 1 ELSE 0 END AS masuk,
list_filter([CASE WHEN correction IN ('amount', 'cancel') THEN shadow END, CASE WHEN correction = 'magnitude' THEN coalesce(v[1], 75000) * 100 END, CASE WHEN size % 7 = 0 THEN coalesce(v[1], 30000) * 3 END, CASE WHEN size % 8 = 0 THEN CAST(floor(coalesce(v[1], 50000) * 1.2::DOUBLE / 500 + 0.5) * 500 AS BIGINT) END, CASE WHEN size % 10 = 0 THEN shadow END, CASE WHEN size % 11 = 0 THEN shadow * 10 END], lambda x: x IS NOT NULL) AS absent FROM c)
"""


@query(CELLS + """SELECT k AS p_partkey, CASE WHEN direction = 'non_tx' THEN 'non_transaction' ELSE concat_ws(',', CASE WHEN qty IS NOT NULL THEN 'qty_merge_ok:' || unit || 'x' || qty || ',sum_out:' || unit * qty ELSE 'entry_count:' || n || ',direction_count:' || masuk || '/' || (n - masuk) || CASE WHEN n > 0 THEN ',' || array_to_string(list_transform(v, lambda x: 'amount_present:' || x), ',') ELSE '' END END,
'date_hint:' || date_hint, CASE WHEN correction IN ('amount', 'cancel') THEN 'amount_absent:' || shadow END, CASE WHEN correction = 'magnitude' THEN 'amount_absent:' || coalesce(v[1], 75000) * 100 END, CASE WHEN size % 5 = 0 AND n >= 2 THEN 'no_price_copy:' || len(list_distinct(v)) END, CASE WHEN size % 7 = 0 THEN 'amount_absent:' || coalesce(v[1], 30000) * 3 END,
CASE WHEN size % 8 = 0 THEN 'amount_absent:' || CAST(floor(coalesce(v[1], 50000) * 1.2::DOUBLE / 500 + 0.5) * 500 AS BIGINT) END, CASE WHEN size % 6 = 0 THEN 'ambigu_flagged:1' END, CASE WHEN size % 10 = 0 THEN 'amount_absent:' || shadow END, CASE WHEN size % 11 = 0 THEN 'amount_absent:' || shadow * 10 END, CASE WHEN list_contains(v, 50000) THEN 'ambigu_flagged:1' END) END AS invariants FROM i""")
def cell_invariants_of_parts(spark, d):
    """Every cell's invariants, one text each."""
    said = lambda i: F.concat_ws(":", i["kind"], F.coalesce(F.when(i["kind"] == "qty_merge_ok", F.concat_ws("x", i["unit"], i["n"])).when(i["kind"] == "direction_count", F.concat_ws("/", i["masuk"], i["keluar"])), i["rupiah"].cast("string"), i["total"].cast("string"), i["n"].cast("string"), i["hint"]))
    return cell_invariants(part_cells(spark, d)).select("p_partkey", F.array_join(F.transform("invariants", said), ",").alias("invariants"))


_BAND = lambda i: "CASE magnitude " + " ".join(f"WHEN '{k}' THEN {b[i]}" for k, b in amounts.BANDS.items()) + " END"
#: Rule and condition in SQL, over the cells' facts.
BROKEN = {
    "future_hint": "date_hint = 'lusa'", "future_surface": "tx AND date_surface = 'lusa'",
    "foreign_trigger": "(date_hint <> 'kemarin' AND contains(date_surface, 'kemarin')) OR (date_hint <> 'hari_ini' AND (contains(date_surface, 'hari ini') OR contains(date_surface, 'tadi'))) OR (date_hint <> 'lusa' AND date_surface = 'lusa')",
    "non_tx_entries": "NOT tx AND cardinality <> 'zero'", "no_entries": "tx AND cardinality = 'zero'", "no_values": "tx AND n = 0", "pack": "tx AND qty IS NOT NULL AND size % 2 = 0",
    "date_mismatch": "tx AND (date_hint <> 'tidak_jelas') <> (date_surface IS NOT NULL)", "below_floor": "len(list_filter(v, lambda x: x < 100)) > 0", "empty_surface": "len(list_filter(v, lambda x: x % 13 = 0)) > 0",
    "outside_band": "n > 0 AND (list_max(v) < lo_band OR list_max(v) >= hi_band)", "count_of_cardinality": "counted AND n <> CASE cardinality WHEN 'zero' THEN 0 WHEN 'single' THEN 1 WHEN 'dua' THEN 2 ELSE 3 END",
    "mixed_one_way": "counted AND direction = 'mixed' AND n < 2", "present_and_absent": "counted AND len(list_intersect(v, absent)) > 0", "unknown_vendor": "sold AND NOT known",
    "vendor_band": "sold AND known AND NOT (lo < hi_band AND lo_band < hi + 1)", "vendor_polarity": "sold AND known AND direction IN ('in', 'out') AND polarity <> 'any' AND polarity <> direction",
}


@query(CELLS + f", f AS (SELECT *, direction <> 'non_tx' AS tx, direction <> 'non_tx' AND qty IS NULL AS counted, {_BAND(0)} AS lo_band, {_BAND(1)} AS hi_band FROM i)\n" + " UNION ALL ".join(f"SELECT k AS p_partkey, '{n}' AS rule FROM f WHERE {c}" for n, c in BROKEN.items()))
def coherence_violations(spark, d):
    """Every rule that a drafted cell breaks; rules on counts can't be broken by invariants derived here."""
    rules = taxonomy.coherence({"kemarin": ["kemarin"], "hari_ini": ["hari ini", "tadi"], "lusa": ["lusa"]}, ["lusin", "rim"])
    return op.violations(cell_invariants(part_cells(spark, d)), "p_partkey", rules)


@query("""WITH c AS (SELECT c_custkey AS cell_id, c_nationkey AS region, CASE WHEN c_acctbal < 3000 THEN 0 ELSE 3000 END AS band_lo, CASE WHEN c_acctbal < 3000 THEN 3000 ELSE 10000 END AS band_hi, CASE WHEN c_custkey % 2 = 0 THEN 'in' ELSE 'out' END AS direction, c_custkey % 3 AS rail FROM customer),
v AS (SELECT s_suppkey, s_nationkey AS v_region, s_acctbal AS lo, s_acctbal + 500 AS hi, CASE s_suppkey % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'in' ELSE 'out' END AS polarity, s_suppkey % 3 AS v_rail FROM supplier),
j AS (SELECT cell_id, s_suppkey, rail = v_rail AS on_rail FROM c JOIN v ON region = v_region AND lo < band_hi AND band_lo < hi + 1 AND (polarity = 'any' OR polarity = direction))
SELECT cell_id, s_suppkey FROM j QUALIFY on_rail OR NOT bool_or(on_rail) OVER (PARTITION BY cell_id)""")
def vendor_selection(spark, d):
    c = table(spark, d, "customer")
    low = F.col("c_acctbal") < 3000
    cells_ = c.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("region"), F.when(low, 0).otherwise(3000).alias("band_lo"), F.when(low, 3000).otherwise(10_000).alias("band_hi"), F.when(F.col("c_custkey") % 2 == 0, "in").otherwise("out").alias("direction"), (F.col("c_custkey") % 3).alias("rail"))
    k = F.col("s_suppkey") % 3
    vendors = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("v_region"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 500).alias("hi"), F.when(k == 0, "any").when(k == 1, "in").otherwise("out").alias("polarity"), k.alias("v_rail"))
    return op.vendors_for(cells_, vendors).select("cell_id", "s_suppkey")


@query()
def draft_cells(spark, d):
    """Cells drafted from brands as aspects and types as tiers, then relinked; draws are hashed, so there is no SQL."""
    some = lambda *v: F.array(*map(F.lit, v))
    axes = {"direction": some("in", "out", "mixed", "non_tx"), "cardinality": some("zero", "single", "dua", "tiga"), "date_hint": some("kemarin", "hari_ini"), "register": some("baku", "jawa"), "register_intensity": some("campur", "penuh"), "magnitude": some("receh", "kecil", "jumbo"), "notation": some("rb_suffix", "jt_suffix", "slang")}
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("aspect"), F.col("p_type").alias("tier")).agg(F.count("*").cast("double").alias("weight"))
    specs = p.withColumn("aspect", F.concat_ws("-", "tier", "aspect")).withColumns(axes)
    # a table has few types; each gets an equal share
    found = sorted(r["tier"] for r in specs.select("tier").where("tier is not null").distinct().collect())
    tiers = {t: 1 / len(found) for t in found}
    cells_ = taxonomy.draft(specs, [*axes], tiers, 400, 42).withColumn("has_nominal", F.col("id").endswith("0"))
    return taxonomy.relink(cells_).drop(*(f"allowed_{a}" for a in axes))
