"""Label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import labels as fn
from millrace.functions import amounts, spec, text
from millrace.operators import batches as op
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("""SELECT event_id, '{"k": ' || regexp_extract(props, '(\\d+)', 1) || '}' AS block, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events""")
def json_block(spark, d):
    """Blocks found inside fences or prose, then read."""
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n{}"))).otherwise(F.concat(F.lit("The answer is "), "props", F.lit(" as asked.")))
    e = table(spark, d, "events").select("event_id", text.first_json_block(fence).alias("block"))
    return e.select("event_id", "block", F.try_variant_get(F.try_parse_json("block"), "$.k", "bigint").alias("k"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'hari_ini' WHEN event_type = 'click' THEN 'kemarin' WHEN event_type = 'signup' THEN NULL ELSE 'tidak_jelas' END AS hint,
CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN event_type IN ('purchase', 'view') THEN 'pemasukan' ELSE 'pengeluaran' END AS direction FROM events""")
def enum_coerce(spark, d):
    k = F.col("event_type")
    hint = F.when(k == "view", " TADI ").when(k == "click", "kmrn").when(k == "signup", None).otherwise("suatu hari")
    kind = F.when(k == "purchase", "Income").when(k == "view", " masuk").otherwise(k)
    return table(spark, d, "events").select("event_id", fn.date_hint(hint).alias("hint"), fn.confidence((F.col("value") / 100).cast("string")).alias("confidence"), fn.direction(kind).alias("direction"))


def answers(spark, d):
    """One label per order from its lines, some of them broken."""
    jumlah = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.floor("l_extendedprice")).cast("long")
    ambigu = F.col("l_returnflag") == "A"
    entry = F.struct(
        F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "pemasukan").otherwise("pengeluaran").alias("type"), F.when(F.col("l_linenumber") == 6, "lusa").otherwise("kemarin").alias("tanggal_hint"),
        F.concat(F.lit("barang "), F.col("l_partkey").cast("string")).alias("deskripsi"), jumlah.alias("jumlah"), F.lit(None).cast("string").alias("kategori"), F.col("l_suppkey").cast("string").alias("vendor"),
        F.when(F.col("l_linestatus") == "O", "high").otherwise("low").alias("confidence"), ambigu.alias("ambigu"), F.when(ambigu & (F.col("l_linenumber") != 5), "kira-kira").alias("catatan_ambigu"))
    # an order has few lines by nature
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    entries = F.transform("e", lambda x: F.struct(*(x[k].alias(k) for k in fn.ENTRY_KEYS)))
    return g.select("l_orderkey", F.struct(entries.alias("entries"), (F.col("l_orderkey") % 11 == 0).alias("bukan_transaksi"), F.lit(None).cast("string").alias("ringkasan")).alias("label"))


@query("""WITH i AS (SELECT l_orderkey, l_orderkey % 11 = 0 AS flag, bool_or(l_linenumber = 7 OR floor(l_extendedprice) <= 0) AS amount, bool_or(l_returnflag = 'A' AND l_linenumber = 5) AS note, bool_or(l_returnflag = 'A' AND l_linestatus = 'O') AS sure, bool_or(l_linenumber = 6) AS future,
count(*) <> count(DISTINCT (l_returnflag, l_linenumber = 6, l_partkey, CASE WHEN l_linenumber = 7 THEN 0 ELSE floor(l_extendedprice) END, l_suppkey, l_linestatus, l_returnflag = 'A' AND l_linenumber <> 5)) AS dup FROM lineitem GROUP BY 1)
SELECT l_orderkey, concat_ws(',', CASE WHEN flag THEN 'flag' END, CASE WHEN amount THEN 'amount' END, CASE WHEN note THEN 'note_missing' END, CASE WHEN sure THEN 'sure_but_ambiguous' END, CASE WHEN future THEN 'future' END, CASE WHEN dup THEN 'duplicate' END) AS issues, l_orderkey % 5 = 0 OR l_orderkey % 7 = 0 OR l_orderkey % 9 = 0 AS odd_keys FROM i""")
def strict_rules(spark, d):
    k, said = F.col("l_orderkey"), F.to_json("label", {"ignoreNullFields": "false"})
    # a key too many in the answer or in its entries, or one too few
    raw = F.when(k % 5 == 0, F.concat(F.lit('{"extra": 1, '), F.substring(said, 2, 100_000))).when(k % 7 == 0, F.replace(said, F.lit('"vendor":'), F.lit('"penjual":'))).when(k % 9 == 0, F.to_json("label")).otherwise(said)
    return answers(spark, d).select("l_orderkey", F.array_join(fn.strict_issues(F.col("label")), ",").alias("issues"), fn.unknown_keys(raw).alias("odd_keys"))


@query("""SELECT l_orderkey, count(*) AS entries, CAST(sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE floor(l_extendedprice) END) AS BIGINT) AS total, count(*) FILTER (l_returnflag = 'R') AS income, count(*) FILTER (l_returnflag = 'A') AS ambigu FROM lineitem GROUP BY 1""")
def lenient_labels(spark, d):
    """Labels written as JSON under other key names inside a fence, read back leniently."""
    said = F.concat(F.lit("```json\n"), F.replace(F.replace(F.to_json("label"), F.lit('"entries"'), F.lit('"transaksi"')), F.lit('"jumlah"'), F.lit('"amount"')), F.lit("\n```"))
    e = answers(spark, d).select("l_orderkey", fn.lenient_label(said).alias("label"))
    n = lambda f: F.size(F.filter("label.entries", f)).cast("long")
    return e.select("l_orderkey", F.size("label.entries").cast("long").alias("entries"), F.aggregate("label.entries", F.lit(0).cast("long"), lambda a, x: a + x["jumlah"]).alias("total"), n(lambda x: x["type"] == "pemasukan").alias("income"), n(lambda x: x["ambigu"]).alias("ambigu"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN 'medium' WHEN event_id % 5 = 1 THEN 'low' WHEN event_id % 5 = 2 THEN CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END ELSE 'high' END AS confidence,
CASE WHEN event_id % 3 = 0 THEN CAST(floor(value + 0.5) AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(floor(value) AS BIGINT) * 1000 ELSE 0 END AS jumlah, CASE WHEN event_id % 7 = 0 THEN true ELSE false END AS bukan_transaksi,
CASE WHEN event_id % 11 = 0 THEN 'no_json' WHEN event_id % 11 = 1 THEN 'not_an_object' WHEN event_id % 11 = 2 THEN 'entry_not_an_object' END AS parse_error FROM events""")
def lenient_values(spark, d):
    """Values as answers write them: keys missing or null, numbers and text, flags that are none, answers that can't be read."""
    k, v = F.col("event_id"), F.col("value")
    sure = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit(', "confidence": null')).when(k % 5 == 2, F.concat(F.lit(', "confidence": '), (v / 100).cast("string"))).when(k % 5 == 3, F.lit(', "confidence": true')).otherwise(F.lit(', "confidence": {}'))
    amount = F.when(k % 3 == 0, F.concat(F.lit('"jumlah": '), v.cast("string"))).when(k % 3 == 1, F.concat(F.lit('"jumlah": null, "amount": "'), F.floor(v).cast("string"), F.lit('rb"'))).otherwise(F.lit('"type": "x"'))
    flag = F.when(k % 7 == 0, "true").when(k % 7 == 1, '"true"').when(k % 7 == 2, "1").when(k % 7 == 3, "null").otherwise("false")
    said = F.concat(F.lit('{"entries": null, "transaksi": [{'), amount, sure, F.lit('}], "bukan_transaksi": '), flag, F.lit("}"))
    raw = F.when(k % 11 == 0, F.lit("sorry")).when(k % 11 == 1, F.lit("12")).when(k % 11 == 2, F.lit('{"entries": [1]}')).otherwise(said)
    e = table(spark, d, "events").select("event_id", fn.read_label(said).alias("r"), fn.read_label(raw)["parse_error"].alias("parse_error"))
    one = F.get("r.label.entries", F.lit(0))
    return e.select("event_id", one["confidence"].alias("confidence"), one["jumlah"].alias("jumlah"), F.col("r.label.bukan_transaksi").alias("bukan_transaksi"), "parse_error")


@query("""SELECT l_orderkey, count(*) FILTER (l_linenumber = 3) = 0 AS same FROM lineitem GROUP BY 1""")
def bijection(spark, d):
    a = F.collect_list(F.floor("l_extendedprice").cast("long"))
    b = F.collect_list((F.floor("l_extendedprice") + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)).cast("long"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(fn.same_amounts(a, b).alias("same"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS answers, CASE WHEN coalesce(n, 0) = 0 THEN 'batch:missing' WHEN n > 1 THEN 'batch:duplicate' ELSE 'ok' END AS phase FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1) ON l_orderkey = o_orderkey""")
def batch_reconcile(spark, d):
    a = table(spark, d, "lineitem").where("l_linenumber % 3 = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.reconcile_ids(table(spark, d, "orders"), a, "o_orderkey")


@query("""SELECT event_id, user_id, (row_number() OVER w - 1) // 5 AS chunk, (row_number() OVER w - 1) % 5 AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def chunk_plan(spark, d):
    return op.chunk_plan(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 5)


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) ORDER BY o_orderkey LIMIT 50""")
def claim_batch(spark, d):
    """A scheduler's next 50 rows: the limit is the feature."""
    _, n = op.room(count=120, accepted=40, in_flight=30, batch=80)
    return op.claim(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderkey", n)


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'reject' WHEN event_type = 'error' AND CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 2 = 0 THEN 'fatal' ELSE 'retry' END AS error_class FROM events""")
def error_classes(spark, d):
    odd = F.regexp_extract("props", r"(\d+)", 1).cast("int") % 2 == 0
    said = F.when((F.col("event_type") == "error") & odd, "HTTP 404: nothing here").otherwise("HTTP 4040 socket hang up")
    return table(spark, d, "events").select("event_id", op.error_class(said, F.when(F.col("event_type") == "signup", "label:strict")).alias("error_class"))


@query("""SELECT event_id, event_type IN ('view', 'click', 'error') AS thinking FROM events""")
def thinking_detection(spark, d):
    k = F.col("event_type")
    content = F.when(k == "view", "x <THINK>hm</think> y").otherwise("plain")
    return table(spark, d, "events").select("event_id", text.thinking(content, F.when(k == "click", "why"), F.when(k == "error", " . ").otherwise("  ")).alias("thinking"))


@query("""WITH w AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 2) AS changed, count(*) FILTER (l_linenumber = 4) AS turned FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'non_transaction' ELSE rtrim(repeat('jumlah,', changed) || repeat('type,', turned), ',') END AS diffs FROM w""")
def agreement(spark, d):
    """Labels against a specification of two alternatives: one line's amount or direction off, or one line too many."""
    a = answers(spark, d).withColumn("label", F.struct(F.transform("label.entries", lambda x, i: x.withField("jumlah", x["jumlah"] * 100 + i)).alias("entries"), F.col("label.bukan_transaksi").alias("bukan_transaksi")))
    line = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: n)
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(line.alias("lines"))
    j = a.join(n, "l_orderkey")
    wanted = F.zip_with("label.entries", "lines", lambda x, n: F.struct(F.when(n == 4, F.when(x["type"] == "pemasukan", "pengeluaran").otherwise("pemasukan")).otherwise(x["type"]).alias("type"), (x["jumlah"] + F.when(n == 2, 50).otherwise(0)).alias("jumlah"), x["tanggal_hint"].alias("tanggal_hint"), x["ambigu"].alias("ambigu")))
    alternatives = F.array(wanted, F.concat(wanted, wanted))
    diffs = fn.agreement(F.col("label"), F.lit(False), alternatives, F.array(F.lit(-1).cast("long")))
    return j.select("l_orderkey", F.array_join(diffs, ",").alias("diffs"))


def generated(spark, d):
    """One generated row per order: a text, its cell's invariants and a label, each broken in its own way."""
    k, v = F.col("o_orderkey") % 8, (F.floor(F.col("o_totalprice") / 1000) * 1000 + 1000).cast("long")
    none = {n: F.lit(None) for n in ("rupiah", "hint", "applies_to", "at_least", "unit", "count", "total", "masuk")}
    inv = lambda kind, **over: F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for n, c in (none | over).items())).cast(spec.INVARIANT)
    qty = F.array(inv("qty_merge_ok", unit=F.col("v"), count=F.lit(3)))
    plain = F.array(inv("amount_present", rupiah=F.col("v")), inv("date_hint", hint=F.lit("kemarin"), applies_to=F.lit("all")))
    gross = F.concat(plain, F.array(inv("amount_absent", rupiah=F.lit(700).cast("long"))))
    entry = lambda n: F.struct(F.lit("pengeluaran").alias("type"), F.when(F.col("k") == 6, "hari_ini").otherwise("kemarin").alias("tanggal_hint"), F.lit("kopi").alias("deskripsi"), n.cast("long").alias("jumlah"), F.lit(None).cast("string").alias("kategori"), F.lit(None).cast("string").alias("vendor"), F.lit("low").alias("confidence"), F.lit(False).alias("ambigu"), F.lit(None).cast("string").alias("catatan_ambigu"))
    o = table(spark, d, "orders").select("o_orderkey", k.alias("k"), v.alias("v"))
    said = F.when(F.col("k") == 1, F.concat(F.lit("kopi "), F.col("v") + 1)).when(F.col("k") == 2, F.concat(F.lit("kopi 12.500 rb"))).when(F.col("k") == 5, F.concat(F.lit("kopi "), F.col("v"), F.lit(" jeruk 700"))).otherwise(F.concat(F.lit("kopi "), F.col("v")))
    entries = F.when(F.col("o_orderkey") % 24 == 0, F.array(entry(F.col("v") * 2))).when(F.col("k") == 3, F.array(entry(F.col("v")), entry(F.col("v")))).when(F.col("k") == 4, F.array(entry(F.col("v") * 100 + 7))).when(F.col("k") == 7, F.array(entry(F.col("v") * 3))).otherwise(F.array(entry(F.col("v"))))
    return o.select("o_orderkey", said.alias("text"), F.when(F.col("k") == 7, qty).when(F.col("k") == 5, gross).otherwise(plain).alias("inv"), F.array(F.when(F.col("k") == 2, 12_500_000).otherwise(F.col("v")).cast("long")).alias("surfaces"), F.struct(entries.alias("entries"), F.lit(False).alias("bukan_transaksi"), F.lit(None).cast("string").alias("ringkasan")).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'text:leak' WHEN o_orderkey % 8 = 1 THEN 'text:bijection' WHEN o_orderkey % 8 = 2 THEN 'text:ambiguous-amount' WHEN o_orderkey % 19 = 0 THEN 'label:plain-json' WHEN o_orderkey % 17 = 0 OR o_orderkey % 8 = 3 THEN 'label:schema' WHEN o_orderkey % 8 = 4 THEN 'label:trace'
WHEN o_orderkey % 24 = 0 THEN 'label:dropped-entry' WHEN o_orderkey % 8 = 6 THEN 'agreement' WHEN o_orderkey % 11 = 0 THEN 'dedup' END AS phase FROM orders""")
def validate_rows(spark, d):
    """The first gate each generated row fails."""
    g = generated(spark, d).withColumn("atoms", amounts.amount_atoms(F.col("text")))
    said = F.to_json("label", {"ignoreNullFields": "false"})
    raw = F.when(F.col("o_orderkey") % 19 == 0, F.lit("no answer")).when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit('{"note": 1, '), F.substring(said, 2, 100_000))).otherwise(said)
    phase = spec.row_phase(F.col("text"), F.col("atoms"), F.col("label"), F.col("inv"), F.col("surfaces"), F.lit("out"), F.col("o_orderkey") % 13 == 0, raw, F.col("o_orderkey") % 11 == 0)
    return g.select("o_orderkey", phase.alias("phase"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(floor(o_totalprice / 1000) * 1000 + 1000 AS BIGINT) AS v FROM orders)
SELECT o_orderkey, CASE WHEN k = 7 THEN v || '+' || v || '+' || v || '|' || v * 3 ELSE v::VARCHAR END AS alternatives, concat_ws(',', CASE WHEN k = 5 THEN '700' END, CASE WHEN k = 2 AND v <> 12500000 THEN '12500000' END, CASE WHEN k = 7 THEN v::VARCHAR END) AS excused, CASE WHEN k = 7 THEN (v * 3)::VARCHAR ELSE '' END AS traceable FROM o""")
def cell_expectations(spark, d):
    """What labels may hold, and which amounts are excused or right without being named."""
    g, out = generated(spark, d), F.lit("out")
    flat = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    alts = F.transform(spec.alternatives(F.col("inv"), out), lambda a: F.array_join(F.transform(a, lambda e: e["jumlah"].cast("string")), "+"))
    return g.select("o_orderkey", F.array_join(alts, "|").alias("alternatives"), flat(spec.excused(F.col("surfaces"), F.col("inv"), out)).alias("excused"), flat(spec.traceable(F.col("inv"), out)).alias("traceable"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS part FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'batch:missing' WHEN n > 1 THEN 'batch:duplicate' WHEN part < 10 THEN 'batch:text-schema' END AS phase, CASE WHEN n = 1 AND part >= 10 THEN part || ' x' END AS text FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def batch_salvage(spark, d):
    """Answers matched by id and cleaned; what can't be used carries its phase."""
    li = table(spark, d, "lineitem").where("l_linenumber % 3 = 1")
    said = li.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_partkey") < 10, "``x``").otherwise(F.concat(F.lit(' "'), F.col("l_partkey").cast("string"), F.lit(' x"\nmore'))).alias("raw"))
    one = said.groupBy("o_orderkey").agg(F.min("raw").alias("raw"))
    j = op.reconcile_ids(table(spark, d, "orders"), said, "o_orderkey").join(one, "o_orderkey", "left")
    clean = F.when(F.col("phase") == "ok", text.batch_text(F.col("raw")))
    return j.select("o_orderkey", F.when(F.col("phase") != "ok", F.col("phase")).when(clean.isNull(), "batch:text-schema").alias("phase"), clean.alias("text"))
