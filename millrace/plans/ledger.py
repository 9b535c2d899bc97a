"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ledger as op
from millrace.plans.registry import query
from millrace.sources.tables import LEDGER_SQL, ledger, table

L = f"WITH {LEDGER_SQL}\n"


@query(L + """SELECT '*' AS org_id, type, count(*) AS n_rows, CAST(sum(jumlah) AS BIGINT) AS total FROM ledger WHERE org_id = 'MACHINERY' GROUP BY type
UNION ALL SELECT org_id, type, count(*), CAST(sum(jumlah) AS BIGINT) FROM ledger GROUP BY org_id, type""")
def ledger_summary(spark, d):
    return op.summary(ledger(spark, d), "MACHINERY")


@query(L + """SELECT org_id, CAST(coalesce(sum(jumlah) FILTER (type = 'pemasukan'), 0) - coalesce(sum(jumlah) FILTER (type <> 'pemasukan'), 0) AS BIGINT) AS net, count(*) AS n_rows FROM ledger GROUP BY org_id""")
def ledger_net_by_org(spark, d):
    return ledger(spark, d).groupBy("org_id").agg(op.net().alias("net"), F.count("*").alias("n_rows"))


@query(L + """SELECT CAST(coalesce(sum(jumlah), 0) AS BIGINT) AS total, count(*) AS n_rows FROM ledger WHERE tanggal BETWEEN '1997-01-01' AND '1997-06-30' AND type = 'pengeluaran'""")
def period_sum(spark, d):
    return op.period_sum(ledger(spark, d), "1997-01-01", "1997-06-30", op.EXPENSE)


@query(L + """SELECT org_id, CAST(coalesce(sum(jumlah) FILTER (tanggal BETWEEN '1998-01-01' AND '1998-12-31'), 0) AS BIGINT) AS this_period,
CAST(coalesce(sum(jumlah) FILTER (tanggal BETWEEN '1997-01-01' AND '1997-12-31'), 0) AS BIGINT) AS last_period,
CAST(coalesce(sum(jumlah) FILTER (tanggal BETWEEN '1998-01-01' AND '1998-12-31'), 0) - coalesce(sum(jumlah) FILTER (tanggal BETWEEN '1997-01-01' AND '1997-12-31'), 0) AS BIGINT) AS change
FROM ledger GROUP BY org_id""")
def period_over_period(spark, d):
    now, before = F.col("tanggal").between("1998-01-01", "1998-12-31"), F.col("tanggal").between("1997-01-01", "1997-12-31")
    return ledger(spark, d).groupBy("org_id").agg(op.sum_if(now).alias("this_period"), op.sum_if(before).alias("last_period"), (op.sum_if(now) - op.sum_if(before)).alias("change"))


@query(L + """SELECT vendor, count(*) AS n_rows, count(*) FILTER (tanggal < '1997-06-01') AS baseline, count(*) <= count(*) FILTER (tanggal < '1997-06-01') AS isolated FROM ledger GROUP BY vendor""")
def org_isolation(spark, d):
    """Customers as tenants; rows up to a date are the seed, and no tenant may gain any."""
    led = ledger(spark, d)
    return op.org_leaks(led, led.where("tanggal < '1997-06-01'"), "vendor")


@query("""WITH l AS (SELECT l_orderkey AS k, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) + 0.5) AS BIGINT) AS r FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS l FROM orders)
SELECT k AS order_key, o.l AS left_jumlah, l.r AS right_jumlah, CASE WHEN l.r IS NULL THEN 'left_only' WHEN o.l IS NULL THEN 'right_only' WHEN o.l = l.r THEN 'matched' ELSE 'amount_diff' END AS status FROM o FULL OUTER JOIN l USING (k)""")
def reconcile_orders_lineitem(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.floor(F.col("o_totalprice") + 0.5).cast("long").alias("jumlah"))
    right = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) + F.lit(0.5).cast("decimal(2,1)")).cast("long").alias("jumlah"))
    return op.reconcile(left, right, "order_key")


@query("""WITH a AS (SELECT count(*) AS n, sum(CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS s FROM orders),
b AS (SELECT count(*) AS n, sum(CAST(floor(l_extendedprice + 0.5) AS BIGINT)) AS s FROM lineitem)
SELECT a.n AS csv_rows, b.n AS ledger_rows, CAST(a.s AS BIGINT) AS csv_total, CAST(b.s AS BIGINT) AS ledger_total, a.n = b.n AND a.s = b.s AS ok FROM a, b""")
def csv_sum_matches_ledger(spark, d):
    # two one-row aggregates meet on a constant
    a = table(spark, d, "orders").agg(F.count("*").alias("csv_rows"), F.sum(F.floor(F.col("o_totalprice") + 0.5).cast("long")).alias("csv_total")).withColumn("k", F.lit(1))
    b = table(spark, d, "lineitem").agg(F.count("*").alias("ledger_rows"), F.sum(F.floor(F.col("l_extendedprice") + 0.5).cast("long")).alias("ledger_total")).withColumn("k", F.lit(1))
    return a.join(b, "k").select("csv_rows", "ledger_rows", "csv_total", "ledger_total", ((F.col("csv_rows") == F.col("ledger_rows")) & (F.col("csv_total") == F.col("ledger_total"))).alias("ok"))


@query(L + """SELECT org_id, type, jumlah // 100000 * 100000 AS jumlah, tanggal, deskripsi, source, min(id) AS id, count(*) AS copies FROM ledger GROUP BY ALL""")
def duplicate_posts(spark, d):
    """By the whole key; amounts are coarse, so that some rows repeat."""
    led = ledger(spark, d).withColumn("jumlah", (F.floor(F.col("jumlah") / 100_000) * 100_000).cast("long"))
    return op.deduplicate(led).select(*op.DUPLICATE_KEY, "id", "copies")


@query(L + """, v AS (SELECT * REPLACE ('v' || CAST(regexp_extract(vendor, '(\\d+)$', 1) AS INTEGER) % 200 AS vendor) FROM ledger), m AS (SELECT org_id, type, sum(jumlah) AS s, count(*) AS n FROM v GROUP BY 1, 2),
h AS (SELECT vendor, org_id, count(*) AS here, max(count(*)) OVER (PARTITION BY vendor) AS most FROM v GROUP BY 1, 2)
SELECT * FROM (SELECT id, org_id, type, jumlah, tanggal, concat_ws(',', CASE WHEN jumlah * n > s * 1.75 THEN 'spike' END, CASE WHEN catatan = 'NO_RECEIPT' THEN 'no_receipt' END,
CASE WHEN dayofweek(CAST(tanggal AS DATE)) IN (0, 6) AND jumlah >= 150000 THEN 'weekend_large' END, CASE WHEN here * 2 < most THEN 'wrong_org_maybe' END) AS flags FROM v JOIN m USING (org_id, type) JOIN h USING (vendor, org_id)) WHERE flags <> ''""")
def anomaly_flags(spark, d):
    """Vendors are taken together, so that one trades with several organisations."""
    led = ledger(spark, d).withColumn("vendor", F.concat(F.lit("v"), (F.regexp_extract("vendor", r"(\d+)$", 1).cast("int") % 200).cast("string")))
    return op.anomalies(led, 1.75, 150_000).select("id", "org_id", "type", "jumlah", "tanggal", "flags")


def monthly(spark, d):
    """The ledger with its month and coarse amounts, 0 to 45000 in steps of 5000."""
    return ledger(spark, d).withColumn("month", F.substring("tanggal", 1, 7)).withColumn("jumlah", (F.floor(F.col("jumlah") / 50_000) * 5_000).cast("long"))


MONTHLY = L + ", m AS (SELECT * REPLACE (jumlah // 50000 * 5000 AS jumlah), substr(tanggal, 1, 7) AS month FROM ledger)\n"


@query(MONTHLY + """SELECT org_id, month, count(*) AS n_rows, count(*) = 4 AS row_count, count(*) FILTER (catatan = 'NO_RECEIPT') = 0 AS no_posted_rows, bool_or(type = 'pemasukan' AND jumlah = 15000 AND contains(deskripsi || ' ' || vendor, 'urgent')) AS has_amount,
NOT bool_or(jumlah = 35000 AND type = 'pengeluaran') AS no_amount, NOT bool_or(jumlah = 40000) AS no_amount_any, count(*) FILTER (ambigu) >= 2 AS has_ambigu, bool_or(contains(vendor || ' ' || deskripsi, '7')) AS has_vendor, bool_or(contains(vendor || ' ' || deskripsi, '-high') AND jumlah = 10000) AS has_vendor_amount,
CAST(floor(40.0 * (CAST(count(*) FILTER (ambigu) >= 2 AS INT) + CAST(bool_or(contains(vendor || ' ' || deskripsi, '7')) AS INT)) / 2 + 0.5) AS BIGINT) AS score FROM m GROUP BY org_id, month""")
def ledger_asserts(spark, d):
    """Asserts over the rows of each organisation and month."""
    ambigu, vendor = F.count(F.when(F.col("ambigu"), 1)) >= 2, op.has_vendor("7")
    return monthly(spark, d).groupBy("org_id", "month").agg(
        F.count("*").alias("n_rows"), (F.count("*") == 4).alias("row_count"), (F.count(F.when(F.col("catatan") == "NO_RECEIPT", 1)) == 0).alias("no_posted_rows"), op.has_amount(None, op.INCOME, 15_000, ["Urgent"]).alias("has_amount"),
        op.no_amount(35_000, op.EXPENSE).alias("no_amount"), op.no_amount(40_000).alias("no_amount_any"), ambigu.alias("has_ambigu"), vendor.alias("has_vendor"), op.has_vendor("-HIGH", 10_000).alias("has_vendor_amount"),
        op.assert_score(ambigu.cast("int") + vendor.cast("int"), F.lit(2)).alias("score"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 7 = 0) >= 1 AS ambigu FROM orders GROUP BY 1), r AS (SELECT conv_id AS k, bool_or(contains(lower(text), 'the') OR contains(lower(text), 'que')) AS asked FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT k, coalesce(ambigu, false) OR coalesce(asked, false) AS ok FROM a FULL OUTER JOIN r USING (k)""")
def ambigu_or_ask(spark, d):
    """An ambiguous row, or a reply that asks; customers and conversations share numbers."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count(F.when(F.col("o_orderkey") % 7 == 0, 1)) >= 1).alias("ambigu"))
    said = table(spark, d, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("k")).agg(op.mentions(F.col("text"), ["The", "que"]).alias("asked"))
    return rows.join(said, "k", "full_outer").select("k", (F.coalesce("ambigu", F.lit(False)) | F.coalesce("asked", F.lit(False))).alias("ok"))


@query("""WITH c AS (SELECT user_id AS id, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)
SELECT id, event_id, op, value FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1 AND op <> 'delete'""")
def change_log_state(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return op.latest(e, "id", ["event_id"])


@query(L + """SELECT type, source, count(*) AS n_rows, CAST(sum(jumlah) AS BIGINT) AS total FROM ledger WHERE org_id = 'FURNITURE' AND source = 'bank' GROUP BY type, source""")
def free_select(spark, d):
    """Any SELECT runs on views; parameters are bound, not pasted."""
    return spark.sql("SELECT type, source, count(*) AS n_rows, sum(jumlah) AS total FROM {ledger} WHERE org_id = :org AND source = :source GROUP BY type, source", args={"org": "FURNITURE", "source": "bank"}, ledger=ledger(spark, d))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS j, strftime(o_orderdate, '%Y-%m-%d') AS tanggal, o_orderpriority AS deskripsi FROM orders)
SELECT tanggal, deskripsi, j AS jumlah, CASE WHEN k = 1 THEN 'pemasukan' ELSE 'pengeluaran' END AS type FROM s WHERE k <> 0 AND id % 3 = 0""")
def statement_import(spark, d):
    k = F.col("o_orderkey") % 4
    total = F.floor(F.col("o_totalprice") + 0.5).cast("long")
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("tanggal"), F.col("o_orderpriority").alias("keterangan"), F.when(k == 1, total).otherwise(-total).alias("jumlah"), F.when(k == 0, "internal").when(k == 1, "pemasukan").otherwise("pengeluaran").alias("arah"), F.when(F.col("o_orderkey") % 3 == 0, "yayasan").otherwise("pribadi").alias("org_hint"))
    return op.import_statement(rows, "yayasan")


@query(MONTHLY + """, v AS (SELECT org_id, month, list(DISTINCT jumlah) AS have, count(*) FILTER (jumlah = 5000) AS fives FROM m GROUP BY 1, 2), x AS (SELECT *, list_filter([20000, 15000, 10000], lambda n: NOT list_contains(have, n)) AS missing FROM v)
SELECT org_id, month, len(missing) = 0 OR ((list_contains(have, 20000) OR fives >= 4) AND len(list_filter(missing, lambda x: x NOT IN (20000, 5000))) = 0) OR ((list_contains(have, 15000) OR fives >= 3) AND len(list_filter(missing, lambda x: x NOT IN (15000, 5000))) = 0) AS ok FROM x""")
def amounts_set(spark, d):
    """Are the wanted amounts there, in whole or as rows of 5000?"""
    each = monthly(spark, d).groupBy("org_id", "month", F.col("jumlah").alias("value")).agg(F.count("*").alias("n"))
    # few distinct amounts, and of each no more copies than the rule asks for
    have = each.groupBy("org_id", "month").agg(F.flatten(F.collect_list(F.array_repeat("value", F.least("n", F.lit(4)).cast("int")))).alias("have"))
    return have.select("org_id", "month", op.amounts_ok(F.col("have"), [20_000, 15_000, 10_000]).alias("ok"))


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'yayasan' ELSE 'pribadi' END AS org, count(*) AS lines, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS gained FROM orders GROUP BY 1""")
def import_gains(spark, d):
    """Rows that each tenant gains from a statement imported for one of them: the others none."""
    k = F.col("o_orderkey") % 4
    total = F.floor(F.col("o_totalprice") + 0.5).cast("long")
    rows = table(spark, d, "orders").select(F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("tanggal"), F.col("o_orderkey").cast("string").alias("keterangan"), F.when(k == 1, total).otherwise(-total).alias("jumlah"), F.when(k == 0, "internal").when(k == 1, "pemasukan").otherwise("pengeluaran").alias("arah"), F.when(F.col("o_orderkey") % 3 == 0, "yayasan").otherwise("pribadi").alias("org_hint"))
    taken = op.import_statement(rows, "yayasan").select(F.col("deskripsi").alias("keterangan"), F.lit(1).alias("got"))
    return rows.join(taken, "keterangan", "left").groupBy(F.col("org_hint").alias("org")).agg(F.count("*").alias("lines"), F.count("got").alias("gained"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'seed' FROM orders WHERE o_orderkey % 5 = 0""")
def seed_rows(spark, d):
    """Seeds are inserted where the table has no such key, else ignored."""
    o = table(spark, d, "orders")
    have = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return op.seeded(have, o.select(F.col("o_orderkey").alias("id"), F.lit("seed").alias("status")))
