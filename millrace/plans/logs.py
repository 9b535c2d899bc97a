"""Tool logs, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ledger as ledger_op
from millrace.plans.registry import query
from millrace.sources import files
from millrace.sources.tables import table


@query("""SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'view') < min(event_id) FILTER (event_type = 'purchase'), false) AS in_order, count(DISTINCT event_type) AS tools, count(*) AS calls FROM events GROUP BY user_id""")
def tool_order(spark, d):
    return ledger_op.first_before(table(spark, d, "events"), "user_id", "event_type", "event_id", "view", "purchase")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') >= 3 AS clicked, count(DISTINCT event_type) >= 5 AS all_tools FROM events GROUP BY user_id""")
def distinct_tools(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg((F.count(F.when(F.col("event_type") == "click", 1)) >= 3).alias("clicked"), (F.count_distinct("event_type") >= 5).alias("all_tools"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'image' WHEN page_id % 4 = 1 THEN 'csv' WHEN page_id % 4 = 2 THEN 'pdf' ELSE 'file' END AS kind FROM pages""")
def inbox_kinds(spark, d):
    k = F.col("page_id") % 4
    name = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(k == 0, "x.JPG").when(k == 1, ".csv").when(k == 2, ".pdf.txt").otherwise(".exe"))
    return table(spark, d, "pages").select("page_id", files.file_kind(name).alias("kind"))


@query("""SELECT event_id, event_id || ',' || event_type || ',"' || replace(props, '"', '""') || '"' AS line, CASE WHEN event_type = 'error' THEN 'error' ELSE event_type END AS second, split_part(event_id || ',' || event_type || ',' || props, ',', 3) AS third, '' AS fourth FROM events""")
def csv_roundtrip(spark, d):
    """Quoted writing and naive reading: the two are not inverse on cells with quotes."""
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    raw = F.concat_ws(",", "event_id", "event_type", "props")
    cells = files.naive_cells(raw, 4)
    return e.select("event_id", files.csv_line(["event_id", "event_type", "props"]).alias("line"), cells[1].alias("second"), cells[2].alias("third"), cells[3].alias("fourth"))


@query("""SELECT o_orderkey, abs(CAST(floor(o_totalprice) AS DOUBLE)) AS amount FROM orders""")
def csv_amounts(spark, d):
    v = F.floor("o_totalprice")
    cell = F.concat(F.lit("Rp -"), v.cast("string"), F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", files.amount_cell(cell).alias("amount"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 3 END AS n, 'assistant' AS last_role, text AS user_text FROM conversations WHERE role = 'user'""")
def chatml(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    m = files.chatml(F.col("text"), F.to_json(F.struct("conv_id")), F.when(F.col("conv_id") % 3 != 0, "be brief"))
    return c.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.size("m").alias("n"), F.element_at("m", -1)["role"].alias("last_role"), F.element_at("m", -2)["content"].alias("user_text"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'base' WHEN event_type = 'click' THEN 'hard' WHEN event_id % 2 = 0 THEN 'hard' END AS kind FROM events""")
def artifact_kinds(spark, d):
    """Run artifacts told apart by their fields."""
    k = F.col("event_type")
    doc = F.when(k == "view", '{"kind": "parse-base"}').when(k == "click", '{"kind": "parse-hard-25", "suite": "base"}').otherwise('{"kind": "other"}')
    path = F.concat(F.lit("runs/"), F.when(F.col("event_id") % 2 == 0, "x-hard-25.json").otherwise("x.json"))
    return table(spark, d, "events").select("event_id", files.artifact_kind(F.try_parse_json(doc), path).alias("kind"))


@query("""SELECT conv_id, bool_or(contains(lower(text), 'the ') OR contains(lower(text), 'que')) AS mentions, NOT bool_or(contains(lower(text), 'on') OR contains(lower(text), 'zebra')) AS silent, count(*) AS turns FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def reply_mentions(spark, d):
    """Does any reply hold any of the phrases, and does none hold any of others?"""
    t = F.col("text")
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(ledger_op.mentions(t, ["The ", "que"]).alias("mentions"), (~ledger_op.mentions(t, ["ON", "zebra"])).alias("silent"), F.count("*").alias("turns"))


@query("""SELECT user_id, coalesce(bool_or(contains(lower(props), '7') OR contains(lower(props), 'k": 1}')) FILTER (event_type IN ('click', 'view')), false) AS ok FROM events GROUP BY user_id""")
def sql_mentions(spark, d):
    """Do the arguments of any database call hold any of the phrases?"""
    said = F.when(F.col("event_type").isin("click", "view"), F.col("props"))
    return table(spark, d, "events").groupBy("user_id").agg(ledger_op.mentions(said, ["7", 'K": 1}']).alias("ok"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def resume_plan(spark, d):
    """Rows a resumed run still has to write."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select("o_orderkey")


@query("""SELECT doc_id, CASE WHEN length(text) < 300 THEN 'text:short' WHEN k > 1 THEN 'dedup' WHEN doc_id % 19 = 0 THEN 'text:leak' WHEN doc_id % 23 = 0 THEN 'transport' ELSE 'accepted' END AS phase FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(lower(text)) ORDER BY doc_id) AS k FROM documents)""")
def reject_split(spark, d):
    """Accepted and rejected rows with the first phase that failed; errors of no phase are leaks or transport."""
    from millrace.functions.labels import first_phase
    from millrace.operators.batches import reject_phase
    from millrace.operators.similarity import first_of_each

    docs = table(spark, d, "documents").select("doc_id", "text")
    first = first_of_each(docs).select("doc_id", F.lit(True).alias("first"))
    j = docs.join(first, "doc_id", "left")
    phase = first_phase(("text:short", F.length("text") < 300), ("dedup", F.col("first").isNull()))
    leaked, lost = F.col("doc_id") % 19 == 0, F.col("doc_id") % 23 == 0
    return j.select("doc_id", F.when(phase.isNotNull() | leaked | lost, reject_phase(phase, leaked)).otherwise("accepted").alias("phase"))
