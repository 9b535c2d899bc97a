"""Leaderboard and manifest queries; events stand in for run results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import js_round
from millrace.operators import boards as op
from millrace.plans.registry import query
from millrace.sources import files
from millrace.sources.tables import table


def runs(spark, d):
    """Events as scenario results: model (user), scenario, score, milliseconds, errors."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("model"), (F.col("event_id") % 25).alias("scenario"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("run_at"), "event_type", (F.floor("value") % 101).cast("long").alias("score"), F.floor(F.col("value") * 10).cast("long").alias("ms"), (F.col("event_type") == "error").alias("error"))


R = """WITH runs AS (SELECT event_id, user_id AS model, event_id % 25 AS scenario, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS run_at, event_type,
CAST(floor(value) AS BIGINT) % 101 AS score, CAST(floor(value * 10) AS BIGINT) AS ms, event_type = 'error' AS error FROM events)
"""


@query(R + """SELECT model, run_at, event_id, score FROM runs QUALIFY row_number() OVER (PARTITION BY model ORDER BY run_at DESC, event_id DESC) = 1""")
def newest_per_key(spark, d):
    return op.newest(runs(spark, d).select("model", "run_at", "event_id", "score"), ["model"], ["run_at", "event_id"])


BOARD_SQL = R + """, base AS (SELECT model, count(*) FILTER (event_type = 'view') AS base_pass, CAST(sum(CASE WHEN error THEN 0 ELSE ms END) AS DOUBLE) / count(*) AS base_ms FROM runs WHERE model % 3 <> 0 GROUP BY model),
hard AS (SELECT model, count(*) FILTER (event_type = 'purchase' AND score >= 50) AS hard_strict, CAST(sum(score) AS DOUBLE) / count(*) AS composite, CAST(sum(ms) AS DOUBLE) / count(*) AS hard_ms FROM runs WHERE model % 4 <> 0 GROUP BY model),
m AS (SELECT model, base_pass, base_ms, hard_strict, floor(composite * 10 + 0.5) / 10 AS composite, hard_ms FROM base FULL OUTER JOIN hard USING (model))
SELECT *, CAST(row_number() OVER (ORDER BY coalesce(hard_strict, -1) DESC, coalesce(composite, -1) DESC, coalesce(base_pass, -1) DESC, coalesce(hard_ms, base_ms, 'infinity'::DOUBLE), model) AS INTEGER) AS rank FROM m"""


@query(BOARD_SQL)
def leaderboard_merge(spark, d):
    r = runs(spark, d)
    mean = lambda c: F.sum(c).cast("double") / F.count("*")
    base = r.where("model % 3 <> 0").groupBy("model").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("base_pass"), mean(F.when(F.col("error"), 0).otherwise(F.col("ms"))).alias("base_ms"))  # an errored scenario counts, with 0 ms
    hard = r.where("model % 4 <> 0").groupBy("model").agg(F.count(F.when((F.col("event_type") == "purchase") & (F.col("score") >= 50), 1)).alias("hard_strict"), mean("score").alias("composite"), mean("ms").alias("hard_ms"))
    return op.merge_boards(base, hard)


@query("""SELECT l_orderkey, l_linenumber, floor(1000.0 * ((l_orderkey % 41) / 40) * ((l_orderkey % 41) / 40) * ((l_partkey % 101) / 100) + 0.5) / 10 AS public_score FROM lineitem""")
def public_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.public_score(F.col("l_orderkey") % 41, F.col("l_partkey") % 101).alias("public_score"))


@query(R + """SELECT model, count(*) FILTER (NOT error) AS n, CAST(sum(score) FILTER (NOT error) AS DOUBLE) / nullif(count(*) FILTER (NOT error), 0) AS mean_score, min(score) FILTER (NOT error) AS low, max(score) FILTER (NOT error) AS high,
count(*) FILTER (NOT error AND score < 60) AS under_60, count(*) FILTER (NOT error AND score < 80) AS under_80, count(*) FILTER (NOT error AND score >= 99.5) AS perfect, count(*) FILTER (error) AS errors_skipped,
floor(sum(score) * 10.0 / count(*) + 0.5) / 10 AS avg_score, floor(sum(ms % 101) * 10.0 / count(*) + 0.5) / 10 AS avg_following, count(*) FILTER (event_type = 'purchase') AS tier_count FROM runs WHERE scenario < 14 GROUP BY model""")
def suite_rollup(spark, d):
    r = runs(spark, d)
    headline = spark.range(14).select(F.col("id").alias("scenario"))
    ok = ~F.col("error")
    count = lambda c: F.count(F.when(c, 1))
    return r.join(F.broadcast(headline), "scenario", "left_semi").groupBy("model").agg(
        count(ok).alias("n"), (F.sum(F.when(ok, F.col("score"))).cast("double") / F.nullif(count(ok), F.lit(0))).alias("mean_score"), F.min(F.when(ok, F.col("score"))).alias("low"), F.max(F.when(ok, F.col("score"))).alias("high"),
        count(ok & (F.col("score") < 60)).alias("under_60"), count(ok & (F.col("score") < 80)).alias("under_80"), count(ok & (F.col("score") >= 99.5)).alias("perfect"), count(F.col("error")).alias("errors_skipped"),
        *((F.floor(F.sum(v) * 10.0 / F.count("*") + 0.5) / 10).alias(n) for n, v in (("avg_score", F.col("score")), ("avg_following", F.col("ms") % 101))), count(F.col("event_type") == "purchase").alias("tier_count"))

LEGACY = "score % 41 + event_id % 26 + ms % 26 + CAST(floor((score / 100) * 10 + 0.5) AS BIGINT)"


@query(R + f""", a AS (SELECT model, CAST(sum(score) AS DOUBLE) / count(*) AS mean_score, CAST(sum({LEGACY}) AS DOUBLE) / count(*) AS legacy FROM runs GROUP BY model)
SELECT model, mean_score, legacy, mean_score - legacy AS delta, max(mean_score) OVER () - min(mean_score) OVER () AS spread, CAST(row_number() OVER (ORDER BY mean_score DESC, model) AS INTEGER) AS rank FROM a""")
def spread_rank(spark, d):
    legacy = op.legacy_total(F.col("score") % 41, F.col("event_id") % 26, F.col("ms") % 26, F.col("score"))
    a = runs(spark, d).groupBy("model").agg((F.sum("score").cast("double") / F.count("*")).alias("mean_score"), (F.sum(legacy).cast("double") / F.count("*")).alias("legacy"))
    w = W.orderBy(F.desc("mean_score"), "model")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return a.select("model", "mean_score", "legacy", (F.col("mean_score") - F.col("legacy")).alias("delta"), (F.max("mean_score").over(every) - F.min("mean_score").over(every)).alias("spread"), F.row_number().over(w).alias("rank"))


@query("""SELECT lang, source, count(*) AS n, floor(count(*) * 1000.0 / sum(count(*)) OVER () + 0.5) / 1000 AS share FROM documents GROUP BY lang, source""")
def realised_histogram(spark, d):
    h = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("t")).withColumn("one", F.lit(1))
    return h.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("lang", "source", "n", (F.floor(F.col("n") * 1000 / F.col("t") + 0.5) / 1000).alias("share"))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, floor(max(value) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) * 1000 + 0.5) / 1000 AS p50, floor(max(value) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) * 1000 + 0.5) / 1000 AS p95, floor(max(value) * 1000 + 0.5) / 1000 AS top FROM n GROUP BY event_type""")
def index_percentiles(spark, d):
    return op.index_percentile(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "top": 1.0})


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def zero_yield(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    c = table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("""WITH k AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS accepted, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders GROUP BY 1)
SELECT o_custkey, accepted, rejected, floor(accepted * 1000.0 / (accepted + rejected) + 0.5) / 1000 AS rate FROM k WHERE floor(accepted * 1000.0 / (accepted + rejected) + 0.5) / 1000 < 0.9 ORDER BY rate, o_custkey LIMIT 20""")
def weak_cells(spark, d):
    """A report: the 20 weakest keys."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return op.rates(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), "o_custkey").where("rate < 0.9").orderBy("rate", "o_custkey").limit(20)


@query(R + """SELECT model, event_id, score, CAST(row_number() OVER w AS INTEGER) AS place FROM runs WHERE NOT error AND score < 80 WINDOW w AS (PARTITION BY model ORDER BY score, event_id) QUALIFY row_number() OVER w <= 4""")
def top4_failures(spark, d):
    r = runs(spark, d).where("not error and score < 80").select("model", "event_id", "score")
    return op.worst(r, "model", [F.col("score"), F.col("event_id")], 4)


@query(R + """SELECT model, scenario, event_id, score FROM runs QUALIFY row_number() OVER (PARTITION BY model, scenario ORDER BY event_id DESC) = 1""")
def last_write_wins(spark, d):
    return op.newest(runs(spark, d).select("model", "scenario", "event_id", "score"), ["model", "scenario"], ["event_id"])


@query(R + """SELECT model, count(*) AS n, count(*) FILTER (score >= 90 AND NOT error) AS strict, CAST(sum(score) FILTER (NOT error) AS DOUBLE) / nullif(count(*) FILTER (NOT error), 0) AS mean_composite,
CAST(coalesce(sum(ms) FILTER (ms > 0), 0) AS DOUBLE) / greatest(count(*) FILTER (ms > 0), 1) AS mean_ms, count(*) FILTER (error) AS errors, count(*) FILTER (score >= 80 AND score < 90 AND NOT error) AS wins,
count(*) FILTER (score >= 70) AS usable, count(*) FILTER (score >= 50 AND score < 70) AS partial, count(*) FILTER (score < 50) AS weak FROM runs GROUP BY model""")
def model_summary(spark, d):
    ok, s = ~F.col("error"), F.col("score")
    count = lambda c: F.count(F.when(c, 1))
    timed = F.col("ms") > 0
    return runs(spark, d).groupBy("model").agg(
        F.count("*").alias("n"), count(ok & (s >= 90)).alias("strict"), (F.sum(F.when(ok, s)).cast("double") / F.nullif(count(ok), F.lit(0))).alias("mean_composite"),
        (F.coalesce(F.sum(F.when(timed, F.col("ms"))), F.lit(0)).cast("double") / F.greatest(count(timed), F.lit(1))).alias("mean_ms"), count(F.col("error")).alias("errors"), count(ok & (s >= 80) & (s < 90)).alias("wins"),
        count(s >= 70).alias("usable"), count((s >= 50) & (s < 70)).alias("partial"), count(s < 50).alias("weak"))


@query(R + """SELECT scenario, count(DISTINCT model) AS models, count(*) FILTER (score >= 50 AND NOT error) AS passes, CAST(sum(CASE WHEN error THEN 0 ELSE score END) AS DOUBLE) / greatest(count(*), 1) AS mean_composite, count(*) FILTER (score >= 50 AND NOT error) < count(*) AS flagged FROM runs GROUP BY scenario""")
def cross_model(spark, d):
    good = ~F.col("error") & (F.col("score") >= 50)
    n = F.count(F.when(good, 1))
    return runs(spark, d).groupBy("scenario").agg(F.count_distinct("model").alias("models"), n.alias("passes"), (F.sum(F.when(F.col("error"), 0).otherwise(F.col("score"))).cast("double") / F.greatest(F.count("*"), F.lit(1))).alias("mean_composite"), (n < F.count("*")).alias("flagged"))


BEST = R + """, m AS (SELECT model, count(*) FILTER (score >= 60) AS strict, CAST(sum(score) AS DOUBLE) / count(*) AS composite, CAST(sum(ms) AS DOUBLE) / count(*) AS mean_ms FROM runs GROUP BY model)
SELECT (SELECT model FROM m ORDER BY strict DESC, composite DESC, model DESC LIMIT 1) AS best, (SELECT model FROM m WHERE strict >= (SELECT max(strict) FROM m) - 1 ORDER BY mean_ms, model LIMIT 1) AS fastest, (SELECT model FROM m ORDER BY strict DESC, mean_ms, model LIMIT 1) AS head_to_head"""


@query(BEST)
def best_and_fastest(spark, d):
    m = runs(spark, d).groupBy("model").agg(F.count(F.when(F.col("score") >= 60, 1)).alias("strict"), (F.sum("score").cast("double") / F.count("*")).alias("composite"), (F.sum("ms").cast("double") / F.count("*")).alias("mean_ms"))
    top = m.agg(F.max("strict").alias("top")).withColumn("one", F.lit(1))
    j = m.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    near = F.when(F.col("strict") >= F.col("top") - 1, F.struct("mean_ms", "model"))
    return j.agg(F.max_by("model", F.struct("strict", "composite", "model")).alias("best"), F.min_by("model", near).alias("fastest"), F.min_by("model", F.struct((-F.col("strict")).alias("s"), "mean_ms", "model")).alias("head_to_head"))


@query("""WITH v AS (SELECT unnest(['a', 'b']) AS variant), k AS (SELECT DISTINCT user_id AS model, event_id % 5 AS scenario FROM events WHERE event_type = 'error' AND event_id % 10 = 0),
r AS (SELECT variant, user_id AS model, event_id % 5 AS scenario, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 101 END + CASE WHEN variant = 'b' THEN 5 ELSE 0 END AS score FROM events, v)
SELECT variant, r.model, count(*) FILTER (score >= 60) AS passes, count(*) FILTER (score >= 60 AND k.model IS NOT NULL) AS fixed, count(*) AS n FROM r LEFT JOIN k ON r.model = k.model AND r.scenario = k.scenario GROUP BY variant, r.model""")
def prompt_matrix(spark, d):
    """Variants by models by scenarios; known failures are marked by a join."""
    r = runs(spark, d).withColumn("scenario", F.col("event_id") % 5)
    known = r.where("error and event_id % 10 = 0").select("model", "scenario").distinct().withColumn("known", F.lit(True))
    each = r.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("score", F.when(F.col("error"), 0).otherwise(F.col("score")) + F.when(F.col("variant") == "b", 5).otherwise(0))
    ok = F.col("score") >= 60
    return each.join(known, ["model", "scenario"], "left").groupBy("variant", "model").agg(F.count(F.when(ok, 1)).alias("passes"), F.count(F.when(ok & F.col("known"), 1)).alias("fixed"), F.count("*").alias("n"))


#: Nine yes-or-no flags of a judge, one for each remainder.
FLAGS = range(2, 11)


@query(R + f""", j AS (SELECT model, count(*) FILTER (event_type <> 'signup') AS req, count(*) FILTER (event_type IN ('view', 'click')) AS sat, count(*) FILTER (NOT error) AS ok, count(*) AS n, {" + ".join(f"CAST(count(*) % {k} = 0 AS INT)" for k in FLAGS)} AS met,
count(DISTINCT score) AS distinct_scores, max(score) - min(score) AS score_range, CAST(coalesce(sum(ms) FILTER (NOT error), 0) AS DOUBLE) / greatest(count(*) FILTER (NOT error), 1) AS mean_ms FROM runs GROUP BY model),
p AS (SELECT *, CAST(floor(sat / greatest(req, 1) * 25 + 0.5) AS BIGINT) AS rubric, CAST(floor(met / 9 * 25 + 0.5) AS BIGINT) AS step, CAST(floor(100.0 * ok / greatest(n, 10) + 0.5) AS BIGINT) AS following FROM j)
SELECT model, rubric, step, following, n % 41 + rubric + step + CAST(floor(following / 100 * 10 + 0.5) AS BIGINT) AS legacy_total, distinct_scores, score_range, mean_ms FROM p""")
def judge_rollup(spark, d):
    """Rubric over required criteria, steps over nine flags, instructions followed, and the legacy total."""
    ok, k = ~F.col("error"), F.col("event_type")
    count = lambda c: F.count(F.when(c, 1))
    j = runs(spark, d).groupBy("model").agg(
        op.rubric_score(count(k.isin("view", "click")), count(k != "signup")).alias("rubric"), op.step_score([F.count("*") % m == 0 for m in FLAGS]).alias("step"), js_round(100.0 * count(ok) / F.greatest(F.count("*"), F.lit(10))).alias("following"),
        (F.count("*") % 41).alias("det"), F.count_distinct("score").alias("distinct_scores"), (F.max("score") - F.min("score")).alias("score_range"), (F.coalesce(F.sum(F.when(ok, F.col("ms"))), F.lit(0)).cast("double") / F.greatest(count(ok), F.lit(1))).alias("mean_ms"))
    return j.withColumn("legacy_total", op.legacy_total(F.col("det"), F.col("rubric"), F.col("step"), F.col("following"))).drop("det")


@query("""SELECT doc_id, sha256(text) AS text_sha256, 'sha-' || source AS git_sha, n_chars % 2 = 1 AS dirty FROM documents""")
def provenance(spark, d):
    """Hash of a prompt with the revision it was made at; the revision is the caller's to give."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", files.provenance(F.col("text"), F.concat(F.lit("sha-"), "source"), F.col("n_chars") % 2 == 1).alias("p")).select("doc_id", "p.*")


#: Per user: the events as results, two model names for legacy runs, and what a run over them stores.
RUN_FILES = """WITH e AS (SELECT user_id AS u, event_id, event_id % 2 AS half, CAST(floor(value) AS BIGINT) % 101 AS score, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS ms, event_type FROM events),
b AS (SELECT 'm' || u AS model, 'base' AS suite, count(*) FILTER (event_type = 'view') AS passed, count(*) AS total, CAST(0 AS DOUBLE) AS ms, CAST(NULL AS DOUBLE) AS composite FROM e WHERE u % 4 = 0 GROUP BY u),
s AS (SELECT 'm' || u, 'hard', count(*) FILTER (score >= 60 OR score % 7 = 0), count(*), CAST(u AS DOUBLE), CAST(sum(score) FILTER (score % 5 <> 0) AS DOUBLE) / count(*) FILTER (score % 5 <> 0) FROM e WHERE u % 4 = 1 GROUP BY u),
g AS (SELECT 'm' || u, 'hard', count(*) FILTER (score >= 60), 25, CAST(max(ms) AS DOUBLE), CAST(max(score) AS DOUBLE) FROM e WHERE u % 4 = 2 GROUP BY u),
l AS (SELECT 'm' || u || '-' || half, 'hard', count(*) FILTER (score >= 60 OR score % 7 = 0), count(*), coalesce(CAST(sum(ms) FILTER (ms > 0) AS DOUBLE) / nullif(count(*) FILTER (ms > 0), 0), 0), CAST(sum(score) FILTER (score % 5 <> 0) AS DOUBLE) / count(*) FILTER (score % 5 <> 0) FROM e WHERE u % 4 = 3 GROUP BY u, half)
SELECT * FROM b UNION ALL SELECT * FROM s UNION ALL SELECT * FROM g UNION ALL SELECT * FROM l"""


@query(RUN_FILES)
def run_files(spark, d):
    """Run artifacts of all four shapes as JSON texts, told apart, read and reduced to the newest of each model and suite."""
    e, u = table(spark, d, "events"), F.col("u")
    score = (F.floor("value") % 101).cast("long")
    ms = F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") * 10)).cast("long")
    quality = F.struct(F.when(F.col("score") % 5 != 0, F.col("score")).alias("compositeScore"), (F.col("score") % 7 == 0).alias("strictPass"))
    e = e.select(F.col("user_id").alias("u"), "event_id", "event_type", score.alias("score"), ms.alias("ms"))
    result = F.struct(F.when(u % 4 == 3, F.concat(F.lit("m"), u, F.lit("-"), F.col("event_id") % 2)).alias("modelId"), F.col("ms"), (F.col("score") >= 60).alias("strictPass"), quality.alias("quality"))
    # a run has few results by nature
    runs_ = e.groupBy("u").agg(F.collect_list(result).alias("results"), F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), F.count(F.when(F.col("score") >= 60, 1)).alias("strict"), F.max("ms").alias("top_ms"), F.max("score").alias("top"))
    name, at = F.concat(F.lit("m"), u), F.lit("2026-01-02").alias("runAt")
    hard = F.lit("parse-hard-25").alias("kind")
    summary = F.struct(name.alias("modelId"), F.col("strict").alias("strictPass"), F.col("top_ms").alias("meanMs"), F.col("top").alias("meanComposite"))
    shapes = [F.struct(F.lit("parse-base").alias("kind"), name.alias("modelId"), at, F.col("views").alias("passCount"), F.col("n").alias("total")), F.struct(hard, name.alias("model"), at, u.alias("avgMs"), F.col("results")), F.struct(at, F.array(summary).alias("summaries"), F.col("results")), F.struct(hard, at, F.col("results"))]
    said = F.coalesce(*(F.when(u % 4 == i, F.to_json(s)) for i, s in enumerate(shapes)))
    docs = runs_.select(F.concat(F.lit("runs/"), u, F.lit(".json")).alias("path"), F.try_parse_json(said).alias("doc"))
    docs = docs.unionByName(spark.createDataFrame([("runs/broken.json", "{"), ("runs/other.json", '{"kind": "notes"}')], "path string, said string").select("path", F.try_parse_json("said").alias("doc")))
    base, rows = files.snapshots(docs)
    suite = lambda df, name: df.select("model", F.lit(name).alias("suite"), "run_at", "path", F.col("passed"), "total", "ms", "composite")
    both = suite(base, "base").unionByName(suite(rows, "hard"))
    return op.newest(both, ["model", "suite"], ["run_at", "path"]).select("model", "suite", "passed", "total", "ms", "composite")


@query(R + """SELECT scenario, model, event_id, score, score >= 60 AND NOT error AS passed FROM runs WHERE NOT (score >= 60 AND NOT error) AND model = 3""")
def viewer_failures(spark, d):
    """A viewer's failed rows of one model."""
    ok = (F.col("score") >= 60) & ~F.col("error")
    return runs(spark, d).where("model = 3").withColumn("passed", ok).where("not passed").select("scenario", "model", "event_id", "score", "passed")
