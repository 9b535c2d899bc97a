"""Ledger operators: summaries, period sums, reconciliation, duplicates, anomalies, asserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import all_keywords, any_keyword

INCOME, EXPENSE = "pemasukan", "pengeluaran"


def sum_if(cond: Column, value: Column | str = "jumlah") -> Column:
    """Sum over rows that meet a condition; 0 for none."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(cond, v)), F.lit(0).cast("long"))


def net() -> Column:
    """Income less everything else."""
    return sum_if(F.col("type") == INCOME) - sum_if(F.col("type").isNull() | (F.col("type") != INCOME))


def summary(ledger: DataFrame, org: str | None = None) -> DataFrame:
    """Totals per type (org filtered) and per type and org (never filtered), in one scan: grouping sets."""
    kept = F.lit(True) if org is None else F.col("org_id") == org
    both = ledger.withColumn("kept", kept).groupingSets([["type"], ["org_id", "type"]], "type", "org_id").agg(
        F.grouping("org_id").alias("all_orgs"), F.count(F.when(F.col("kept"), 1)).alias("kept_rows"), sum_if(F.col("kept")).alias("kept_total"), F.count("*").alias("n"), F.coalesce(F.sum("jumlah"), F.lit(0)).alias("total"))
    every = F.col("all_orgs") == 1
    return both.select(F.when(every, "*").otherwise(F.col("org_id")).alias("org_id"), "type", F.when(every, F.col("kept_rows")).otherwise(F.col("n")).alias("n_rows"), F.when(every, F.col("kept_total")).otherwise(F.col("total")).alias("total")).where("n_rows > 0")


def period_sum(ledger: DataFrame, start: str, end: str, type_: str | None = None, org: str | None = None) -> DataFrame:
    """Sum and count over inclusive ISO dates; rows without a date are outside every period."""
    day = F.coalesce("tanggal", F.lit(""))
    cond = (day >= start) & (day <= end)
    if type_:
        cond = cond & (F.col("type") == type_)
    if org:
        cond = cond & (F.col("org_id") == org)
    return ledger.where(cond).agg(F.coalesce(F.sum("jumlah"), F.lit(0)).alias("total"), F.count("*").alias("n_rows"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides by key with a status: matched, amount_diff, left_only, right_only."""
    j = left.select(key, F.col("jumlah").alias("left_jumlah")).join(right.select(key, F.col("jumlah").alias("right_jumlah")), key, "full_outer")
    status = F.when(F.col("right_jumlah").isNull(), "left_only").when(F.col("left_jumlah").isNull(), "right_only").when(F.col("left_jumlah") == F.col("right_jumlah"), "matched").otherwise("amount_diff")
    return j.withColumn("status", status)


DUPLICATE_KEY = ["org_id", "type", "jumlah", "tanggal", "deskripsi", "source"]


def deduplicate(ledger: DataFrame, key: Sequence[str] = tuple(DUPLICATE_KEY)) -> DataFrame:
    """The first row (smallest id) of each set of rows equal in the key, with the number of its copies."""
    other = [c for c in ledger.columns if c not in key]
    first = F.min_by(F.struct(*other), F.col("id")).alias("first")
    return ledger.groupBy(*key).agg(first, F.count("*").alias("copies")).select(*key, "first.*", "copies")


def anomalies(ledger: DataFrame, times: float = 3.0, large: int = 300_000) -> DataFrame:
    """Rows with a flag: spike (over so many times the mean of their org and type), no_receipt, weekend_large,
    wrong_org_maybe (the vendor has over twice as many rows in another org)."""
    mean = ledger.groupBy("org_id", "type").agg(F.sum("jumlah").alias("s"), F.count("*").alias("n"))
    here = ledger.groupBy("vendor", "org_id").agg(F.count("*").alias("here"))
    usual = here.join(here.groupBy("vendor").agg(F.max("here").alias("most")), "vendor")
    spike = F.col("jumlah") * F.col("n") > F.col("s") * F.lit(times)
    weekend = F.dayofweek(F.to_date("tanggal")).isin(1, 7) & (F.col("jumlah") >= large)
    flags = F.array_compact(F.array(F.when(spike, "spike"), F.when(F.col("catatan") == "NO_RECEIPT", "no_receipt"), F.when(weekend, "weekend_large"), F.when(F.col("here") * 2 < F.col("most"), "wrong_org_maybe")))
    j = ledger.join(mean, ["org_id", "type"]).join(usual, ["vendor", "org_id"], "left")
    return j.withColumn("flags", F.array_join(flags, ",")).where("flags <> ''").drop("s", "n", "here", "most")


def latest(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The state a change log leaves: the last change of each key unless that is a delete."""
    cols = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*cols), F.struct(*order)).alias("last")
    return changes.groupBy(key).agg(last).select(key, "last.*").where("op <> 'delete'")


def has_amount(ledger: DataFrame, type_: str, amount: int, needles: Sequence[str] = ()) -> Column:
    """An aggregate: does any row carry the amount, type and all needles?"""
    text = F.concat_ws(" ", F.coalesce("deskripsi", F.lit("")), F.coalesce("vendor", F.lit("")))
    return F.coalesce(F.max((F.col("type") == type_) & (F.col("jumlah") == amount) & all_keywords(text, needles)), F.lit(False))


def no_amount(amount: int, type_: str | None = None) -> Column:
    """An aggregate: no row carries the amount (and type)."""
    hit = F.col("jumlah") == amount
    return ~F.coalesce(F.max(hit if type_ is None else hit & (F.col("type") == type_)), F.lit(False))


def has_vendor(needle: str, amount: int | None = None) -> Column:
    """An aggregate: does any row name it in vendor or description (and carry the amount)?"""
    text = F.lower(F.concat_ws(" ", F.coalesce("vendor", F.lit("")), F.coalesce("deskripsi", F.lit(""))))
    hit = F.contains(text, F.lit(needle.lower()))
    return F.coalesce(F.max(hit if amount is None else hit & (F.col("jumlah") == amount)), F.lit(False))


def mentions(text: Column, any_of: Sequence[str]) -> Column:
    """An aggregate: does any text hold any of the phrases?"""
    return F.coalesce(F.max(any_keyword(F.coalesce(text, F.lit("")), any_of)), F.lit(False))


def _among(whole: int):
    return lambda m: m.isin(whole, 5_000)


def amounts_ok(have: Column, needed: Sequence[int]) -> Column:
    """Are all needed amounts in the array, repeats included?

    20000 and 15000 may be there as 4 and 3 rows of 5000; then only that amount and 5000 may be missing.
    """
    fives = F.size(F.filter(have, lambda x: x == 5_000))
    missing = F.array_except(F.array(*(F.lit(n).cast("long") for n in needed)), have)
    ok = F.size(missing) == 0
    for whole, n in ((20_000, 4), (15_000, 3)):
        if whole in needed:
            there = F.array_contains(have, F.lit(whole).cast("long")) | (fives >= n)
            ok = ok | (there & F.forall(missing, _among(whole)))
    return ok


def org_leaks(ledger: DataFrame, seed: DataFrame, org: str = "org_id") -> DataFrame:
    """org, rows now, rows of the seed, and whether the org gained none."""
    now, base = ledger.groupBy(org).agg(F.count("*").alias("n_rows")), seed.groupBy(org).agg(F.count("*").alias("baseline"))
    j = now.join(base, org, "left").withColumn("baseline", F.coalesce("baseline", F.lit(0)))
    return j.select(org, "n_rows", "baseline", (F.col("n_rows") <= F.col("baseline")).alias("isolated"))


def seeded(ledger: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    """The ledger and the seed rows whose key it doesn't have: insert or ignore."""
    return ledger.unionByName(seeds.join(ledger.select(key), key, "left_anti").dropDuplicates([key]).select(ledger.columns))


def assert_score(passed: Column, total: Column) -> Column:
    """40 points in proportion to asserts passed."""
    return F.floor(40 * passed / F.greatest(total, F.lit(1)) + 0.5).cast("long")


def first_before(log: DataFrame, run: str, tool: str, index: str, before: str, after: str) -> DataFrame:
    """Per run: did the first call of one tool come before the first call of the other?"""
    b, a = F.min(F.when(F.col(tool) == before, F.col(index))), F.min(F.when(F.col(tool) == after, F.col(index)))
    return log.groupBy(run).agg(F.coalesce(b < a, F.lit(False)).alias("in_order"), F.count_distinct(tool).alias("tools"), F.count("*").alias("calls"))


def import_statement(rows: DataFrame, org: str | None = None) -> DataFrame:
    """Bank lines to ledger rows: internal moves dropped, direction from arah, amounts unsigned."""
    kept = rows.where("arah <> 'internal'")
    if org:
        kept = kept.where(F.col("org_hint") == org)
    return kept.select("tanggal", F.col("keterangan").alias("deskripsi"), F.abs("jumlah").cast("long").alias("jumlah"), F.when(F.col("arah") == INCOME, INCOME).otherwise(EXPENSE).alias("type"))
