"""Leaderboards and manifests: newest per key, outer merges, ranks, rates and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import js_round


def newest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order columns: an aggregation, so partial before the shuffle."""
    cols = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*key, "r.*")


def merge_boards(base: DataFrame, hard: DataFrame) -> DataFrame:
    """One row per model of either board, ranked: strict, composite, base passes down, latency up.

    base: model, base_pass, base_ms; hard: model, hard_strict, composite, hard_ms.
    The rank is over models, few by nature; models equal in everything rank by name.
    """
    m = base.join(hard, "model", "full_outer").withColumn("composite", F.floor(F.col("composite") * 10 + 0.5) / 10)
    down = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).desc()
    w = W.orderBy(down("hard_strict"), down("composite"), down("base_pass"), F.coalesce("hard_ms", "base_ms", F.lit(float("inf"))), "model")
    return m.withColumn("rank", F.row_number().over(w))


def public_score(det: Column, following: Column) -> Column:
    """100 (det / 40)^2 (following / 100), one decimal."""
    return F.floor(F.lit(1000.0) * (det / 40) * (det / 40) * (following / 100) + 0.5) / 10


def legacy_total(det: Column, rubric: Column, step: Column, following: Column) -> Column:
    """Points out of 100: 40 of asserts, 25 of the rubric, 25 of steps, 10 of instructions followed."""
    return det + rubric + step + js_round(following / 100 * 10)


def rubric_score(satisfied: Column, required: Column) -> Column:
    """25 points in proportion to the required criteria that are met."""
    return js_round(satisfied / F.greatest(required, F.lit(1)) * 25)


def step_score(flags: Sequence[Column]) -> Column:
    """25 points times the mean of yes-or-no flags; 0 without a verdict."""
    met = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return F.coalesce(js_round(met / len(flags) * 25), F.lit(0).cast("long"))


RANGES = 1024


def index_percentile(df: DataFrame, key: str, value: str, shares: dict[str, float], scale: int = 1000) -> DataFrame:
    """The value at place floor(n p) (from 0) of each key's sorted values, and the largest for p = 1.

    A histogram of equal ranges between a key's least and greatest value finds
    the range that holds each place; only values of those ranges are put in
    order, equal ones as one row, so a key with most of the rows stays spread.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).cast("double").alias("v"))
    ends = d.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("v") - F.col("lo")) / width * RANGES))).otherwise(0).cast("int")
    placed = d.join(ends, key).withColumn("r", at)
    hist = placed.groupBy(key, "r", "n").agg(F.count("*").alias("c"))
    w = W.partitionBy(key).orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    names = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in shares.items()))
    wanted = hist.select(key, "r", "n", "c", "before", F.inline(names)).withColumn("place", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1))
    wanted = wanted.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c"))).select(key, "r", "name", (F.col("place") - F.col("before")).alias("place"))
    values = placed.join(wanted.select(key, "r").distinct(), [key, "r"], "left_semi").groupBy(key, "r", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(key, "r").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    values = values.withColumn("upto", upto)
    hit = values.join(wanted, [key, "r"]).where((F.col("place") >= F.col("upto") - F.col("c")) & (F.col("place") < F.col("upto")))
    picks = [(F.floor(F.max(F.when(F.col("name") == k, F.col("v"))) * scale + 0.5) / scale).alias(k) for k in shares]
    return hit.groupBy(key).agg(*picks)


def rates(accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Accepted and rejected rows per key and the share accepted, three decimals."""
    a, r = accepted.groupBy(key).agg(F.count("*").alias("accepted")), rejected.groupBy(key).agg(F.count("*").alias("rejected"))
    both = a.join(r, key, "full_outer").select(key, F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return both.withColumn("rate", F.floor(F.col("accepted") * 1000 / (F.col("accepted") + F.col("rejected")) + 0.5) / 1000)


def worst(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key (a window limit is pushed below the shuffle)."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)
