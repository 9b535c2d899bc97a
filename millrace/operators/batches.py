"""Batches of requests: reconciling answers by id, chunking plans, salvaging, classing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reconcile_ids(expected: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every expected id with ok, batch:duplicate (both copies fail) or batch:missing; unknown ids drop out."""
    n = answers.groupBy(key).agg(F.count("*").alias("answers"))
    j = expected.select(key).join(n, key, "left").withColumn("answers", F.coalesce("answers", F.lit(0)))
    return j.withColumn("phase", F.when(F.col("answers") == 0, "batch:missing").when(F.col("answers") > 1, "batch:duplicate").otherwise("ok"))


def chunk_plan(plan: DataFrame, within: str, order: str, size: int) -> DataFrame:
    """Fixed-size chunks of each group's rows in order: chunk number and place in it."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    rn = F.row_number().over(W.partitionBy(within).orderBy(order)) - 1
    return plan.withColumn("chunk", F.floor(rn / size).cast("long")).withColumn("place", (rn % size).cast("long"))


def claim(plan: DataFrame, done: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """The next rows in order that aren't done, as many as there is room for."""
    return plan.join(done.select(key).distinct(), key, "left_anti").orderBy(order).limit(max(0, capacity))


def room(count: int, accepted: int, in_flight: int, batch: int, aborted: bool = False) -> tuple[str, int]:
    """What a scheduler does next: done, wait, or a batch of so many rows."""
    if batch <= 0:
        raise ValueError("batch size must be positive")
    left = count - accepted - in_flight
    if aborted or accepted >= count:
        return "done", 0
    if left <= 0:
        return ("wait" if in_flight > 0 else "done"), 0
    return "batch", min(batch, left)


def error_class(message: Column, phase: Column) -> Column:
    """reject for a validator's verdict, fatal for errors every row would meet, else retry."""
    return F.when(phase.isNotNull(), "reject").when(message.rlike(r"HTTP (400|401|403|404)(?![A-Za-z0-9_])") | message.rlike(r"(?i)model.*not (found|loaded)"), "fatal").otherwise("retry")


def reject_phase(phase: Column, leaked: Column) -> Column:
    return F.coalesce(phase, F.when(leaked, "text:leak"), F.lit("transport"))
