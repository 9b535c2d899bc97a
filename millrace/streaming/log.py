"""Streams: an append-only log with duplicates dropped, rejects apart, and windowed counts.

These are extras of this engine: the batch operators' append sink, dead-letter
split and per-window rollups as Structured Streaming queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, key: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key hasn't come within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; windows close behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def split_sink(stream: DataFrame, accepted: str, rejected: str, phase: Column, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append rows without a phase to one folder and all others, with it, to another.

    A batch that runs again after a failure writes the same folder of its own
    number again, so nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("phase", phase).persist()
        try:
            marked.where("phase is null").drop("phase").write.mode("overwrite").json(f"{accepted}/batch={number}")
            marked.where("phase is not null").write.mode("overwrite").json(f"{rejected}/batch={number}")
        finally:
            marked.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
