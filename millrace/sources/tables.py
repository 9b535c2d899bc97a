"""Input tables and the views the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deals a table that is read in very few splits to all cores; large tables have many splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 2 * splits <= cores and df.storageLevel.useMemory is False else df


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: whole rupiah, one organisation per market segment, ISO date strings."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("org_id"),
        F.when(F.col("o_orderstatus") == "F", "pemasukan").otherwise("pengeluaran").alias("type"),
        F.floor(F.col("o_totalprice") + 0.5).cast("long").alias("jumlah"),
        F.lower("o_orderpriority").alias("deskripsi"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("tanggal"),
        F.lower("c_name").alias("vendor"),
        F.when(F.col("o_custkey") % 2 == 0, "bank").otherwise("cash").alias("source"),
        (F.col("o_orderkey") % 7 == 0).alias("ambigu"),
        F.when(F.col("o_orderkey") % 97 == 0, "NO_RECEIPT").alias("catatan"),
    )


#: The same view in SQL.
LEDGER_SQL = """ledger AS (
SELECT o_orderkey AS id, c_mktsegment AS org_id, CASE WHEN o_orderstatus = 'F' THEN 'pemasukan' ELSE 'pengeluaran' END AS type,
       CAST(floor(o_totalprice + 0.5) AS BIGINT) AS jumlah, lower(o_orderpriority) AS deskripsi, strftime(o_orderdate, '%Y-%m-%d') AS tanggal,
       lower(c_name) AS vendor, CASE WHEN o_custkey % 2 = 0 THEN 'bank' ELSE 'cash' END AS source, o_orderkey % 7 = 0 AS ambigu,
       CASE WHEN o_orderkey % 97 = 0 THEN 'NO_RECEIPT' END AS catatan
FROM orders JOIN customer ON o_custkey = c_custkey)"""
