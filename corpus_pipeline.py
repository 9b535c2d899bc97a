"""A corpus pipeline over ``documents``: each stage calls one operator of millrace.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is
written as Parquet and read again for the next.  All but the last return the
columns of ``docs``.  Rows are filtered where they are read; only near-duplicates
need a join.

Defined cases: rows with a null ``doc_id`` are judged by their text like all
others; of repeated rows one stays, of different texts under one ``doc_id`` each;
null and empty texts are one near-duplicate group; very long texts are judged
whole; without labels nothing is rejected; empty tables give no rows; other columns
of ``docs`` are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, near_copies, quality, secrets, winnow
from millrace.llm.common import in_buckets, materialise, scratch, spare, table
from millrace.llm.queries import id_hash, tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_hash() % 3 != 1)
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more): that with the smallest doc_id.

    Different texts under one doc_id are judged each by its own group. A row without doc_id is kept only where its group has no named one.
    """
    found = near_copies.near_copies(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("first")
    groups = found.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1")
    groups = materialise(spark, groups.select("component", F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_h")), "near-groups")
    h, key = spare(docs, "_h"), spare(docs, "_id")
    asked = found.join(groups, "component", "left_semi").select(F.col("h").alias(h))
    kept = groups.select(F.col("kept_h").alias(h), named("kept_id").alias(key))
    alone = found.join(groups, "component", "left_anti").select(F.col("h").alias(h), named("doc_id").alias(key))
    d = docs.withColumn(h, near_copies.text_hash()).withColumn(key, named("doc_id"))
    # rows whose group has one row stay where they are read; only the others meet the rows to keep
    sure = in_buckets(d, asked, h, inside=False)
    both = kept.unionByName(in_buckets(alone, asked, h))
    rest = in_buckets(d, asked, h).join(both, [h, key], "left_semi").dropDuplicates([h, key])
    return sure.unionByName(rest).drop(h, key)


def named(column: str) -> Column:
    """An id as a key that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return winnow.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` counts the masked text."""
    return secrets.redact_in(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of every document that is left."""
    import public_tokenizers

    return byte_bpe.encode_documents(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("secrets", no_secrets), ("byte_bpe", tokens)]

#: Near-copy components, compression models and tokens have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
