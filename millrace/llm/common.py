"""Helpers shared by the operators: tables, shared scratch space, file access."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of hashes that in_buckets() tells apart.
BUCKETS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a
    temporary folder made and set as the checkpoint folder; on a cluster that
    folder would be the driver's own, so a session without the setting fails.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not one_machine(sc.master):
            raise ValueError("on a cluster set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def one_machine(master: str) -> bool:
    """Do executors share the driver's disk?"""
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, what: str, written: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors.

    The path is added to ``written``, so it can be discarded once nothing reads it.
    """
    path = scratch(spark, what)
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Remove folders that materialise() wrote."""
    for uri in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    written.clear()


def spare(df: DataFrame, name: str) -> str:
    """The name, or one like it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_buckets(df: DataFrame, keys: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows of ``df`` that may have a hash of ``keys`` in ``column`` (or, not ``inside``, those that can't), found where they are read.

    What is sent to all tasks is at most ``BUCKETS`` numbers, however many keys
    there are; with very many keys all rows are let through.
    """
    def bucket(c: str):
        return F.pmod(F.col(c), F.lit(BUCKETS)).cast("int")

    some = keys.select(bucket(column).alias("_bucket")).distinct()
    return df.join(F.broadcast(some), bucket(column) == some["_bucket"], "left_semi" if inside else "left_anti")


def qualified(spark: SparkSession, uri: str) -> str:
    """The path with scheme and authority as Spark resolves it (``fs.defaultFS``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, on the driver or an executor."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write byte chunks under an attempt-unique name, then move into place; bytes written."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with fs.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    fs.move(part, path)
    return size


#: Rows that an operator holds as Python objects at once.
SLICE = 1024


def text_batches(batches, column: str = "text"):
    """(record batch, list of texts with null as '') for each slice of an Arrow batch."""
    for whole in batches:
        at = whole.schema.get_field_index(column)
        for i in range(0, whole.num_rows, SLICE):
            b = whole.slice(i, SLICE)
            yield b, ["" if t is None else t for t in b.column(at).to_pylist()]


def out_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A record batch with the schema's columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, (cols[n] for n in schema.names))], schema=schema)
