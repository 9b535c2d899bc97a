"""The shared folder and paths as Spark resolves them."""

import os

import pytest
from millrace.llm import common


class Context:
    """As much of a session on a cluster as the folder is asked of."""

    def __init__(self, master, named=None):
        self.master, self.named, self.dir, self.sparkContext = master, named, None, self

    def getConf(self):
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


def test_a_cluster_needs_a_named_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Context("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Context("local-cluster[2,1,1024]"))
    assert common.shared_dir(Context("yarn", "hdfs://n/check/")) == "hdfs://n/check"
    assert os.path.isdir(common.shared_dir(Context("local[2]")))


def test_paths_without_scheme_are_resolved_as_spark_does(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    assert common.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    was = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    try:
        assert common.qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        conf.set("fs.defaultFS", was)


def test_buckets_keep_every_row_of_a_key(spark):
    df = spark.range(5000).selectExpr("id", "xxhash64(id) AS h")
    keys = df.where("id % 7 = 0").select("h")
    inside, outside = common.in_buckets(df, keys, "h"), common.in_buckets(df, keys, "h", inside=False)
    got = {r["id"] for r in inside.collect()}
    assert {i for i in range(5000) if i % 7 == 0} <= got and got.isdisjoint(r["id"] for r in outside.collect()) and inside.count() + outside.count() == 5000
