"""File formats: naive and quoted CSV, run artifacts, JSON lines with resume, ChatML, inbox listings."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import csv_cell, let

AMOUNT_HEADERS = ["jumlah", "amount", "nominal"]


def naive_cells(line: Column, n: int) -> list[Column]:
    """n trimmed cells of a line split at every comma; missing ones are empty, more are dropped."""
    cells = F.split(F.trim(line), ",", -1)
    return [F.trim(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))) for i in range(n)]


def read_naive_csv(spark: SparkSession, path: str, headers: Sequence[str]) -> DataFrame:
    """Lines without quoting rules: blank lines and each file's header dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = naive_cells(F.col("value"), len(headers))
    rows = lines.select(*(c.alias(h) for c, h in zip(cells, headers)))
    header = F.lit(True)
    for h in headers:
        header = header & (F.lower(h) == h.lower())
    return rows.where(~header)


def csv_line(cols: Sequence[str]) -> Column:
    return F.concat_ws(",", *(csv_cell(F.col(c)) for c in cols))


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV lines, the header first in every file."""
    df.select(csv_line(df.columns).alias(",".join(df.columns))).write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").csv(path, sep="\x01", quote="")


def amount_cell(cell: Column) -> Column:
    """The unsigned amount in a cell, 0 if there is none."""
    return F.coalesce(F.abs(F.regexp_replace(cell, r"[^\d.-]", "").try_cast("double")), F.lit(0.0))


def amount_column(headers: Sequence[str]) -> str | None:
    return next((h for h in headers if h.strip().lower() in AMOUNT_HEADERS), None)


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path and doc (variant) of every readable JSON file of a folder; others are skipped, a missing folder has none."""
    if not there(spark, folder):
        return spark.createDataFrame([], "path string, said string").select("path", F.try_parse_json("said").alias("doc"))
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    doc = files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    return doc.where(F.col("doc").isNotNull())


def artifact_kind(doc: Column, path: Column) -> Column:
    """base, hard or null from a run artifact's kind, path and fields."""
    get = lambda p, t="string": F.try_variant_get(doc, f"$.{p}", t)
    kind, suite = get("kind"), get("suite")
    base = (kind == "parse-base") & (suite.isNull() | (suite == "base"))
    hard = (F.coalesce(kind, F.lit("")) == "parse-hard-25") | F.contains(path, F.lit("hard-25")) | get("meanComposite").isNotNull() | get("summaries", "variant").isNotNull() | (get("strictPass").isNotNull() & get("results", "variant").isNotNull())
    return F.when(F.coalesce(base, F.lit(False)), "base").when(hard, "hard")


def base_snapshot(doc: Column) -> Column:
    get = lambda p, t: F.try_variant_get(doc, f"$.{p}", t)
    zero = lambda p, t: F.coalesce(get(p, t), F.lit(0).cast(t))
    return F.struct(get("modelId", "string").alias("model"), get("runAt", "string").alias("run_at"), zero("passCount", "bigint").alias("base_pass"), zero("total", "bigint").alias("base_total"), zero("meanMs", "double").alias("base_ms"))


def hard_snapshot(doc: Column) -> Column:
    """One model's hard run; numbers not stored are taken from its results."""
    get = lambda p, t: F.try_variant_get(doc, f"$.{p}", t)
    results = get("results", "array<variant>")
    score = lambda r: F.try_variant_get(r, "$.quality.compositeScore", "double")
    scores = F.filter(F.transform(results, score), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    strict = F.greatest(F.size(F.filter(results, passed)), F.lit(0))
    return F.struct(F.coalesce(get("modelId", "string"), get("model", "string")).alias("model"), get("runAt", "string").alias("run_at"), F.coalesce(get("strictPass", "bigint"), strict.cast("bigint")).alias("hard_strict"), F.coalesce(get("totalScenarios", "bigint"), F.nullif(F.size(results), F.lit(-1)).cast("bigint"), F.lit(25).cast("bigint")).alias("hard_total"), F.coalesce(get("meanComposite", "double"), mean).alias("composite"), get("avgMs", "double").alias("hard_ms"))


def hard_group(doc: Column) -> Column:
    """Rows of a run over several models: its summaries, 25 scenarios each, or else its results by model.

    Without summaries latency is the mean over results that took any time, the
    total their number and the composite the mean of those that have one.
    """
    get = lambda v, p, t: F.try_variant_get(v, f"$.{p}", t)
    summaries, results = get(doc, "summaries", "array<variant>"), get(doc, "results", "array<variant>")
    names = F.array_distinct(F.filter(F.transform(results, lambda r: get(r, "modelId", "string")), lambda n: F.coalesce(n, F.lit("")) != ""))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a))

    def summed(s: Column) -> Column:
        return F.struct(get(s, "modelId", "string").alias("model"), get(doc, "runAt", "string").alias("run_at"), F.coalesce(get(s, "strictPass", "bigint"), F.lit(0).cast("bigint")).alias("hard_strict"), F.lit(25).cast("bigint").alias("hard_total"), get(s, "meanComposite", "double").alias("composite"), get(s, "meanMs", "double").alias("hard_ms"))

    def grouped(name: Column) -> Column:
        def of(own: Column) -> Column:
            scores = F.filter(F.transform(own, lambda r: get(r, "quality.compositeScore", "double")), lambda x: x.isNotNull())
            times = F.filter(F.transform(own, lambda r: get(r, "ms", "double")), lambda x: x > 0)
            return F.struct(name.alias("model"), get(doc, "runAt", "string").alias("run_at"), F.size(F.filter(own, passed)).cast("bigint").alias("hard_strict"), F.size(own).cast("bigint").alias("hard_total"), mean(scores).alias("composite"), F.coalesce(mean(times), F.lit(0.0)).alias("hard_ms"))

        return let(F.filter(results, lambda r: get(r, "modelId", "string") == name), of)

    return F.when(F.size(summaries) > 0, F.transform(summaries, summed)).otherwise(F.transform(names, grouped))


def passed(result: Column) -> Column:
    """Did a stored result pass strictly, by its own flag or its quality's?"""
    flag = lambda p: F.coalesce(F.try_variant_get(result, f"$.{p}", "boolean"), F.lit(False))
    return flag("strictPass") | flag("quality.strictPass")


def snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and hard rows (path, model, run_at, passed, total, ms, composite) of run artifacts (path, doc); others give none."""
    d = docs.where(F.col("doc").isNotNull()).withColumn("kind", artifact_kind(F.col("doc"), F.col("path")))
    names = {"base_pass": "passed", "base_total": "total", "base_ms": "ms", "hard_strict": "passed", "hard_total": "total", "hard_ms": "ms"}
    base = d.where("kind = 'base'").select("path", base_snapshot(F.col("doc")).alias("s")).select("path", "s.*").withColumnsRenamed(names).withColumn("composite", F.lit(None).cast("double"))
    hard = d.where("kind = 'hard'")
    many = F.size(F.try_variant_get("doc", "$.summaries", "array<variant>")) > 0
    named = F.coalesce(F.try_variant_get("doc", "$.modelId", "string"), F.try_variant_get("doc", "$.model", "string")).isNotNull()
    group = F.coalesce(many, F.lit(False)) | ~named
    single = hard.where(~group).select("path", hard_snapshot(F.col("doc")).alias("s")).select("path", "s.*")
    several = hard.where(group).select("path", F.inline(hard_group(F.col("doc"))))
    both = single.unionByName(several).withColumnsRenamed(names).withColumn("ms", F.coalesce("ms", F.lit(0.0)))
    return (x.where("model is not null and run_at is not null") for x in (base, both))


def provenance(text: Column, git_sha: Column, dirty: Column) -> Column:
    """What a generated row came from: hash of the prompt, revision, and whether that had local changes."""
    return F.struct(F.sha2(text, 256).alias("text_sha256"), git_sha.alias("git_sha"), dirty.alias("dirty"))


def append_lines(df: DataFrame, path: str, key: str) -> None:
    """Append rows not written before: JSON lines, never truncated, resumable by key."""
    spark = df.sparkSession
    try:
        done = spark.read.json(path).select(key).distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        done = None
    (df if done is None else df.join(done, key, "left_anti")).write.mode("append").json(path)


def chatml(user: Column, label: Column, system: Column | None = None) -> Column:
    """system (if any), user and assistant messages."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    head = F.when(system.isNotNull(), one("system", system)) if system is not None else F.lit(None)
    said = [one("user", user), one("assistant", label)]
    return F.array(*said) if system is None else F.array_compact(F.array(head, *said))


#: File names of the splits that have another.
SPLIT_NAMES = {"eval_iid": "valid", "eval_compositional": "test"}


def split_name(split: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in SPLIT_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, split), split)


def write_splits(df: DataFrame, path: str, order: str) -> None:
    """One folder per split, rows in order inside each file; a large split has many files, by ranges of the order."""
    named = df.withColumn("split", split_name(F.col("split")))
    named.repartitionByRange("split", order).sortWithinPartitions("split", order).write.mode("overwrite").partitionBy("split").json(path)


def publish(spark: SparkSession, text: str, path: str) -> None:
    """Write a small text so that readers see the old file or the whole new one: a file beside it, then a rename over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(conf)
    out = fs.create(part)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(to), over)


def write_run(df: DataFrame, path: str, published: str, stamp: str, order: str, manifest: dict) -> dict[str, int]:
    """Splits as files, and the manifest (with the rows of each split) beside them, pinned by stamp and as the latest; rows of each split."""
    spark = df.sparkSession
    write_splits(df, f"{path}/rows", order)
    # a run has few splits by nature
    counts = dict.fromkeys(("train", "valid", "test"), 0) | {r["split"]: r["n"] for r in df.groupBy(split_name(F.col("split")).alias("split")).agg(F.count("*").alias("n")).collect()}
    text = json.dumps(manifest | {"rows": counts}, indent=2, sort_keys=True)
    for place in (f"{path}/manifest.json", f"{published}/{stamp}-manifest.json", f"{published}/manifest-latest.json"):
        publish(spark, text, place)
    return counts


def file_kind(path: Column) -> Column:
    """image, csv, pdf or file, by the extension."""
    p = F.lower(F.regexp_replace(path, r"[?#].*$", ""))
    return F.when(p.rlike(r"\.(png|jpe?g|webp|gif)$"), "image").when(p.endswith(".csv"), "csv").when(p.rlike(r"\.pdf(\.txt)?$"), "pdf").otherwise("file")


def present_files(spark: SparkSession, folder: str, min_bytes: int = 1) -> DataFrame:
    """path and length of a folder's files of at least so many bytes (contents are not read)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return f.where(F.col("length") >= min_bytes)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """One row per receipt of a manifest: file, vendor, total, tanggal and items."""
    m = spark.read.schema("receipts array<struct<file:string,path:string,vendor:string,total:bigint,tanggal:string,items:array<struct<name:string,jumlah:bigint>>>>").json(path, multiLine=True)
    return m.select(F.inline("receipts"))


def match_receipts(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each image with its receipt: by file name, else by a vendor named in the path (the first in order of file).

    By file name it is an equi-join; vendors are looked up only for images left over.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    i = images.withColumn("_name", name)
    r = manifest.select(F.lower("file").alias("_file"), F.lower(F.element_at(F.split("vendor", " "), 1)).alias("_vendor"), "vendor", "total")
    exact = i.join(r, i["_name"] == r["_file"])
    rest = i.join(r, i["_name"] == r["_file"], "left_anti")
    words = rest.withColumn("_word", F.explode(F.array_distinct(F.split("_name", "[^a-z0-9]+"))))
    by_vendor = words.join(r, words["_word"] == r["_vendor"]).groupBy("path").agg(F.min(F.struct("_file", "vendor", "total")).alias("r")).select("path", "r.vendor", "r.total")
    return exact.select("path", "vendor", "total").unionByName(by_vendor)


#: How far a total that was read may be from the manifest's.
DRIFT = 5_000
CONFLICT = r"(?i)conflict|selisih|85000"


def settled(path: Column, read: Column, listed: Column, conflict: Column) -> Column:
    """total and source of an image: the conflict record for a probe, the manifest's total where what was read is missing or too far from it, else what was read."""
    ok = read > 0
    far = listed.isNotNull() & (F.abs(read - listed) > DRIFT)
    total = F.when(path.rlike(CONFLICT), conflict).when(ok & ~far, read).otherwise(listed)
    source = F.when(path.rlike(CONFLICT), "conflict").when(ok & ~far, "read").when(listed.isNotNull(), "manifest").otherwise("unavailable")
    return F.struct(total.alias("total"), source.alias("source"))


def sidecar_texts(files: DataFrame, texts: DataFrame, default: str) -> DataFrame:
    """path and value of each file: the text of the file named like it with .txt added, else a given one."""
    t = texts.select(F.col("path").alias("_txt"), F.col("value"))
    return files.select("path").join(t, F.concat("path", F.lit(".txt")) == F.col("_txt"), "left").select("path", F.coalesce("value", F.lit(default)).alias("value"))


def statement_lines(texts: DataFrame) -> DataFrame:
    """path, tanggal, deskripsi and jumlah of the lines ``DD/MM description Rp n`` of statement texts."""
    line = texts.select("path", F.explode(F.split("value", "\n")).alias("line"))
    pattern = r"^\s*(\d{2}/\d{2})\s+(.*?)\s+Rp\.?\s*([\d.,]+)\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return line.where(F.col("line").rlike(pattern)).select("path", part(1).alias("tanggal"), part(2).alias("deskripsi"), F.replace(F.replace(part(3), F.lit(".")), F.lit(",")).cast("long").alias("jumlah"))
