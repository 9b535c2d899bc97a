"""URL rules by a sorted sweep over reversed-host keys.

A host's labels are reversed and each is ended by a low separator, so a host
and all its subdomains are one interval of keys: those that begin with the
host's own key.  Intervals of rules are nested or apart.  URLs are sorted by
key inside their partition, rules once, and both are merged: rules whose
interval begins are pushed on a stack, those whose interval has ended are
popped, and a URL meets the active rules from the innermost out, taking the
longest path of the innermost host that fits.

No URL is shuffled.  Rules go to tasks in chunks of at most ``CHUNK_RULES``;
with more chunks the best rule so far travels with the rows, which are written
to the shared folder in between, so what a task holds is bounded for any number
of rules and hot hosts stay spread as they were read.

Defined cases: a null url or one without ``://`` has empty host and path; an
empty path fits rules with an empty path only; among rules with equal host and
path the last given wins; no fitting rule gives null and the default verdict;
repeated rows and null ``page_id`` keep their rows; urls may have any length; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts below every character of a host and ends each label of a key.
SEP = "\x00"
CHUNK_RULES = 200_000
#: Rules of the registered query: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str) -> str:
    return "".join(x + SEP for x in reversed(host.split("."))) if host else ""


def host_key(host: Column) -> Column:
    """The canonical key of a host, in Column form."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, SEP), F.lit(SEP)))


class Rules:
    """Rules sorted by the key of their host; one entry per host with its paths, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        by_key: dict[str, dict[str, tuple[str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            by_key.setdefault(key_of(host.translate(str.maketrans(UPPER, LOWER))), {})[slash + path] = (rule, verdict)
        self.entries = [(k, sorted(((len(p), p, *v) for p, v in paths.items()), key=lambda x: (-x[0], x[1]))) for k, paths in sorted(by_key.items())]


class Sweep:
    """One pass over keys in ascending order against sorted rules."""

    def __init__(self, rules: Rules):
        self.entries, self.at, self.stack = rules.entries, 0, []

    def one(self, key: str, path: str) -> tuple[int, int, str, str] | None:
        """(length of host key, of path, rule, verdict) of the rule that wins; keys must not decrease."""
        entries, stack = self.entries, self.stack
        while self.at < len(entries) and entries[self.at][0] <= key:
            entry = entries[self.at]
            while stack and not entry[0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(entry)
            self.at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        for k, paths in reversed(stack):
            for n, p, rule, verdict in paths:
                if path.startswith(p):
                    return len(k), n, rule, verdict
        return None


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", chunk_rules: int = CHUNK_RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row of ``pages``."""
    spark = pages.sparkSession
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.select("*", host_key(F.col("host")).alias("key"), F.lit(-1).alias("h"), F.lit(-1).alias("p"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    ddl = "page_id long, host string, path string, key string, h int, p int, rule string, verdict string"

    def pass_with(part):
        sent = spark.sparkContext.broadcast(Rules(part))

        def run(frames):
            sweep = Sweep(sent.value)
            for f in frames:
                got = [sweep.one(k, p) for k, p in zip(f["key"], f["path"])]
                better = [g is not None and (g[0], g[1]) >= (h, p) for g, h, p in zip(got, f["h"], f["p"])]
                for name, i in (("h", 0), ("p", 1), ("rule", 2), ("verdict", 3)):
                    f[name] = [g[i] if b else x for g, b, x in zip(got, better, f[name])]
                yield f.astype({"h": "int32", "p": "int32"})

        return run

    parts = [rules[i : i + chunk_rules] for i in range(0, len(rules), chunk_rules)] or [[]]
    for i, part in enumerate(parts):
        if i:
            shared_dir(spark)
            df = df.checkpoint()
        df = df.sortWithinPartitions("key").mapInPandas(pass_with(part), ddl)
    return df.select("page_id", "host", "path", "rule", "verdict")
