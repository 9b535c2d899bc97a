"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64-bit SimHashes of 3-word shingles.  Two fingerprints link
when 3 or fewer bits differ, so in at least one 32-bit half at most one bit
differs.  Each half is a Hamming metric space of its own: a vantage-point tree
over it, searched with radius 1, meets every link of the whole fingerprint.

The top levels of each tree deal distinct fingerprints to shards: level l
splits at distance ``CUT`` from its vantage point, and by the triangle bound
only fingerprints at distance ``CUT + 1`` can link across, so those alone go to
both sides.  Inside a shard the tree goes on with vantage points and medians
taken from the data, over the half and, where that no longer splits, over the
whole fingerprint, down to leaves compared bit by bit over all 64 bits.  A
shard returns a spanning star of each group it sees, never its pairs, and the
stars are joined by large-star and small-star rounds on distributed tables.

Exact copies are one fingerprint from the start (partial aggregation), so a
group of copies of any size is a single row in the search.

Defined cases: null text counts as text without words, whose fingerprint is
zero; very long texts count with all their words; other columns are ignored,
whatever their names; fewer words than a shingle give one shingle of all words; rows with equal
``doc_id`` each keep their row; a null ``doc_id`` keeps its row and never names
a component unless the component has no other; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, out_batch, shared_dir, text_batches

SHINGLE = 3
SEED = 42
RADIUS = 3
CUT = 16
SHARD_ROWS = 20_000
LEAF_ROWS = 256
#: Rows whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return bits_of(np.fromiter((digest(p, SEED) for p in parts), np.uint64))


def bits_of(h: np.ndarray) -> int:
    """Unsigned fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b, texts in text_batches(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield out_batch(schema, doc_id=b.column(0).cast(pa.int64()), fp=pa.array(fp))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def half_of(fp: np.ndarray, half: int) -> np.ndarray:
    return (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)


def vantage(half: int, level: int) -> np.uint64:
    """The fixed vantage point of a level of the dealing tree."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(f"{half}:{level}", SEED) & 0xFFFFFFFF)


def deal(fp: np.ndarray, half: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, shard numbers): each fingerprint's shard and those its radius reaches."""
    row, shard = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    part = half_of(fp, half)
    for level in range(depth):
        d = np.bitwise_count(part[row] ^ vantage(half, level)).astype(np.int64)
        far = d > CUT
        also = d == CUT + 1
        row, shard = np.concatenate([row, row[also]]), np.concatenate([shard + (far.astype(np.int64) << level), shard[also]])
    return row, shard


class Groups:
    """Connected groups of row numbers: smallest label wins, arrays at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        lab = self.label
        while len(i):
            a, b = lab[i], lab[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = lab[lab]
                if (up == lab).all():
                    break
                lab[:] = up


def _compare(fp: np.ndarray, idx: np.ndarray, groups: Groups, radius: int) -> None:
    step = max(1, (1 << 20) // max(1, len(idx)))
    for i in range(0, len(idx), step):
        x = idx[i : i + step]
        near = np.bitwise_count(fp[x][:, None] ^ fp[idx][None, i:]) <= radius
        p, q = np.nonzero(near)
        groups.link(x[p], idx[i + q])


def link_shard(fp: np.ndarray, half: int, radius: int = RADIUS) -> np.ndarray:
    """For each distinct fingerprint of a shard, the row number that leads its group."""
    groups, part = Groups(len(fp)), half_of(fp, half)
    # where the half no longer tells fingerprints apart, the tree goes on over all 64 bits
    todo = [(np.arange(len(fp)), part, radius // 2)]
    rng = np.random.default_rng(len(fp))
    while todo:
        idx, space, reach = todo.pop()
        if len(idx) <= LEAF_ROWS:
            _compare(fp, idx, groups, radius)
            continue
        d = np.bitwise_count(space[idx] ^ space[idx[rng.integers(len(idx))]]).astype(np.int64)
        m = int(np.median(d))
        inner, outer = idx[d <= m + reach], idx[d > m]
        if max(len(inner), len(outer)) <= 0.95 * len(idx):
            todo += [(inner, space, reach), (outer, space, reach)]
        elif space is part:
            todo.append((idx, fp, radius))
        else:  # nothing to prune here either
            _compare(fp, idx, groups, radius)
    return groups.label


def link_stars(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: stars that join every group of linked distinct fingerprints ``fp``."""
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD_ROWS)))

    def spread(batches):
        schema = pa.schema([("half", pa.int32()), ("shard", pa.int64()), ("fp", pa.int64())])
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            for half in (0, 1):
                row, shard = deal(signed.view(np.uint64), half, depth)
                yield out_batch(schema, half=np.full(len(row), half, np.int32), shard=shard, fp=signed[row])

    def link(t: pa.Table) -> pa.Table:
        signed = np.unique(t.column("fp").to_numpy())
        lead = link_shard(signed.view(np.uint64), t.column("half")[0].as_py(), radius)
        other = lead != np.arange(len(lead))
        return pa.table({"a": signed[other], "b": signed[lead[other]]})

    shards = fps.mapInArrow(spread, "half int, shard long, fp long")
    return shards.groupBy("half", "shard").applyInArrow(link, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every end of ``edges`` (a, b) that is not its group's smallest.

    Large-star then small-star until only stars are left: no node with two
    centres, no centre that is a node. That is one aggregation to see, so edges
    that are stars from the start cost nothing more. Groups are found by
    aggregation and joins only, each round written to the shared folder.
    """
    spark, written = edges.sparkSession, []
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(max_rounds):
        e = materialise(spark, e, "edges", written)
        ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        odd = e.select(ends.alias("x")).groupBy("x.v").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if odd.agg(F.count("*")).first()[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = F.struct("a", F.col("m").alias("b"))
        up = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        e = large.join(low, "a").select(F.inline(F.when(F.col("b") != F.col("m"), F.array(kept, up)).otherwise(F.array(kept)))).distinct()
    raise RuntimeError(f"groups not settled after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row of ``docs``."""
    if radius > RADIUS:
        raise ValueError("the two half-trees prove links of up to 3 bits")
    spark = docs.sparkSession
    shared_dir(spark)
    fp = materialise(spark, fingerprints(docs, shingle), "simhash")
    first = fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    root = components(link_stars(first.select("fp"), first.count(), radius))
    led = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = led.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = led.join(named, "root").select("fp", "component_id")
    return fp.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
