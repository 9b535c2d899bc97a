"""Exact top-k inner products from an impact-ordered index.

Components are quantised to integers, floor(256 * x).  An index shard holds up
to ``SHARD_ROWS`` vectors as posting segments: one for each dimension and impact
level (the power of two of a quantised magnitude; zeros have no posting), levels
in descending order, and after each level every row's norm over the postings
still to come.  Queries are scored a level at a time, for a block of queries at
once: a segment adds its postings to the rows that have one; a level that holds
over ``DENSE`` of all places is kept as a matrix and added by one product.  After
a level, a row's score is its sum so far plus or minus the product of the query's
norm and the row's remaining norm (Cauchy-Schwarz); a row whose upper bound is
below the k-th best lower bound is out by proof.  That check costs about as much
as ``CHECK`` postings a row, so it is made where more are left.  When few enough
rows remain possible, or no postings do, scoring stops and the possible members
are scored exactly from their vectors.

Blocks of queries meet sets of shards by a join on the set's number, so neither
side is collected or broadcast; there are at most ``SETS`` sets for each core, and
each (shard, block) pair gives at most k rows a query.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without ``vec_id``; empty vectors score 0 with all others;
shorter vectors count as padded with zeros; rows that share the query's ``vec_id``
are its own and no candidates; of equal scores the smaller ``vec_id`` ranks first;
fewer than k candidates give all; scores beyond a long are held at its ends;
repeated query rows each get their ranks; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shared_dir

SCALE = 256
SHARD_ROWS = 4096
QUERY_ROWS = 1024
#: Pairs rescored at once.
BLOCK = 1 << 16
#: Share of all places from which on a level is kept as a matrix.
DENSE = 0.25
#: Postings a row that a check of the bounds is worth.
CHECK = 64
#: Scoring stops early once this share of the rows is still possible.
FEW = 0.05
#: Sets of shards for each core.
SETS = 2


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows that take part."""
    e = F.col(column)
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & e.isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def quantised(rows: list[list[float]]) -> np.ndarray:
    """floor(256 * x), shorter rows padded with zeros; integers held as doubles."""
    d = max(map(len, rows), default=0)
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.floor(SCALE * out)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with rows."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * len(q) < 2**53:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(r, whole)))) for r in x], np.int64)


class Shard:
    """Posting segments of a set of vectors, by descending impact level.

    ``work`` counts the postings that queries were scored with.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.work = ids, x, 0
        self.peak = float(np.abs(x).max(initial=0))
        # where sums stay whole in single precision, segments are kept so
        self.kind = np.float32 if self.peak**2 * max(x.shape[1], 1) < 2**24 else np.float64
        level = np.frexp(np.abs(x))[1]  # 0 for zeros, else 1 + log2 of the magnitude
        rest = (x**2).sum(1)
        self.levels = []
        for v in np.unique(level[x != 0])[::-1]:
            here = (level == v) & (x != 0)
            n = int(here.sum())
            rest = rest - np.where(here, x**2, 0).sum(1)
            if n >= DENSE * x.size:
                data = np.where(here, x, 0).astype(self.kind)
            else:
                dim, row = np.nonzero(here.T)
                cuts = np.flatnonzero(np.r_[True, dim[1:] != dim[:-1], True])
                data = [(int(dim[i]), row[i:j], x[row[i:j], dim[i]].astype(self.kind)) for i, j in zip(cuts, cuts[1:])]
            self.levels.append((n, data, np.sqrt(np.maximum(rest, 0))))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query row, vec_id, score) of each query's k best here."""
        d = max(q.shape[1], self.x.shape[1])
        q, x = np.pad(q, ((0, 0), (0, d - q.shape[1]))), np.pad(self.x, ((0, 0), (0, d - self.x.shape[1])))
        n = len(x)
        peak = float(np.abs(q).max(initial=0)) * self.peak * max(d, 1)
        kind = self.kind if peak < 2**24 else np.float64
        whole = peak < 2 ** (24 if kind is np.float32 else 53)
        slack = 0.0 if whole else peak * 1e-9
        side = np.ascontiguousarray(q.T, kind)
        acc = np.zeros((n, len(q)), kind)
        norm, own = np.sqrt((q**2).sum(1)), self.ids[:, None] == q_ids[None, :]
        left = sum(m for m, _, _ in self.levels)
        possible = ~own
        for m, data, rest in self.levels or [(0, [], np.zeros(n))]:
            if isinstance(data, list):
                for dim, row, v in data:
                    acc[row] += v[:, None] * side[dim][None, :]
            else:
                acc += data @ side[: data.shape[1]]
            self.work += m
            left -= m
            if n <= k or 0 < left <= CHECK * n:
                continue
            reach = norm[None, :] * rest[:, None] + slack if left else slack
            low = np.where(own, -np.inf, acc - reach).T
            kth = np.partition(low, n - k, axis=1)[:, n - k]
            possible = (acc + reach >= kth[None, :]) & ~own
            if possible.sum() <= max(k * len(q), FEW * possible.size):
                break
        i, row = np.nonzero(possible.T)
        if peak < 2**53:
            score = np.concatenate([(x[row[a : a + BLOCK]] * q[i[a : a + BLOCK]]).sum(1).astype(np.int64) for a in range(0, len(i), BLOCK)] or [np.zeros(0, np.int64)])
            order = np.lexsort((self.ids[row], -score, i))
        else:
            score = np.array([int(exact(q[a], x[b : b + 1])[0]) for a, b in zip(i, row)], object)
            order = np.array(sorted(range(len(i)), key=lambda t: (i[t], -score[t], self.ids[row[t]])), np.int64)
        i, row, score = i[order], row[order], score[order]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        return list(zip(i[best].tolist(), self.ids[row[best]].tolist(), score[best].tolist()))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in blocks: ``block`` number, ``ids`` and quantised ``vectors`` as bytes of the narrowest ``kind``, ``dim``."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, vecs = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            vecs += b.column(1).to_pylist()
            while len(ids) >= size:
                yield pack(block, ids[:size], vecs[:size])
                ids, vecs, block = ids[size:], vecs[size:], block + 1
        if ids:
            yield pack(block, ids, vecs)

    def pack(block, ids, vecs):
        x = quantised(vecs)
        kind = next(k for k, most in (("<i2", 2**15), ("<i4", 2**31), ("<f8", np.inf)) if np.abs(x).max(initial=0) < most or most == np.inf)
        return pa.RecordBatch.from_pylist([{"block": block, "ids": np.array(ids, np.int64).tobytes(), "vectors": x.astype(kind).tobytes(), "dim": x.shape[1], "kind": kind}], schema=schema)

    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32()), ("kind", pa.string())])
    return rows.mapInArrow(run, "block long, ids binary, vectors binary, dim int, kind string")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best of all vectors."""
    spark = vectors.sparkSession
    shared_dir(spark)
    shards = materialise(spark, packed(usable(vectors), shard_rows), "index")
    blocks = materialise(spark, packed(usable(queries), query_rows).select(*(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "vectors", "dim", "kind"))), "queries")
    sets = max(1, min(SETS * spark.sparkContext.defaultParallelism, shards.count()))
    # the number of partitions is given, so AQE doesn't pack sets together
    here = shards.withColumn("set", F.pmod(F.col("block") + F.shiftright("block", 32), F.lit(sets)).cast("int")).repartition(4 * sets, "set")
    sent = blocks.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).repartition(4 * sets, "set")
    # sorted and merged: neither side has a bound that would allow sending it to all tasks
    pairs = sent.join(here.hint("merge"), "set")
    schema = pa.schema([("q_block", pa.int64()), ("i", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def array(data: bytes, dim: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64) if data else np.zeros((n, dim))

    def run(batches):
        built: dict[int, Shard] = {}
        for b in batches:
            for j in range(b.num_rows):
                r = {c: b.column(c)[j].as_py() for c in b.schema.names}
                if r["block"] not in built:
                    if len(built) >= 4:
                        built.clear()
                    ids = np.frombuffer(r["ids"], np.int64)
                    built[r["block"]] = Shard(ids, array(r["vectors"], r["dim"], len(ids), r["kind"]))
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                got = built[r["block"]].search(q_ids, array(r["q_vectors"], r["q_dim"], len(q_ids), r["q_kind"]), k)
                i = np.array([g[0] for g in got], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["q_block"])), pa.array(i), pa.array(q_ids[i]), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], schema=schema)

    names = ["block", "ids", "vectors", "dim", "kind"]
    best = pairs.select(*names, *(f"q_{c}" for c in names)).mapInArrow(run, "q_block long, i int, query_id long, vec_id long, score long")
    w = W.partitionBy("q_block", "i").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
