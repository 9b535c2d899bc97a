"""Quality by compression against two dictionaries.

A zstandard dictionary is built from good and one from bad labelled texts.  A
text is cut into blocks; each block is compressed with either dictionary, and
the difference of the two compressed sizes over their sum (and a constant, so that
very short texts lean little) is the block's leaning.
A logistic fit over the text's overall leaning, the leaning of its worst tenth
of blocks and its own compressibility gives the calibrated score.

Training reads a bounded sample of labelled rows (``MAX_TRAIN`` documents by a
hash of their id).  The dictionaries are built from ``DICT_TEXTS`` of them a class
at most, half of what the sample has of the class: from a long text
``TEXT_BLOCKS`` blocks spread evenly over its whole length, from others all
blocks.  The fit takes the whole texts of the rest of the sample, and scoring
compresses every text to its end.

Defined cases: null and empty texts have leaning zero and a fixed score; very long
texts teach and are scored like all others; repeated rows give repeated scores;
labelled rows that are null or whose document is missing teach nothing; with fewer
than ``MIN_CLASS`` texts of either class every score is the share of good labels
(one half where there is no label, so that nothing is rejected unseen); an empty table gives no rows; ``keep_good`` keeps all columns, whatever their
names, ``score`` ignores all but ``doc_id`` and ``text``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, out_batch, text_batches
from .toxicity import fit_logistic, train_sample

MAX_TRAIN = 12_000
DICT_TEXTS, TEXT_BLOCKS = 768, 16
DICT_SIZE = 96 << 10
BLOCK = 1024
LEVEL = 3
MIN_CLASS = 8
#: Bytes added to both sizes, so that very short texts lean little, and a text's usual share of its size.
SHRINK, USUAL = 80, 0.45


def blocks_of(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def some_blocks(text: str) -> list[bytes]:
    """At most ``TEXT_BLOCKS`` blocks, spread over the whole text."""
    found = blocks_of(text.encode("utf-8", "surrogatepass"))
    n = len(found)
    return found if n <= TEXT_BLOCKS else [found[i * (n - 1) // (TEXT_BLOCKS - 1)] for i in range(TEXT_BLOCKS)]


class Sizer:
    """Compressed sizes under both dictionaries and none."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        def made(d):
            return zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_AUTO), write_checksum=False, write_content_size=False, write_dict_id=False) if d else None

        self.good, self.bad = made(good), made(bad)
        self.plain = zs.ZstdCompressor(level=1, write_checksum=False, write_content_size=False)

    def features(self, text: str) -> list[float]:
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return [0.0, 0.0, USUAL]
        g, b = self.good.compress, self.bad.compress
        pairs = [(len(g(x)), len(b(x))) for x in blocks_of(data)]
        lean = sorted((y - x) / (x + y + SHRINK) for x, y in pairs)
        low = lean[: max(1, len(lean) // 10)]
        x, y = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
        return [10 * (y - x) / (x + y + SHRINK), 10 * sum(low) / len(low), (len(self.plain.compress(data)) + 32 * USUAL) / (len(data) + 32)]


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0,) * 6

    def scorer(self):
        """A function from texts to scores."""
        if not self.good:
            p = 1 / (1 + math.exp(-self.weights[0]))
            return lambda texts: [p] * len(texts)
        sizer, w = Sizer(self.good, self.bad), np.array(self.weights)

        def run(texts):
            x = design(np.array([sizer.features(t) for t in texts]).reshape(len(texts), 3))
            return (1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))).tolist()

        return run


def design(x: np.ndarray) -> np.ndarray:
    """Bias, leanings, compressibility and its hinges below ordinary text."""
    return np.column_stack([np.ones(len(x)), x, np.maximum(0, 0.3 - x[:, 2]), np.maximum(0, 0.2 - x[:, 2])])


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of blocks of text."""
    import zstandard as zs

    room = min(DICT_SIZE, max(1024, sum(map(len, samples)) // 8))
    try:
        return zs.train_dictionary(room, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICT_SIZE:] or b" "


def train(docs: DataFrame, labels: DataFrame, rule: Column, label: str = "quality", limit: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows that meet ``rule`` (a condition on ``doc_id``)."""
    sample = train_sample(docs, labels, label, rule, limit)
    spark = docs.sparkSession
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < MIN_CLASS:
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Model(weights=(math.log((share + 1e-6) / (1 - share + 1e-6)),))

    def cut(batches):
        schema = pa.schema([("h", pa.decimal128(20)), ("blocks", pa.list_(pa.binary()))])
        for _, ts in text_batches(batches):
            for t in ts:
                yield pa.RecordBatch.from_pylist([{"h": Decimal(hash_of(t)), "blocks": some_blocks(t)}], schema=schema)

    # half of the texts at most make the dictionaries, bounded in number and blocks; all others of the sample, which these don't know, the fit
    built = {}
    for y in (0, 1):
        texts = sample.where(F.col("y") == y).orderBy(F.xxhash64("text")).limit(max(MIN_CLASS // 2, min(DICT_TEXTS, n[y] // 2))).select("text")
        built[y] = texts.mapInArrow(cut, "h decimal(20,0), blocks array<binary>").collect()
    model = Model(*(dictionary([bytes(x) for r in built[y] for x in r["blocks"]]) for y in (1, 0)))
    used = spark.sparkContext.broadcast({int(r["h"]) for rows in built.values() for r in rows})
    sent = spark.sparkContext.broadcast(model)

    def weigh(batches):
        schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        sizer = Sizer(sent.value.good, sent.value.bad)
        for b, ts in text_batches(batches):
            ys = b.column(1).to_pylist()
            keep = [i for i, t in enumerate(ts) if hash_of(t) not in used.value]
            yield out_batch(schema, y=[ys[i] for i in keep], x=[sizer.features(ts[i]) for i in keep])

    xy = sample.mapInArrow(weigh, "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in xy]).reshape(len(xy), 3), np.array([r["y"] for r in xy], float)
    if len(xy) and 0 < y.sum() < len(y):
        model.weights = tuple(fit_logistic(design(x), y).tolist())
    return model


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = sent.value.scorer()
        for b, texts in text_batches(batches):
            p = scorer(texts) if texts else []
            yield out_batch(schema, doc_id=b.column(0).cast(pa.int64()), score=p, predicted=[int(v >= 0.5) for v in p])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores 0.5 or more; no row leaves its task."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scorer = sent.value.scorer()
        for b in (w.slice(i, SLICE) for w in batches for i in range(0, w.num_rows, SLICE)):
            p = scorer(["" if t is None else t for t in b.column(at).to_pylist()]) if b.num_rows else []
            yield b.filter(pa.array([v >= 0.5 for v in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
