"""Toxicity by maximum-scoring segments over token log-odds.

Tokens of a word are the word itself and its prefixes of 8 to 4 letters, each
counted once a text.  For each token the log-odds of toxic against clean
labelled text is estimated with an informative Dirichlet prior (the tokens'
shares in both classes together); tokens whose log-odds and z-score are high
enough keep their log-odds.  A word scores the log-odds of its longest kept token; all other
words share one slightly negative value, so chance sequences drift down.

A linear scan finds every maximal scoring segment of a text (a stack of
candidate segments with prefix sums).  Under the clean model the score of the
best segment follows an extreme-value law: lambda solves sum p exp(lambda s) = 1
and K is fitted to clean training texts.  Segments whose expected number by
chance is below ``MAX_E`` are significant passages; a text's evidence is the
sum of its passages' normalised scores, and a logistic fit turns evidence into
a probability.

Training reads a bounded sample of labelled rows (``MAX_TRAIN`` documents, by a
hash of their id); scoring reads every text to its end.  Parameters of the fit: a
token is kept if at least ``MIN_COUNT`` toxic texts of the sample have it and its
z-score and log-odds reach ``MIN_Z`` and ``MIN_ODDS``; of those kept the model
holds the ``MAX_TOKENS`` of the highest z-scores, which bounds what is sent to
tasks; lambda is at most ``MAX_LAMBDA`` and log K at least ``MIN_LOG_K``.

Defined cases: null and empty texts have no evidence and get the probability of
that; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are
ignored, whatever their names; repeated rows give repeated scores; labelled rows that are null or whose
document is missing teach nothing; a document with several labels teaches each;
with no toxic or no clean labels every score is the share of toxic labels.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, out_batch, text_batches

MAX_TRAIN = 20_000
PREFIXES = (8, 7, 6, 5, 4)
#: The prior's weight, as a share of all words counted.
PRIOR_SHARE = 0.01
#: A larger prior for the z-score that tokens are chosen by, so that rare ones must earn it.
CHOICE_SHARE = 0.1
MIN_COUNT, MIN_Z, MIN_ODDS, MAX_TOKENS = 4, 2.5, 3.0, 50_000
#: Least log K: with few clean texts that hold any token, nothing lower can be told.
MIN_LOG_K = -1.0
#: The largest lambda: tokens of no clean text would make it endless.
MAX_LAMBDA = 4.0
MAX_E = 0.05
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tokens_of(word: str) -> list[str]:
    """The word (closed by a full stop) and its prefixes, longest first."""
    return [word + "."] + [word[:n] for n in PREFIXES if len(word) >= n]


def log_odds(y1: int, y0: int, n1: int, n0: int, share: float = PRIOR_SHARE) -> tuple[float, float]:
    """Log-odds of a token between classes with the Dirichlet prior, and its z-score."""
    prior = share * (n1 + n0)
    a = share * (y1 + y0)
    d = math.log((y1 + a) / max(n1 + prior - y1 - a, 1e-9)) - math.log((y0 + a) / max(n0 + prior - y0 - a, 1e-9))
    return d, d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def segments(scores: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) of n tokens.

    ``scores`` has the positive tokens (place, score); all others score ``other`` (< 0).
    """
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total, at = 0.0, 0
    for place, s in scores:
        total += other * (place - at)
        start, left = place, total
        total += s
        at = place + 1
        right = total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                out.append((start, at, left, right))
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(i, j, r - left) for i, j, left, r in out]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    lam: float = 1.0
    log_k: float = 0.0
    bias: float = 0.0
    weight: float = 0.0

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Significant segments (first word, end, normalised score) and the number of words."""
        words = words_of(text)
        get, hits = self.odds.get, []
        known = self.stems
        for i, w in enumerate(words):
            if w[:4] in known:
                for t in tokens_of(w):
                    s = get(t)
                    if s is not None:
                        hits.append((i, s))
                        break
        if not hits:
            return [], len(words)
        least = math.log(max(1, len(words))) + self.log_k - math.log(MAX_E)
        found = [(i, j, self.lam * s) for i, j, s in segments(hits, len(words), self.other)]
        return [(i, j, s - least) for i, j, s in found if s > least], len(words)

    @property
    def stems(self) -> set[str]:
        if "_stems" not in self.__dict__:
            self._stems = {t.rstrip(".")[:4] for t in self.odds}
        return self._stems

    def evidence(self, text: str) -> float:
        return math.log1p(sum(s for _, _, s in self.passages(text)[0]))

    def score(self, text: str) -> float:
        return sigmoid(self.bias + self.weight * self.evidence(text))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic fit on the columns of x (the first is the bias): Newton steps, halved until they help."""
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (keep * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w


def karlin(probs: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float((probs * np.exp(np.minimum(x * scores, 500))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def train_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """``text`` and ``y`` of at most so many labelled rows, by a hash of their id.

    ``train`` is a condition on ``doc_id``. The ids sent to all tasks are at most
    ``limit``. The sample is written once to the shared folder, so the steps of a
    fit don't read all documents again.
    """
    ids = labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y"))
    some = ids.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(limit)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = d.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("text", "y")
    return materialise(docs.sparkSession, found, "train")


def train(docs: DataFrame, labels: DataFrame, rule: Column, label: str = "toxic", limit: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows that meet ``rule`` (a condition on ``doc_id``)."""
    sample = train_sample(docs, labels, label, rule, limit)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(bias=math.log((share + 1e-6) / (1 - share + 1e-6)))

    def count(batches):
        from collections import Counter

        schema = pa.schema([("token", pa.string()), ("y1", pa.int64()), ("y0", pa.int64())])
        for b in batches:
            got: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = set(words_of(text))
                got[y].update({t for x in w for t in tokens_of(x)})
                got[y][""] += len(w)
            keys = list(got[0].keys() | got[1].keys())
            yield out_batch(schema, token=keys, y1=[got[1][k] for k in keys], y0=[got[0][k] for k in keys])

    counted = sample.mapInArrow(count, "token string, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    counted = counted.where(F.col("y1") >= MIN_COUNT).checkpoint()
    n1, n0 = counted.where("token = ''").select("y1", "y0").first() or (0, 0)
    # the columns' log-odds, as in log_odds()
    def odds_and_z(share: float) -> tuple[Column, Column]:
        prior, a = share * (n1 + n0), share * (F.col("y1") + F.col("y0"))
        d = F.log((F.col("y1") + a) / (n1 + prior - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + prior - F.col("y0") - a))
        return d, d / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))

    prior, d, z = PRIOR_SHARE * (n1 + n0), odds_and_z(PRIOR_SHARE)[0], odds_and_z(CHOICE_SHARE)[1]
    rows = counted.where("token <> ''").select("token", "y1", "y0", d.alias("d"), z.alias("z")).where((F.col("z") >= MIN_Z) & (F.col("d") >= MIN_ODDS)).orderBy(F.desc("z"), "token").limit(MAX_TOKENS).collect()
    model = Model({r["token"]: r["d"] for r in rows})
    whole = [r for r in rows if not any(p in model.odds for p in tokens_of(r["token"].rstrip("."))[1:] if p != r["token"])]  # each word once
    p1, p0 = (min(0.9, sum(r[y] for r in whole) / max(1, m)) for y, m in (("y1", n1), ("y0", n0)))
    model.other = min(-0.005, math.log((1 - p1) / (1 - p0)))
    probs = np.array([(r["y0"] + PRIOR_SHARE * (r["y1"] + r["y0"])) / (n0 + prior) for r in whole])
    probs = np.append(probs, max(0.1, 1 - probs.sum()))
    model.lam = min(MAX_LAMBDA, karlin(probs, np.array([r["d"] for r in whole] + [model.other])))
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def best(batches):
        schema = pa.schema([("y", pa.int32()), ("best", pa.float64())])
        for b, texts in text_batches(batches):
            raw = Model(sent.value.odds, sent.value.other, sent.value.lam, -1e9)
            top = [max((s - 1e9 - math.log(max(1, n)) + math.log(MAX_E) for _, _, s in found), default=None) for found, n in map(raw.passages, texts)]
            yield out_batch(schema, y=b.column(1).cast(pa.int32()), best=top)

    # log K: the upper quantile of clean texts' best scores against what the law says of it
    clean = [r["best"] for r in sample.mapInArrow(best, "y int, best double").where("y = 0").collect()]
    quant = 0.98
    tops = sorted(x if x is not None else -20.0 for x in clean)
    model.log_k = max(MIN_LOG_K, tops[min(len(tops) - 1, int(quant * len(tops)))] + math.log(-math.log(quant)))
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        schema = pa.schema([("y", pa.int32()), ("x", pa.float64())])
        for b, texts in text_batches(batches):
            yield out_batch(schema, y=b.column(1).cast(pa.int32()), x=[sent.value.evidence(t) for t in texts])

    xy = sample.mapInArrow(weigh, "y int, x double").collect()
    x = np.array([r["x"] for r in xy])
    model.bias, model.weight = map(float, fit_logistic(np.column_stack([np.ones(len(x)), x]), np.array([r["y"] for r in xy], float)))
    return model


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` of every document.

    ``passages`` adds ``passages`` (first word, end, normalised score of each significant segment).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    if passages:
        schema = schema.append(pa.field("passages", kind))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b, texts in text_batches(batches):
            found = [m.passages(t)[0] for t in texts]
            p = [sigmoid(m.bias + m.weight * math.log1p(sum(s for _, _, s in f))) for f in found]
            more = {"passages": [[{"start": i, "end": j, "score": s} for i, j, s in f] for f in found]} if passages else {}
            yield out_batch(schema, doc_id=b.column(0).cast(pa.int64()), score=p, predicted=[int(x >= 0.5) for x in p], **more)

    ddl = "doc_id long, score double, predicted int" + (", passages array<struct<start:long,end:long,score:double>>" if passages else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
