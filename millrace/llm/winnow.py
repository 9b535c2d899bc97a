"""Benchmark decontamination by winnowing.

Words of documents and items are numbered by the benchmark's own vocabulary
(0: no such word).  Every k-gram of numbers is hashed, the smallest hash of
each window of ``window - k + 1`` k-grams is kept, and a document's kept hashes
are looked up among the items'.  Equal runs of ``window`` words keep equal
hashes, so no shared span of that length is missed.  A hit is extended word by
word to the longest shared run, which decides exactly.  Items shorter than a
window are looked up whole, by the same step with k-grams of their own length.

The benchmark is taken in chunks of at most ``CHUNK_WORDS`` words (or one longer
item), so what tasks are sent is bounded; with more than one chunk, the marks gathered so far
travel with the documents and are written to the shared folder in between.

Defined cases: null text has no words; very long texts are searched to their end;
an item without words never occurs; an empty table of documents gives no rows;
``decontaminate`` ignores columns but ``doc_id`` and ``text``, ``keep_clean`` keeps
all, whatever their names;
rows with equal ``doc_id`` or ``item_id`` each count (equal item_ids are listed
once per row); a null ``item_id`` is written as an empty string; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE, out_batch, shared_dir

WINDOW = 10
K = 5
CHUNK_WORDS = 2_000_000
#: Pairs of places for each word of an item from which on they are compared all at once.
DENSE = 8
#: ASCII letters lower-cased; every other ASCII byte that is not a digit separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the smallest (the last of equals) of some w in a row."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < w:
        w = n
    low = h[: n - w + 1].copy()
    at = np.arange(n - w + 1)
    for i in range(1, w):
        x = h[i : i + n - w + 1]
        less = x <= low
        low = np.where(less, x, low)
        at = np.where(less, np.arange(i, i + n - w + 1), at)
    return np.unique(at)


class Index:
    """Kept hashes of a chunk of items, and the items' words by number."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, min(k, window)
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for row, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            slot = len(self.items)
            self.items.append((row, ids))
            span = self.span(len(ids))
            h = gram_hashes(np.array(ids, np.uint64), span[0])
            for p in winnow(h, span[1]):
                entries.setdefault(span, []).append((int(h[p]), slot, int(p)))
        self.tables = {}
        for span, rows in entries.items():
            at: dict[int, dict[int, list[int]]] = {}
            for key, slot, p in rows:
                at.setdefault(key, {}).setdefault(slot, []).append(p)
            self.tables[span] = (np.array(sorted(at), np.uint64), at)

    def span(self, n: int) -> tuple[int, int, int]:
        """(gram length, grams a window, words a window) for an item of n words."""
        if n >= self.window:
            return self.k, self.window - self.k + 1, self.window
        return n, 1, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches [i, j) of a document's words inside occurring windows, and the rows of those items."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, len(words))
        spans: set[tuple[int, int]] = set()
        found: set[int] = set()
        if not ids.any():
            return [], found
        seq = None
        for (k, w, least), (keys, at) in self.tables.items():
            h = gram_hashes(ids, k)
            if len(h) < w:
                continue
            live = winnow(h, w)
            live = live[ids[live] != 0]
            near = np.searchsorted(keys, h[live])
            live = live[keys[np.minimum(near, len(keys) - 1)] == h[live]]
            if not len(live):
                continue
            seq = seq if seq is not None else ids.tolist()
            met: dict[int, list[tuple[int, list[int]]]] = {}
            for p in live.tolist():
                for slot, places in at[int(h[p])].items():
                    met.setdefault(slot, []).append((p, places))
            for slot, pairs in met.items():
                row, item = self.items[slot]
                if sum(len(places) for _, places in pairs) <= DENSE * len(item):
                    got = extended(seq, item, pairs, least)
                else:  # repeated words: all places against all at once
                    got = runs_of(ids, item, least)
                if got:
                    spans.update(got)
                    found.add(row)
        return sorted(spans), found


def extended(seq: list[int], item: list[int], pairs: list[tuple[int, list[int]]], least: int) -> set[tuple[int, int]]:
    """Stretches of ``seq`` equal to ``item`` around pairs of places, of at least so many words; one try a diagonal and stretch."""
    out: set[tuple[int, int]] = set()
    done: dict[int, int] = {}
    for p, places in pairs:
        for q in places:
            if p < done.get(p - q, -1):
                continue
            i, j = p, p
            while j < len(seq) and q + j - p < len(item) and seq[j] == item[q + j - p]:
                j += 1
            while i > 0 and q + i - p > 0 and seq[i - 1] == item[q + i - p - 1]:
                i -= 1
            done[p - q] = max(j, p + 1)
            if j - i >= least:
                out.add((i, j))
    return out


def runs_of(ids: np.ndarray, item: list[int], least: int) -> set[tuple[int, int]]:
    """The same stretches, from the lengths of equal runs that end at each pair of places: one pass over the item, arrays at a time."""
    run, reach = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids), np.int64)
    for word in item:
        run[1:] = np.where(ids == word, run[:-1] + 1, 0)
        np.maximum(reach, np.where(run[1:] >= least, run[1:], 0), out=reach)
    ends = np.flatnonzero(reach)
    if not len(ends):
        return set()
    # the stretches as their union: that is what counts
    starts = ends - reach[ends] + 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends + 1, -1)
    inside = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0]
    turn = np.flatnonzero(np.diff(inside))
    return set(zip(turn[::2].tolist(), turn[1::2].tolist()))


#: Indexes of this worker by the chunk they were built from: a chunk is indexed once a worker, not once a task.
_BUILT: dict[str, Index] = {}


def indexed(key: str, items: list[tuple[int, list[bytes]]], window: int, k: int) -> Index:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(items, window, k)
    return _BUILT[key]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the stretches."""
    total = end = 0
    for i, j in sorted(spans):
        total += max(0, j - max(i, end))
        end = max(end, j)
    return total


def chunks(benchmark: DataFrame, chunk_words: int):
    """Lists of (item_id, words) with at most so many words, read one after another."""
    part, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if part and n + len(words) > chunk_words:
            yield part
            part, n = [], 0
        part.append((r["item_id"], words))
        n += len(words)
    if part:
        yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, chunk_words: int = CHUNK_WORDS, spans: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` of every document.

    ``spans`` adds ``spans``, the stretches of words hit (array of start, end).
    """
    spark = docs.sparkSession
    state = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("at", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    final = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    if spans:
        final = final.append(pa.field("spans", pa.list_(pa.int64())))

    def search(items, last: bool):
        sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches):
            names = [("" if name is None else str(name)) for name, _ in sent.value]
            index = indexed(key, [(i, words) for i, (_, words) in enumerate(sent.value)], window, k)
            for b in (w.slice(i, SLICE) for w in batches for i in range(0, w.num_rows, SLICE)):
                cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                before = zip(cols["at"], cols["items"]) if "at" in cols else repeat(((), ()))
                out = {n: [] for n in (final if last else state).names}
                for doc_id, text, (at, had) in zip(cols["doc_id"], cols["text"], before):
                    words = words_of(text)
                    got, rows = index.hits(words)
                    got = [(at[i], at[i + 1]) for i in range(0, len(at), 2)] + got
                    had = [*had, *(names[r] for r in rows)]
                    row = {"doc_id": doc_id, "text": text, "at": [x for s in got for x in s], "items": had}
                    if last:
                        hit = covered(got)
                        row = {"doc_id": doc_id, "n_words": len(words), "n_hit": hit, "n_items": len(had), "items_sha256": hashlib.sha256(",".join(sorted(had)).encode()).hexdigest(), "contaminated": hit > 0, "spans": row["at"]}
                    for n, x in out.items():
                        x.append(row[n])
                yield out_batch(final if last else state, **out)

        return run

    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + (", spans array<long>" if spans else "")
    df = docs.select("doc_id", "text")
    parts = chunks(benchmark, chunk_words)
    items, later = next(parts, []), next(parts, None)
    while later is not None:
        shared_dir(spark)
        df = df.mapInArrow(search(items, False), "doc_id long, text string, at array<long>, items array<string>").checkpoint()
        items, later = later, next(parts, None)
    return df.mapInArrow(search(items, True), ddl)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows of ``docs``, all columns, without any window of the benchmark; no row leaves its task.

    With more than one chunk, rows clean so far are written to the shared folder
    between chunks.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")

    def without(items):
        sent, key = spark.sparkContext.broadcast([words for _, words in items]), uuid.uuid4().hex

        def run(batches):
            index = indexed(key, list(enumerate(sent.value)), window, k)
            for b in (w.slice(i, SLICE) for w in batches for i in range(0, w.num_rows, SLICE)):
                yield b.filter(pa.array([not index.hits(words_of(t))[1] for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    df = docs
    for n, items in enumerate(chunks(benchmark, chunk_words)):
        if n:
            shared_dir(spark)
            df = df.checkpoint()
        df = df.mapInArrow(without(items), docs.schema)
    return df
