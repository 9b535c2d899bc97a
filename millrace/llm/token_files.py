"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents end to end, in 16 or 32 bits
each, and where every document ends as an Elias-Fano sequence: the low bits of
each end packed, the high bits as a unary-coded bit vector with a sample of
select positions.  n ends below U take about ``2 + log2(U / n)`` bits each, and
one end is read without unpacking the others; ``read_tokens`` reads them so.  The
ascending doc_ids are such a sequence too.

``write_tokens`` deals documents by ranges of ``doc_id``, sorts inside each
range and writes one or more files per range, so the files in order of name
hold all documents in ascending order.  A file has at most ``SHARD_IDS`` ids
(or one document).  A task that runs again writes other names; only the names
its successful attempt returned are in the manifest.

Defined cases: null text counts as empty (only the end id); very long texts are
encoded to their end; columns other than ``doc_id`` and ``text`` are ignored,
whatever their names; rows with equal
``doc_id`` each stay, ordered by text; rows with null ``doc_id`` come first;
an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import open_fs, out_batch, qualified, text_batches, write_file

MAGIC = b"MRTOKEF2"
SELECT_EVERY = 256
#: Documents of a file returned at once.
DOCS = 4096
SHARD_IDS = 1 << 24
CACHE_WORDS = 900_000


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.universe, self.low, self.high, self.sample = n, universe, low, high, sample
        self.bits = self.low_bits(n, universe)

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, universe = len(v), int(v[-1]) if len(v) else 0
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must not decrease")
        k = cls.low_bits(n, universe)
        low = np.packbits(((v[:, None] >> np.arange(k)) & 1).astype(np.uint8), bitorder="little")
        ones = (v >> k) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, low, np.packbits(high, bitorder="little"), ones[::SELECT_EVERY].astype(np.uint64))

    def select(self, i: int) -> int:
        """Where the i-th one stands in the high bits, from the nearest sample on."""
        at, left = int(self.sample[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        p = i * self.bits
        word = int.from_bytes(self.low[p // 8 : (p + self.bits + 7) // 8].tobytes(), "little") >> p % 8
        return (self.select(i) - i) << self.bits | word & (1 << self.bits) - 1

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.bits).reshape(self.n, self.bits).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.bits) + (low << np.arange(self.bits)).sum(1)

    @staticmethod
    def width(high_bytes: int) -> int:
        """Bytes of a sampled place: 4 unless the high bits need more."""
        return 4 if high_bytes < 1 << 29 else 8

    def chunks(self) -> list[bytes]:
        head = struct.pack("<QQQQ", self.n, self.universe, len(self.low), len(self.high))
        return [head, self.low.tobytes(), self.high.tobytes(), self.sample.astype(f"<u{self.width(len(self.high))}").tobytes()]

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, universe, a, b = struct.unpack_from("<QQQQ", data, at)
        at += 32
        s, width = -(-n // SELECT_EVERY), cls.width(b)
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, universe, low, high, np.frombuffer(data, f"<u{width}", s, at + a + b)), at + a + b + width * s


#: How a file holds its doc_ids: as they are, or as an Elias-Fano sequence from the smallest on.
PLAIN, SEQUENCE = 0, 1


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The chunks of a token file. Null doc_ids come first, then ascending ones."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    nulls = sum(d is None for d in doc_ids)
    names = [d for d in doc_ids if d is not None]
    kind = SEQUENCE if names and names[-1] - names[0] < 1 << 62 else PLAIN
    held = [struct.pack("<q", names[0]), *EliasFano.encode(np.array(names, np.int64) - names[0]).chunks()] if kind else [np.array(names, "<i8").tobytes()]
    return [MAGIC, struct.pack("<IIQQ", width, kind, len(doc_ids), nulls), *held, *EliasFano.encode(ends).chunks(), ids.astype(f"<u{width}").tobytes()]


def unpack(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """doc_ids, where each document ends, and all ids of a token file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    width, kind, n, nulls = struct.unpack_from("<IIQQ", data, 8)
    at = 8 + 24
    if kind == SEQUENCE:
        (first,) = struct.unpack_from("<q", data, at)
        held, at = EliasFano.read(memoryview(data), at + 8)
        names = (held.all() + first).tolist()
    else:
        names, at = np.frombuffer(data, "<i8", n - nulls, at).tolist(), at + 8 * (n - nulls)
    ends, at = EliasFano.read(memoryview(data), at)
    return [None] * nulls + names, ends, np.frombuffer(data, f"<u{width}", ends.universe, at)


WORD = re.compile(r"\s*\S+|\s+")
ODD = re.compile("[\x1c-\x1f]")
#: Spaces to every regular-expression library, and stretches encoded in one run.
CUT, RUN = " \n\t\r", 2048


class WordCache:
    """The library's encodings of stretches of text, by stretch.

    A text is cut where a space follows a non-space: the byte-level pattern
    always begins a match there, so the stretches' ids in order are the text's.
    A text whose only white space is single spaces and line ends inside is cut by
    them, and a stretch is known by its word alone, or by the line end and the word.
    Stretches met before are looked up; the others go to the library, many in one
    run, whose ids are dealt out again by the bytes they stand for. ``limit`` bounds the entries; what is
    met beyond it is kept for one run of texts only.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS, whole: bool = False):
        from tokenizers import Tokenizer

        self.tok, self.limit, self.whole = Tokenizer.from_file(path), limit, whole
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.width = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"

        # a byte-level token has one character for each byte it stands for
        self.bytes_of = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            self.bytes_of[i] = len(token)

    def raw(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part, each encoded on its own."""
        return [np.array(e.ids, self.width).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def together(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part, encoded in one run; each begins with a space and ends with a non-space."""
        text = "".join(parts)
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)
        through = self.bytes_of[ids].cumsum()
        sizes = map(len, parts) if text.isascii() else (len(p.encode("utf-8", "surrogatepass")) for p in parts)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(parts)))
        at = np.searchsorted(through, ends)
        if len(through) == 0 or at[-1] >= len(through) or (through[at] != ends).any():
            return self.raw(parts)  # a part's end inside a token: never where the pattern splits
        data, cuts = ids.tobytes(), [0, *((at + 1) * ids.itemsize).tolist()]
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(self, cache: dict[str, bytes], new: list[str], run, whole=lambda x: x) -> dict[str, bytes]:
        """Encode the stretches that keys stand for; into the cache while it has room."""
        out: dict[str, bytes] = {}
        for i in range(0, len(new), RUN):
            some = new[i : i + RUN]
            got = dict(zip(some, run([whole(x) for x in some])))
            out |= got
            if len(self.words) + len(self.known) < self.limit:
                cache |= got
        return out

    def looked_up(self, cache: dict[str, bytes], cut: list[list[str]], encode) -> list[bytes]:
        """Packed ids of lists of keys: one look-up a key, and the library for those not met before."""
        keys = list(chain.from_iterable(cut))
        got = list(map(cache.get, keys))
        gaps = [i for i, g in enumerate(got) if g is None]
        if gaps:
            learned = encode({keys[i] for i in gaps})
            for i in gaps:
                got[i] = learned[keys[i]]
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        return [b"".join(got[i:j]) for i, j in zip(ends, ends[1:])]

    def new_words(self, new: set[str]) -> dict[str, bytes]:
        first = {k for k in new if k[0] == FIRST}
        rest = self.learn(self.words, list(new - first), self.together, lambda k: k if k[0] == "\n" else " " + k)
        return rest | self.learn(self.words, list(first), self.raw, lambda k: k[1:])

    def new_stretches(self, new: set[str]) -> dict[str, bytes]:
        odd = {p for p in new if p[0] not in CUT or p[-1].isspace() or ODD.search(p)}
        return self.learn(self.known, list(new - odd), self.together) | self.learn(self.known, list(odd), self.raw)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if self.whole:
            return self.raw(texts)
        plain = [words_of(t) for t in texts]
        by_word = iter(self.looked_up(self.words, [k for k in plain if k is not None], self.new_words))
        others = [[t] if ODD.search(t) else WORD.findall(t) for t, k in zip(texts, plain) if k is None]
        by_stretch = iter(self.looked_up(self.known, others, self.new_stretches))
        return [next(by_stretch if k is None else by_word) for k in plain]


#: Marks the first word of a text among the keys; no such text holds the character.
FIRST = "\x1c"


def words_of(t: str) -> list[str] | None:
    """Keys of a text's stretches: words after a space, a line end with the word after it, the first word; None for other white space."""
    lines = t.replace("\n", " \n")
    if not t or t[0] in " \n" or t[-1] in " \n" or "  " in lines or "\n " in lines or not (t.isprintable() or t.replace("\n", "").isprintable()):
        return None
    keys = lines.split(" ")
    keys[0] = FIRST + keys[0]
    return keys


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCache(path)


def slices(texts: list[str], chars: int = 1 << 21):
    """Runs of texts with about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_tokens(docs: DataFrame, out_uri: str, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> list[dict]:
    """Write all documents; the manifest: file, first rows and ids of each, in order."""
    out_uri = qualified(docs.sparkSession, out_uri)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        cache = word_cache(tokenizer_path)
        end = np.array([end_id], cache.width).tobytes()
        width = len(end)
        names: list = []
        lens: list[int] = []
        body: list[bytes] = []
        size = 0

        def flush():
            nonlocal names, lens, body, size, seq
            name = f"tokens-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.bin"
            write_file(f"{out_uri}/{name}", pack(names, np.cumsum(lens), np.frombuffer(b"".join(body), cache.width)))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "docs": len(names), "ids": size}], schema=manifest)
            names, lens, body, size, seq = [], [], [], 0, seq + 1
            return row

        for b, texts in text_batches(batches):
            keys = b.column(0).to_pylist()
            for i, j in slices(texts):
                for key, ids in zip(keys[i:j], cache.encode(texts[i:j])):
                    n = len(ids) // width + 1
                    if names and size + n > shard_ids:
                        yield flush()
                    names.append(key)
                    lens.append(n)
                    body += (ids, end)
                    size += n
        if names:
            yield flush()

    manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(run, "part int, seq int, file string, docs long, ids long").collect()
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r["part"], r["seq"])):
        out.append(r.asDict() | {"start": start})
        start += r["ids"]
    fs, path = open_fs(out_uri)
    fs.create_dir(path, recursive=True)
    write_file(f"{out_uri}/manifest.json", [json.dumps(out).encode()])
    return out


def read_tokens(spark: SparkSession, out_uri: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files alone.

    ``with_ids`` adds ``ids``. One task reads one file at a time.
    """
    out_uri = qualified(spark, out_uri)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int64())))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, path = open_fs(f"{out_uri}/{r['file']}")
                with fs.open_input_stream(path) as f:
                    names, ends, ids = unpack(f.read())
                # a document's place comes from the select structure, one at a time; no table of ends is made
                for first in range(0, len(names), DOCS):
                    yield rows_of(names, ends, ids, first, r["start"])

    def rows_of(names, ends: EliasFano, ids: np.ndarray, first: int, base: int) -> pa.RecordBatch:
        some = range(first, min(first + DOCS, len(names)))
        places = np.array([ends[first - 1] if first else 0, *(ends[i] for i in some)], np.int64)
        starts, ends_ = places[:-1], places[1:]
        crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts, ends_)]
        more = {"ids": [ids[i:j].tolist() for i, j in zip(starts, ends_)]} if with_ids else {}
        return out_batch(schema, doc_id=[names[i] for i in some], start=pa.array(starts + base), n_tokens=pa.array(ends_ - starts), ids_crc32=crc, **more)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return rows.repartition(max(1, min(len(manifest), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, ddl)
