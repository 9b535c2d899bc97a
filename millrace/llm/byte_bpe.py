"""Byte-level BPE by monoid tree reduction.

A text is cut into halves until the pieces are short; every leaf is encoded on
its own.  Two neighbours are joined by encoding a window around the cut again.
The window grows, on either side, until it ends where a match of the split
pattern provably begins whatever stands around it: no alternative of the
pattern runs from a non-space character into a space, so every place where a
space follows a non-space is such a place.  Tokens outside the window are then
those of the whole text, and the join is associative.  Decoding concatenates
the byte strings of token runs up the same kind of tree.

Defined cases: null text counts as empty (no tokens, hashes of the empty
string); very long texts are encoded to their end, a leaf at a time; an empty table
gives no rows; repeated rows give repeated results; rows keep a null ``doc_id``;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import out_batch, text_batches

LEAF_CHARS = 2048
LEAF_TOKENS = 1 << 10
#: Spaces to cut before: white space to every regular-expression library.
CUT = " \n\t\r"

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def _firm(s: str, p: int) -> bool:
    """Does a match certainly begin at p, for any text around it?"""
    return 0 < p < len(s) and s[p] in CUT and not s[p - 1].isspace() and not "\x1c" <= s[p - 1] <= "\x1f"


def _window(s: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
    """The smallest stretch around mid that ends at firm places or at lo and hi."""
    a = b = mid
    while a > lo and not _firm(s, a):
        a -= 1
    while b < hi and not _firm(s, b):
        b += 1
    return a, b


class Codec:
    """Encode and decode with one rank table; ``leaf`` is the longest text encoded at once."""

    def __init__(self, enc, leaf: int = LEAF_CHARS):
        self.enc, self.leaf = enc, max(1, leaf)

    def encode(self, s: str) -> list[int]:
        return self._span(s, 0, len(s))

    def _span(self, s: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.enc.encode_ordinary(s[lo:hi])
        mid = (lo + hi) // 2
        return self.join(s, lo, mid, hi, self._span(s, lo, mid), self._span(s, mid, hi))

    def join(self, s: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of s[lo:hi] from those of s[lo:mid] and s[mid:hi]."""
        a, b = _window(s, lo, mid, hi)
        if a == b:
            return left + right
        gone_left = len(self.enc.encode_ordinary(s[a:mid]))
        gone_right = len(self.enc.encode_ordinary(s[mid:b]))
        return left[: len(left) - gone_left] + self.enc.encode_ordinary(s[a:b]) + right[gone_right:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.enc.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS, with_ids: bool = False) -> DataFrame:
    """Token count, hash of the ids and hash of the decoded bytes of every document.

    ``with_ids`` adds ``ids`` (array of int), the tokens themselves.  One narrow
    stage: a document never leaves its task, whatever its length.
    """
    schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else SCHEMA

    def run(batches):
        codec = Codec(encoding(ranks_path, pattern), leaf)
        names = decimals(codec.enc.n_vocab)
        for b, texts in text_batches(batches):
            n, sha, back, all_ids = [], [], [], []
            for t in texts:
                ids = codec.encode(t)
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            more = {"ids": all_ids} if with_ids else {}
            yield out_batch(schema, doc_id=b.column(0).cast(pa.int64()), n_tokens=n, ids_sha256=sha, decoded_sha256=back, **more)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
