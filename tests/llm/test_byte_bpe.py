"""Byte-level BPE joined from halves against the library on whole texts."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(4)
    bits = ["a", "don't", "'re", " ", "  ", "\n", "\n ", "\t", "42", "é", "ß", "漢字", "!?", "'", " ", "\x1c", "<|endoftext|>", "aaaaaaa", "…", "😀"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    return out + ["", "a" * 500, " " * 300, "it's" * 60, "word " * 100, "\n\n\n x" * 40]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 40])
def test_any_leaf_size_gives_the_librarys_ids(whole, leaf):
    codec = byte_bpe.Codec(byte_bpe.encoding(PATH, P.PATTERN), leaf)
    for t in samples():
        ids = codec.encode(t)
        assert ids == whole.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_documents(spark, whole):
    rows = [(i, t, "x") for i, t in enumerate(samples())] + [(None, None, "y"), (3, samples()[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, byte_bpe.encode_documents(df, PATH, P.PATTERN, leaf=16).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = whole.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.encode_documents(df.limit(0), PATH, P.PATTERN).collect() == []
    ids = byte_bpe.encode_documents(df.where("doc_id = 5"), PATH, P.PATTERN, with_ids=True).first()["ids"]
    assert ids == whole.encode_ordinary(samples()[5])


def test_long_documents_at_the_default_leaf(spark, whole):
    rng = random.Random(7)
    bits = ["word", "don't", "42", "é", "漢字", "!?", "x" * 30, "\n", " "]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(n))) for i, n in enumerate((400, 2000, 9000, 40_000))] + [(9, "ab+/9" * 20_000)]
    assert min(len(t) for _, t in rows[1:]) > byte_bpe.LEAF_CHARS
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, with_ids=True).collect()}
    for i, t in rows:
        assert got[i]["ids"] == whole.encode_ordinary(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
