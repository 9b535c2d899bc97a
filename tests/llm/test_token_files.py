"""Token files: round trips, Elias-Fano against plain lists, and the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 1000], list(range(0, 5000, 3)), sorted(random.Random(1).randrange(10**9) for _ in range(1500))])
def test_elias_fano(values):
    ef = tf.EliasFano.encode(values)
    data = b"xx" + b"".join(ef.chunks())
    back, at = tf.EliasFano.read(memoryview(data), 2)
    assert at == len(data)
    assert back.all().tolist() == values == [back[i] for i in range(len(values))]
    with pytest.raises(IndexError):
        back[len(values)]


def test_elias_fano_is_small_and_refuses_decreasing_values():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert sum(map(len, tf.EliasFano.encode(v).chunks())) * 8 < 10_000 * (2.6 + np.log2(v[-1] / 10_000))
    with pytest.raises(ValueError):
        tf.EliasFano.encode([2, 1])


@pytest.mark.parametrize("top", [50_000, 70_000])
def test_pack_and_unpack(top):
    ids = np.array([1, 2, top, 4, 5], np.uint32)
    names, ends, back = tf.unpack(b"".join(tf.pack([None, 3, 9], np.array([2, 2, 5]), ids)))
    assert (names, ends.all().tolist(), back.tolist()) == ([None, 3, 9], [2, 2, 5], ids.tolist())
    with pytest.raises(ValueError):
        tf.unpack(b"not one of these files")


def texts():
    rng = random.Random(9)
    bits = ["the", "ß", "漢", " ", "  ", "\n", "\n ", "'s", "'", "9", "\x1c", "\x85", "<|endoftext|>", "!!", "\t", "abc"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", " ", "a\n  b", "x" * 400, "ab " * 3000]


def test_cached_words_give_the_librarys_ids():
    tok = Tokenizer.from_file(PATH)
    for limit in (0, 20, 10**6):
        cache = tf.WordCache(PATH, limit)
        got = cache.encode(texts()) + cache.encode(texts()[::-1])
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts() + texts()[::-1]]
        assert [np.frombuffer(x, cache.width).tolist() for x in got] == want


def test_write_and_read_documents(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 211, t, "s", 1) for i, t in enumerate(texts())] + [(None, "null id", "s", 2), (14, None, "s", 3), (14, "again", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(5)
    manifest = tf.write_tokens(df, str(tmp_path), PATH, shard_ids=400)
    assert len(manifest) > 8
    got = sorted(map(tuple, tf.read_tokens(spark, str(tmp_path), manifest, with_ids=True).collect()), key=lambda r: r[1])
    want, start = [], 0
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest = tf.write_tokens(df, str(tmp_path / "none"), PATH)
    assert manifest == [] and tf.read_tokens(spark, str(tmp_path / "none"), manifest).collect() == []


def test_doc_ids_as_a_sequence_and_as_they_are():
    for names in ([-5, -5, 0, 7], [None, -(2**63), 2**63 - 1], [None, None], [2**62, 2**62 + 9]):
        ends = np.arange(1, len(names) + 1)
        back, found, ids = tf.unpack(b"".join(tf.pack(names, ends, np.arange(len(names)))))
        assert back == names and [found[i] for i in range(len(names))] == ends.tolist() and ids.tolist() == list(range(len(names)))
