"""WARC archives: round trips at any split size, revisits, false magic."""

import gzip
import hashlib
import io
import os
import random

import pytest

from millrace.llm import warc


def rows():
    rng = random.Random(3)
    noise = "".join(chr(rng.randint(32, 1000)) for _ in range(3000))
    big = "x" * 999 + "é"
    out = [(i, f"http://a/{i}", f"<p>{i}</p>" * rng.randint(0, 300), "t") for i in range(60)]
    out += [(100 + i, "http://same", big, "t") for i in range(7)] + [(200 + i, "http://short", "y" * 999, "t") for i in range(3)]
    out += [(300, None, None, "t"), (301, "http://a\r\nb", "", "t"), (None, "http://null", "z" * 50, "t"), (400, "u", noise, "t"), (400, "u2", noise, "t"), (401, "u", "WARC/1.1\r\n\r\n" * 200, "t")]
    return out + [(402, "u", "tie" * 500, "t")] * 3


def want(rs):
    best = {}
    for i, u, h, _ in rs:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, (-1, "")), (-1 if i is None else i, u or ""))
    out, seen = [], set()
    for i, u, h, _ in rs:
        b = (h or "").encode()
        top = best.get(b)
        first = top is None or (top == (i, u or "") and b not in seen)
        if top == (i, u or ""):
            seen.add(b)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else top[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [97, 5000, 1 << 22])
def test_round_trip(spark, tmp_path, split):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string").repartition(3)
    files = warc.write_warc(df, str(tmp_path))
    assert len(files) >= 3 and all(os.path.getsize(tmp_path / f) == n for f, n in files)
    got = warc.read_warc(spark, str(tmp_path), files, split, with_html=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows())
    whole = {r[0]: r[2] for r in rows()}
    assert all(r["html"] == (whole[r["page_id"]] or "") for r in got if r["record_type"] == "response")


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_warc(df, str(tmp_path))
    assert files == [] and warc.read_warc(spark, str(tmp_path), files).collect() == []


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_false_magic_and_foreign_members():
    one = warc.record(1, "u", b"one" * 10, "d", 30, None)
    data = warc.MAGIC + b"junk" + gzip.compress(b"no archive header") + one + b"\x1f\x8b" + warc.MAGIC + warc.record(2, "v", None, "d", 9, 1)
    for step in (1, 7, 64, len(data)):
        found = [h["X-Page-Id"] for lo in range(0, len(data), step) for h, _ in warc.records_in(Bytes(data), len(data), lo, min(len(data), lo + step))]
        assert found == ["1", "2"]
    assert list(warc.records_in(Bytes(one[:-9]), len(one) - 9, 0, len(one) - 9)) == []


def test_header_of_any_length(spark, tmp_path):
    pages = spark.createDataFrame([(1, "data:," + "x" * (1 << 20), "<p>long url</p>"), (2, "u", "<p>short</p>")], "page_id long, url string, html string")
    files = warc.write_warc(pages, str(tmp_path / "w"))
    assert {r["page_id"] for r in warc.read_warc(spark, str(tmp_path / "w"), files).collect()} == {1, 2}


@pytest.mark.parametrize("sent", [0, 1, 2])
def test_more_repeated_payloads_than_are_sent_to_tasks(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", sent)
    extra = [(500 + i, f"http://b/{i}", f"{i % 9} " * 900, "t") for i in range(40)]
    df = spark.createDataFrame(rows() + extra, "page_id long, url string, html string, h string").repartition(3)
    files = warc.write_warc(df, str(tmp_path))
    got = warc.read_warc(spark, str(tmp_path), files, 5000).collect()
    assert sorted(map(tuple, got), key=str) == want(rows() + extra)


def test_damaged_records_fail_a_strict_read(spark, tmp_path):
    parts = [warc.record(i, "u", os.urandom(400), "d", 400, None) for i in range(40)]
    data = b"".join(parts)
    at = len(b"".join(parts[:20]))
    bad = data[: at + 60] + bytes([data[at + 60] ^ 255]) + data[at + 61 :]
    for step in (50, 700, 5000, len(data)):
        ranges = [(lo, min(len(data), lo + step)) for lo in range(0, len(data), step)]
        assert sum(len(list(warc.records_in(Bytes(data), len(data), *r, True))) for r in ranges) == 40
        assert sum(len(list(warc.records_in(Bytes(bad), len(bad), *r))) for r in ranges) == 39
        with pytest.raises(ValueError, match="no record at byte"):
            for r in ranges:
                list(warc.records_in(Bytes(bad), len(bad), *r, True))


def test_long_payload(spark, tmp_path):
    rng = random.Random(8)
    html = "".join(chr(rng.randint(32, 0x4FFF)) for _ in range(600_000))  # over several read buffers when compressed
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "short")], "page_id long, url string, html string")
    files = warc.write_warc(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w"), files, 100_000).collect()}
    assert (got[2]["payload_bytes"], got[2]["payload_digest"], got[1]["refers_to"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), 2)
