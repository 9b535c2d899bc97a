"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own, so a reader may begin anywhere: a
task gets a byte range, looks for the gzip magic in it, and takes a place for
the start of a record only if decoding there gives a WARC header.  It owns the
records that start inside its range and reads on past the range's end to finish
the last one.  Members inside which a false magic stands are skipped over as a
whole, and a false magic in front of the first own record fails the header.

Writing: pages with equal payloads (by SHA-1 and length) of at least
``min_bytes`` become one response, the one with the largest ``page_id``, and
revisits that carry the digest and the length but no payload.

Reading what was written here is strict: a record must start where the one before
it ends, and the task that reads the last record of its range tries the next one
too, so a damaged or lost record fails the job instead of vanishing.  Archives
from elsewhere may be read without that (``strict=False``): what can't be decoded
as a record is then skipped.

Defined cases: null html counts as an empty payload; payloads, urls and headers may
have any length; other columns of ``pages`` are ignored, whatever their names; a
null url is written as an empty target; equal ``page_id`` rows each get a record (among equal payloads
the record with the largest ``page_id``, then the largest url, is the response; of
rows equal in both too, one); a null ``page_id`` gets a record, ordered
below all others; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_buckets, open_fs, out_batch, qualified, shared_dir

MIN_BYTES = 1000
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18
BROADCAST_GROUPS = 100_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Decoded bytes that must show the header's first line.
PROBE = 512


def record(page_id: int | None, url: str, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"X-Page-Id: {name}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    body = payload or b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Every page with ``payload_bytes``, ``digest``, ``revisit`` and, for a revisit, ``best_id``.

    Groups of equal payloads are found on digests alone, and html stays where it
    is read: the largest groups, at most ``BROADCAST_GROUPS``, are sent to all
    tasks. If there are more, rows whose digest falls in a bucket of a group left
    over are joined with those by a shuffle (hot digests are among the largest).
    """
    spark = pages.sparkSession
    shared_dir(spark)
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("digest"))
    same = ["digest", "payload_bytes"]
    rows = p.where(F.col("payload_bytes") >= min_bytes).groupBy(*same, "page_id", "url").agg(F.count("*").alias("n"))
    best = rows.groupBy(*same).agg(F.max(F.struct("page_id", "url", "n")).alias("best"), F.sum("n").alias("n")).where("n > 1")
    best = best.select(*same, F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"), (F.col("best.n") > 1).alias("tied"), F.xxhash64("digest").alias("h"), "n").checkpoint()
    most = best.orderBy(F.desc("n"), "digest").limit(BROADCAST_GROUPS)
    added = [F.col(c) for c in ("best_id", "best_url", "tied")]
    j = p.join(F.broadcast(most.select(*same, *added)), same, "left")
    if best.count() > BROADCAST_GROUPS:
        others = best.join(most.select("digest", "payload_bytes"), same, "left_anti")
        open_ = j.where("best_url is null").select(*p.columns, F.xxhash64("digest").alias("h"))
        none = [F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("best_id", "best_url", "tied")]
        sure = in_buckets(open_, others, "h", inside=False).select(*p.columns, *none)
        rest = in_buckets(open_, others, "h").join(others.select(*same, *added).hint("merge"), same, "left").select(*p.columns, *added)
        j = j.where("best_url is not null").select(*p.columns, *added).unionByName(sure).unionByName(rest)
    first = F.col("best_id").eqNullSafe(F.col("page_id")) & (F.col("best_url") == F.col("url"))
    j = j.withColumn("revisit", F.col("best_url").isNotNull() & ~first).withColumn("tied", F.coalesce(F.col("tied") & first, F.lit(False)))
    if best.where("tied").limit(1).count() == 0:
        return j.drop("best_url", "tied")
    # of rows equal in page, url and payload one is the response; only such rows are numbered
    w = W.partitionBy(*same, "page_id", "url").orderBy(F.lit(1))
    tied = j.where("tied").withColumn("revisit", F.row_number().over(w) > 1)
    return j.where("not tied").unionByName(tied).drop("best_url", "tied")


def write_warc(pages: DataFrame, out_uri: str, min_bytes: int = MIN_BYTES) -> list[tuple[str, int]]:
    """Write the archives; (file, bytes) of each."""
    out_uri = qualified(pages.sparkSession, out_uri)
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64())])

    def run(batches):
        fs, base = open_fs(out_uri)
        out, size = None, 0
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.part")
                payload = None if r["revisit"] else r["html"].encode("utf-8", "surrogatepass")
                url = " ".join((r["url"] or "").splitlines())
                size += out.write(data := record(r["page_id"], url, payload, r["digest"], r["payload_bytes"], r["best_id"])) or len(data)
        if out is not None:
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            yield out_batch(schema, file=[name], bytes=[size])

    sent = plan_records(pages, min_bytes).select("page_id", "url", F.expr("if(revisit, '', html)").alias("html"), "payload_bytes", "digest", "best_id", "revisit")
    return sorted((r["file"], r["bytes"]) for r in sent.mapInArrow(run, "file string, bytes long").collect())


class Tail:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, f, start: int, size: int):
        self.f, self.at, self.size, self.buf = f, start, size, bytearray()

    def need(self, place: int) -> bool:
        """Have the bytes up to place; False at the file's end."""
        while self.at + len(self.buf) <= place:
            got = self.f.read_at(min(READ_BYTES, self.size - self.at - len(self.buf)), self.at + len(self.buf)) if self.at + len(self.buf) < self.size else b""
            if not got:
                return False
            self.buf += got
        return True

    def drop(self, place: int) -> None:
        if place > self.at:
            gone = min(place - self.at, len(self.buf))
            del self.buf[:gone]
            self.at += gone


def member(tail: Tail, start: int) -> tuple[bytes, int] | None:
    """The decoded record that starts there and where it ends; None if none does."""
    z, out, at, seen = zlib.decompressobj(31), [], start, 0
    try:
        while not z.eof:
            if not tail.need(at):
                return None
            piece = tail.buf[at - tail.at : at - tail.at + READ_BYTES]
            got = z.decompress(piece)
            at += len(piece) - len(z.unused_data)
            out.append(got)
            seen += len(got)
            if seen >= PROBE or z.eof:
                head = (out[0] if len(out[0]) >= 8 else b"".join(out))[:8]
                if not head.startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    data = b"".join(out)
    end = data.find(b"\r\n\r\n")
    return (data, at) if end >= 0 and b"\r\nContent-Length:" in data[:end] else None


def records_in(f, size: int, lo: int, hi: int, strict: bool = False):
    """(headers, payload) of the records that start in [lo, hi).

    ``strict`` raises where a record doesn't follow the one before it at once.
    """
    tail, at, due = Tail(f, lo, size), lo, 0 if lo == 0 else None
    yield from _records(tail, at, size, hi, due if strict else None, strict)


def _records(tail: Tail, at: int, size: int, hi: int, due: int | None, strict: bool):
    """``due``: where the next record must start, if that is known."""
    while at < hi:
        if not tail.need(at + 2):
            break
        found = tail.buf.find(MAGIC, at - tail.at)
        if found < 0:
            at = tail.at + len(tail.buf) - 2
            tail.drop(at)
            if not tail.need(at + 3):
                break
            continue
        start = tail.at + found
        if start >= hi:
            break
        tail.drop(start)
        got = member(tail, start)
        if got is None:
            at = start + 1
            continue
        if due is not None and start != due:
            raise ValueError(f"no record at byte {due}")
        data, at = got
        due = at if strict else None
        cut = data.index(b"\r\n\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[:cut].decode("utf-8", "replace").split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, data[cut + 4 : cut + 4 + n]
    if due is not None and due < size and (due < hi or member(tail, due) is None):
        raise ValueError(f"no record at byte {due}")


def read_warc(spark: SparkSession, out_uri: str, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES, with_html: bool = False, strict: bool = True) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of every record in the archives.

    A response's length and digest are taken from the payload itself, a
    revisit's from its headers. ``with_html`` adds the payload of responses.
    ``strict``: see the module's text.
    """
    out_uri = qualified(spark, out_uri)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    if with_html:
        schema = schema.append(pa.field("html", pa.string()))

    def number(x: str | None) -> int | None:
        return int(x) if x and x != "None" else None

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = []
                fs, base = open_fs(out_uri)
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    for head, body in records_in(f, r["size"], r["lo"], r["hi"], strict):
                        kind = head["WARC-Type"]
                        digest, length = (hashlib.sha1(body).hexdigest(), len(body)) if kind == "response" else (head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]))
                        row = {"page_id": number(head.get("X-Page-Id")), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("X-Refers-To-Page"))}
                        rows.append(row | ({"html": body.decode("utf-8", "replace") if kind == "response" else None} if with_html else {}))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranges = [(name, size, lo, min(size, lo + split_bytes)) for name, size in files for lo in range(0, size, split_bytes)]
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", html string" if with_html else "")
    df = spark.createDataFrame(ranges, "file string, size long, lo long, hi long")
    return df.repartition(max(1, min(len(ranges), 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, ddl)
