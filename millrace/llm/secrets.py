"""Secret scans with Column expressions only.

Base kinds are regular expressions.  Places of matches come from one split of
the text by the same expression: pieces between matches and the matches in turn
add up to every start, in code points.

``entropy`` spans come from candidate strings (runs of token characters): a
window of ``WINDOW`` characters slides over each, and the Shannon entropy of
the window is kept up to date by adding the terms of the character that enters
and taking off those of the one that leaves.  Each character class (hexadecimal
digits; letters and digits; the base64 alphabet) has a threshold of its own.
Terms are whole millionths of a bit, so results don't depend on the order of
sums.  A candidate is suppressed when the allow list explains it: no digit or
no letter in it (a word, a number), a UUID, or one of the given expressions.

Work is linear in the length of a text and in its matches: arrays that a fold
reads are worked out once (``let``), results are appended in chunks.

Defined cases: null text counts as empty (no spans); very long texts and
candidates are scanned to their end; repeated rows give repeated results; a null
``doc_id`` keeps its row; an empty table gives no rows; other columns are ignored
by ``scan`` and kept by ``redact_in``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = ASSIGN[: ASSIGN.rindex("[A-Za-z0-9+/_.=-]+")]
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
VALUE_MIN = 12

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy of a window in millionths of a bit, by class.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 3_000_000, 3_600_000, 3_700_000
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
KINDS = ["assign", "access", "hex", "entropy"]

SPAN = "struct<start:long,end:long,kind:int,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"
GAP = "struct<from:long,size:long>"
#: Items folded at a time, and characters of a block that places are found in.
CHUNK, BLOCK = 256, 4096


def n_log_n(n: int) -> int:
    """n log2 n in millionths."""
    return round(n * math.log2(n) * 1_000_000) if n else 0


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once; a lambda that names an expression works it out at every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def folded(items: Column, add, kind: str) -> Column:
    """A struct (at, out) after a fold that appends to an array.

    ``add(acc, item)`` gives the new ``at`` and an array of what is appended.
    Items are folded ``CHUNK`` at a time, so that appending stays linear however
    many there are.
    """
    def start(at: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def one(acc: Column, item: Column) -> Column:
        at, new = add(acc["at"], item)
        return F.struct(at.cast("long").alias("at"), F.concat(acc["out"], new).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, start(acc["at"]), one)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))

    def whole(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: F.slice(a, c * CHUNK + 1, CHUNK))
        return F.aggregate(F.when(F.size(a) > 0, parts), start(F.lit(0)), chunk)

    return let(items, whole)


def found(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all leftmost matches, in order."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("match")))

    def add(at: Column, pair: Column) -> tuple[Column, Column]:
        start, end = at + pair["gap"], at + pair["gap"] + pair["size"]
        return end, F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("value")))

    # the last piece has no match after it
    spans = folded(F.filter(pairs, lambda x: x["match"].isNotNull()), add, SPAN)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(NONE))


def max_window_entropy(s: Column) -> Column:
    """The largest entropy of a window over s, in millionths of a bit, by incremental counts."""
    terms = [n_log_n(i) for i in range(WINDOW + 2)]
    top = WINDOW * round(math.log2(WINDOW) * 1_000_000)
    # what a count of n adds when it grows by one, and takes off when it shrinks by one
    grow = F.array(*(F.lit(b - a).cast("long") for a, b in zip(terms, terms[1:])))
    shrink = F.array(*(F.lit(a - b).cast("long") for a, b in zip([0, *terms], terms)))

    def over(places: Column, letters: Column, steps: Column) -> Column:
        """``places``: each character as its place in the alphabet of s; none are named in the fold but these two arrays."""

        def turn(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(places, i), F.when(i >= WINDOW, F.get(places, i - WINDOW)).otherwise(-1)
            less = F.when(leaves >= 0, F.get(steps["shrink"], F.get(acc["count"], leaves))).otherwise(0)
            was = F.get(acc["count"], enters) - F.when(enters == leaves, 1).otherwise(0)
            total = acc["sum"] + less + F.get(steps["grow"], was)
            count = F.transform(acc["count"], lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0))
            best = F.when(i >= WINDOW - 1, F.least(acc["low"], total)).otherwise(acc["low"])
            return F.struct(count.alias("count"), total.cast("long").alias("sum"), best.cast("long").alias("low"))

        start = F.struct(F.transform(letters, lambda _: F.lit(0)).alias("count"), F.lit(0).cast("long").alias("sum"), F.lit(2**60).cast("long").alias("low"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, turn)["low"]

    def coded(chars: Column) -> Column:
        def with_letters(letters: Column) -> Column:
            places = F.transform(chars, lambda c: F.array_position(letters, c).cast("int") - 1)
            return let(F.struct(places.alias("places"), F.struct(grow.alias("grow"), shrink.alias("shrink")).alias("steps")), lambda x: over(x["places"], letters, x["steps"]))

        return let(F.array_distinct(chars), with_letters)

    low = let(F.array_remove(F.split(s, ""), ""), coded)
    return F.floor((F.lit(top) - low) / WINDOW)


def risky(value: Column, allow: list[str] | None = None) -> Column:
    """Is a candidate string random enough in its class, and not on the allow list?"""
    known = value.rlike(UUID)
    for a in allow or []:
        known = known | value.rlike(a)
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), HEX_BITS).when(value.rlike("^[A-Za-z0-9]+$"), ALNUM_BITS).otherwise(BASE64_BITS)
    word = ~value.rlike("[0-9]") | ~value.rlike("[A-Za-z]")
    return F.when(word | known, False).otherwise(max_window_entropy(value) >= least)


def spans_of(text: Column, allow: list[str] | None = None) -> Column:
    """All spans (start, end, kind number, value) of a text column without nulls, by start then kind."""
    assign = F.filter(found(text, ASSIGN, 0), lambda s: F.length(F.regexp_replace(s["value"], "^" + ASSIGN_HEAD, "")) >= VALUE_MIN)
    tried = F.filter(found(text, CANDIDATE, 3), lambda s: risky(s["value"], allow))
    order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(a["kind"] - b["kind"])
    return F.array_sort(F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2), tried), order)


def scan(docs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", spans_of(F.col("text"), allow).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and the list of all spans of scanned documents."""
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return scanned.select("doc_id", *map(count, range(3)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every stretch covered by spans replaced by the mask."""

    def add(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.struct(at.alias("from"), (s["start"] - at).alias("size"))
        none = F.expr(f"cast(array() as array<{GAP}>)")
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(gap)).otherwise(none)

    def cut(blocks: Column) -> Column:
        """The gaps' texts; a place is found from its block on, not from the text's start."""

        def piece(start: Column, size: Column) -> Column:
            first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + size) / BLOCK).cast("int")
            return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (start - first * BLOCK + 1).cast("int"), size.cast("int"))

        def joined_up(d: Column) -> Column:
            first = F.floor(d["at"] / BLOCK).cast("int")
            tail = F.substr(F.array_join(F.slice(blocks, first + 1, F.size(blocks)), ""), (d["at"] - first * BLOCK + 1).cast("int"))
            return F.array_join(F.concat(F.transform(d["out"], lambda g: piece(g["from"], g["size"])), F.array(tail)), mask)

        return let(folded(spans, add, GAP), joined_up)

    made = let(F.regexp_extract_all(text, F.lit(f"((?s).{{1,{BLOCK}}})"), F.lit(1)), cut)
    return F.when(F.size(spans) > 0, made).otherwise(text)


def redact_in(docs: DataFrame, allow: list[str] | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets masked in ``text`` (null stays null) and ``n_chars``, if there, counted again."""
    spare = "_spans"
    while spare in docs.columns:
        spare += "_"
    held = docs.withColumn(spare, spans_of(F.coalesce("text", F.lit("")), allow))
    out = held.withColumn("text", masked(F.col("text"), F.col(spare), mask)).drop(spare)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
