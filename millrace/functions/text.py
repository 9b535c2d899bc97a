"""Text normalisation, token and n-gram sets, keyword predicates: Column to Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content of their own in Indonesian chat.
STOPWORDS = [
    "yang", "sama", "sm", "dan", "di", "ke", "dari", "buat", "untuk", "sih", "deh", "dong",
    "aja", "aje", "udah", "udh", "sudah", "td", "tadi", "gw", "gue", "aku", "saya", "nya",
    "ini", "itu", "ada", "juga", "lagi", "tapi", "terus", "trus", "abis", "doang", "kok",
]

#: White space as chat clients send it, the no-break kinds included.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def chat_norm(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces: the form texts are compared in."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s\x{00a0}]", " "))


def grading_norm(text: Column) -> Column:
    """Lower case, single spaces, punctuation kept."""
    return squeeze(F.lower(text))


def content_tokens(norm: Column) -> Column:
    """Distinct words of more than one letter that are no stopwords, of a normalised text."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def char_grams(norm: Column, n: int = 4) -> Column:
    """Distinct runs of n characters, spaces left out; one regex pass."""
    return F.array_distinct(F.regexp_extract_all(F.replace(norm, F.lit(" ")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def word_grams(norm: Column, n: int = 3) -> Column:
    """Distinct runs of n words; none for shorter texts."""
    def grams(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.array_distinct(let(F.filter(F.split(norm, " "), lambda x: x != ""), grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.least(F.size(a), F.size(b)))


def any_keyword(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w)) if words else F.lit(False)


def all_keywords(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.forall(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w)) if words else F.lit(True)


def batch_text(raw: Column) -> Column:
    """First line of a generated text without wrapping quotes; null under three characters."""
    line = F.trim(F.split(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), "\n")[0])
    bare = F.trim(F.regexp_replace(line, "^[\"'`]+|[\"'`]+$", ""))
    return F.when(F.length(bare) >= 3, bare)


def first_json_block(content: Column) -> Column:
    """A fenced json block's content, else from the first brace to the last, else the text."""
    fenced = F.regexp_extract(content, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    block = F.when(F.length(F.trim(fenced)) > 0, fenced).when(F.length(braces) > 0, braces).otherwise(content)
    return F.regexp_replace(block, r"^\s+|\s+$", "")


def thinking(content: Column, *reasoning: Column) -> Column:
    """Does an answer carry reasoning, in fields of its own or inside a tag?"""
    said = F.coalesce(content, F.lit("")).rlike("(?i)<think>")
    for r in reasoning:
        said = said | (F.length(F.trim(F.coalesce(r, F.lit("")))) > 0)
    return said


def js_round(x: Column) -> Column:
    """Half up towards plus infinity, as BIGINT."""
    return F.floor(x + 0.5).cast("long")


def csv_cell(x: Column) -> Column:
    """A CSV cell, quoted if it holds a quote, comma or line break; null is empty."""
    v = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
