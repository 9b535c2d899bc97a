"""Semi-structured answers: lenient reading, strict rules, agreement with a specification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import amounts
from .text import first_json_block, js_round, let

# Spellings of date hints.
HINTS = {
    "hari_ini": "hari_ini", "td": "hari_ini", "tadi": "hari_ini", "barusan": "hari_ini",
    "kemarin": "kemarin", "maren": "kemarin", "kmrn": "kemarin",
    "lusa": "lusa", "minggu_ini": "minggu_ini", "bulan_ini": "bulan_ini", "tidak_jelas": "tidak_jelas",
}
# Words for income.
INCOME_WORDS = ["pemasukan", "income", "masuk", "credit"]
MAX_WORDS = 8
ENTRY = "struct<type:string,tanggal_hint:string,deskripsi:string,jumlah:bigint,kategori:string,vendor:string,confidence:string,ambigu:boolean,catatan_ambigu:string>"
LABEL_KEYS = ["entries", "bukan_transaksi", "ringkasan"]
ENTRY_KEYS = ["type", "tanggal_hint", "deskripsi", "jumlah", "kategori", "vendor", "confidence", "ambigu", "catatan_ambigu"]


def date_hint(value: Column) -> Column:
    """One of the known hints; unknown text is tidak_jelas, null stays null."""
    key = F.regexp_replace(F.trim(F.lower(value)), r"\s+", "_")
    known = F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv))
    return F.when(value.isNull(), None).otherwise(F.coalesce(F.try_element_at(known, key), F.lit("tidak_jelas")))


def confidence(value: Column) -> Column:
    """high, medium or low, from the word or a number; anything else is medium. Null and blank text count as 0."""
    n = F.when(value.isNull() | (F.trim(value) == ""), 0.0).otherwise(value.try_cast("double"))
    return F.when(value.isin("high", "medium", "low"), value).when(n >= 0.8, "high").when(n >= 0.5, "medium").when(n.isNull() | F.isnan(n), "medium").otherwise("low")


def kind_of(v: Column) -> Column:
    """missing, VOID (a JSON null), BOOLEAN, STRING, NUMBER, ARRAY or OBJECT of a JSON value (a variant)."""
    kind = F.schema_of_variant(v)
    found = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "NUMBER").otherwise(F.regexp_extract(kind, "^([A-Z]+)", 1))
    return F.when(v.isNull(), "missing").otherwise(found)


def confidence_of(v: Column) -> Column:
    """confidence() of a JSON value: a missing one is medium, null is low, an array counts as its only element."""
    def judged(k: Column) -> Column:
        said = F.try_variant_get(v, "$", "string")
        items = F.try_variant_get(v, "$", "array<string>")
        listed = F.when(F.size(items) == 0, "low").when(F.size(items) == 1, confidence(F.get(items, F.lit(0)))).otherwise("medium")
        return F.when(k == "missing", "medium").when(k == "VOID", "low").when(k == "BOOLEAN", F.when(said == "true", "high").otherwise("low")).when(k == "ARRAY", listed).when(k == "OBJECT", "medium").otherwise(confidence(said))

    return let(kind_of(v), judged)


def amount_of(v: Column) -> Column:
    """The amount of a JSON value: a number is rounded, half up; text is read leniently."""
    said = F.try_variant_get(v, "$", "string")
    return F.when(kind_of(v) == "NUMBER", js_round(F.try_variant_get(v, "$", "double"))).otherwise(amounts.lenient_amount(said))


def direction(value: Column) -> Column:
    return F.when(F.trim(F.lower(F.coalesce(value, F.lit("")))).isin(INCOME_WORDS), "pemasukan").otherwise("pengeluaran")


def truthy(v: Column) -> Column:
    """Truth of a JSON value (a variant): false, null, 0 and the empty string are false, all else true."""
    kind, s = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    scalar = F.when(kind == "BOOLEAN", s == "true").when(kind == "STRING", s != "").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), s.try_cast("double") != 0)
    return F.when(v.isNull() | (kind == "VOID"), False).otherwise(F.coalesce(scalar, F.lit(True)))


def lenient_label(content: Column) -> Column:
    """A label struct from a model's answer: block found, keys by any of their names, values coerced; null if unreadable."""
    return read_label(content)["label"]


def read_label(content: Column) -> Column:
    """label and parse_error: why an answer can't be read (no_json, not_an_object, entry_not_an_object), else null.

    The first of the keys for entries that isn't null counts; what isn't a list is
    no entries. A flag that isn't true or false means: there are no entries.
    """
    at = lambda v, path: F.try_variant_get(v, f"$.{path}", "variant")
    present = lambda v: F.when(~kind_of(v).isin("missing", "VOID"), v)
    words = lambda v, path: F.try_variant_get(v, f"$.{path}", "string")

    def entry(e: Column) -> Column:
        return F.struct(
            direction(words(e, "type")).alias("type"), date_hint(words(e, "tanggal_hint")).alias("tanggal_hint"),
            F.coalesce(words(e, "deskripsi"), words(e, "description"), F.lit("")).alias("deskripsi"),
            let(F.coalesce(present(at(e, "jumlah")), present(at(e, "amount"))), amount_of).alias("jumlah"), words(e, "kategori").alias("kategori"), words(e, "vendor").alias("vendor"),
            confidence_of(at(e, "confidence")).alias("confidence"), truthy(at(e, "ambigu")).alias("ambigu"), words(e, "catatan_ambigu").alias("catatan_ambigu"))

    def read(doc: Column) -> Column:
        listed = F.coalesce(*(present(at(doc, k)) for k in ("entries", "transaksi", "transactions")))
        raw = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>"))
        return let(raw, lambda r: whole(doc, r))

    def whole(doc: Column, raw: Column) -> Column:
        flag = at(doc, "bukan_transaksi")
        odd = F.exists(raw, lambda e: ~kind_of(e).isin("OBJECT", "ARRAY"))
        error = F.when(doc.isNull(), "no_json").when(~kind_of(doc).isin("OBJECT", "ARRAY"), "not_an_object").when(odd, "entry_not_an_object")
        said = F.when(kind_of(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")).otherwise(F.size(raw) == 0)
        label = F.struct(F.transform(raw, entry).alias("entries"), said.alias("bukan_transaksi"), words(doc, "ringkasan").alias("ringkasan"))
        return F.struct(F.when(error.isNull(), label).alias("label"), error.alias("parse_error"))

    return let(F.try_parse_json(first_json_block(content)), read)


def unknown_keys(json: Column) -> Column:
    """Has the answer, or an entry of it, keys the schema doesn't know, or lacks one it needs?"""
    top = F.array_sort(F.json_object_keys(json))
    entries = F.from_json(F.get_json_object(json, "$.entries"), "array<map<string,string>>")
    keys = F.array_sort(F.array(*map(F.lit, ENTRY_KEYS)))
    odd = F.exists(entries, lambda e: F.array_sort(F.map_keys(e)) != keys)
    return F.coalesce(top != F.array_sort(F.array(*map(F.lit, LABEL_KEYS))), F.lit(True)) | F.coalesce(odd, F.lit(True))


def strict_issues(label: Column, allow_duplicates: Column | bool = False) -> Column:
    """Names of the rules a label breaks, in order; empty if it is clean."""
    e, allowed = label["entries"], F.lit(allow_duplicates)
    any_ = lambda f: F.exists(e, lambda x: F.coalesce(f(x), F.lit(False)))
    blank = lambda s: F.coalesce(s, F.lit("")) == ""
    words = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    rules = [
        ("flag", label["bukan_transaksi"] != (F.size(e) == 0)),
        ("amount", any_(lambda x: x["jumlah"] <= 0)),
        ("note_missing", any_(lambda x: x["ambigu"] & blank(x["catatan_ambigu"]))),
        ("note_unflagged", any_(lambda x: ~x["ambigu"] & ~blank(x["catatan_ambigu"]))),
        ("sure_but_ambiguous", any_(lambda x: x["ambigu"] & (x["confidence"] == "high"))),
        ("empty_text", any_(lambda x: F.trim(x["deskripsi"]) == "")),
        ("long_text", any_(lambda x: words(x["deskripsi"]) > MAX_WORDS)),
        ("future", any_(lambda x: x["tanggal_hint"] == "lusa")),
        ("duplicate", ~allowed & (F.size(e) != F.size(F.array_distinct(F.transform(e, lambda x: F.to_json(x)))))),
    ]
    return F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules)))


def guard_trace(label: Column, atoms: Column, known: Column) -> Column:
    """Tier of each entry's amount: direct, derived (also if in ``known``), none."""

    def tier(x):
        t = amounts.trace(x["jumlah"], atoms)["tier"]
        return F.when((t == "none") & F.array_contains(known, x["jumlah"]), "derived").otherwise(t)

    return F.transform(label["entries"], tier)


def same_amounts(a: Column, b: Column) -> Column:
    """Are two lists equal as multisets?"""
    return F.sort_array(a) == F.sort_array(b)


def match_alternative(entries: Column, wanted: Column) -> Column:
    """Differences between entries and one alternative: greedy on amount and direction, removing what matched.

    wanted: array of type, jumlah, tanggal_hint (null: any), ambigu (null: any).
    """

    def take(acc: Column, w: Column) -> Column:
        rest = acc["rest"]
        same = F.transform(rest, lambda g: (g["jumlah"] == w["jumlah"]) & (g["type"] == w["type"]))
        at = F.array_position(same, True).cast("int")
        hit = F.get(rest, at - 1)
        other_way = F.exists(rest, lambda g: g["jumlah"] == w["jumlah"])
        diffs = F.array_compact(F.array(
            F.when(at == 0, F.when(other_way, "type").otherwise("jumlah")),
            F.when((at > 0) & w["tanggal_hint"].isNotNull() & ~hit["tanggal_hint"].eqNullSafe(w["tanggal_hint"]), "tanggal_hint"),
            F.when((at > 0) & w["ambigu"].isNotNull() & (hit["ambigu"] != w["ambigu"]), "ambigu")))
        left = F.when(at > 0, F.concat(F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(rest, at + 1, F.size(rest)))).otherwise(rest)
        return F.struct(left.alias("rest"), F.concat(acc["diffs"], diffs).alias("diffs"))

    start = F.struct(entries.alias("rest"), F.array().cast("array<string>").alias("diffs"))
    return F.when(F.size(entries) != F.size(wanted), F.array(F.lit("count"))).otherwise(F.aggregate(wanted, start, take)["diffs"])


def agreement(label: Column, non_transaction: Column, alternatives: Column, absent: Column) -> Column:
    """Differences between a label and its specification; empty if any alternative fits."""
    e = label["entries"]
    each = F.transform(alternatives, lambda a: match_alternative(e, a))
    booked = F.filter(absent, lambda v: F.exists(e, lambda x: x["jumlah"] == v))
    extra = F.transform(booked, lambda v: F.concat(F.lit("absent:"), v.cast("string")))
    fits = F.exists(each, lambda d: F.size(d) == 0)
    none = F.array().cast("array<string>")
    body = F.when(F.size(alternatives) == 0, none).when(fits, none).otherwise(F.get(each, F.lit(0)))
    return F.when(label["bukan_transaksi"] != non_transaction, F.array(F.lit("non_transaction"))).otherwise(F.concat(extra, F.when(non_transaction, none).otherwise(body)))


def first_phase(*steps: tuple[str, Column]) -> Column:
    """Name of the first step whose condition holds; null if none does."""
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, failed in steps:
        c = c.when(failed, name)
    return c
