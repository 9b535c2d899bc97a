"""From a cell's invariants to what its label must hold, and the check of a whole row.

Invariants are an array of structs: kind, rupiah, hint, applies_to, at_least,
unit, count, total, masuk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import amounts, labels

INVARIANT = "struct<kind:string,rupiah:bigint,hint:string,applies_to:string,at_least:int,unit:bigint,count:int,total:bigint,masuk:int>"
WANTED = "array<struct<type:string,jumlah:bigint,tanggal_hint:string,ambigu:boolean>>"


def of_kind(invariants: Column, kind: str) -> Column:
    return F.filter(invariants, lambda i: i["kind"] == kind)


def first(invariants: Column, kind: str) -> Column:
    return F.get(of_kind(invariants, kind), F.lit(0))


def wanted(type_: Column, jumlah: Column, hint: Column, ambigu: Column) -> Column:
    return F.struct(type_.alias("type"), jumlah.alias("jumlah"), hint.alias("tanggal_hint"), ambigu.alias("ambigu"))


def is_non_transaction(invariants: Column) -> Column:
    return F.size(of_kind(invariants, "non_transaction")) > 0


def absent_amounts(invariants: Column) -> Column:
    return F.transform(of_kind(invariants, "amount_absent"), lambda i: i["rupiah"])


def alternatives(invariants: Column, direction: Column) -> Column:
    """The entry lists a label may hold: one, or for a quantity the split and the merged reading."""
    no_flag = F.lit(None).cast("boolean")
    hint = F.get(F.filter(of_kind(invariants, "date_hint"), lambda i: i["applies_to"] == "all"), F.lit(0))["hint"]
    qty, out = first(invariants, "qty_merge_ok"), F.lit("pengeluaran")
    split = F.array_repeat(wanted(out, qty["unit"], hint, no_flag), qty["count"])
    merged = F.array(wanted(out, F.coalesce(first(invariants, "sum_out")["total"], qty["unit"] * qty["count"]), hint, no_flag))
    booked = F.transform(of_kind(invariants, "amount_present"), lambda i: i["rupiah"])
    income = F.coalesce(first(invariants, "direction_count")["masuk"], F.when(direction == "in", F.size(booked)).otherwise(0))
    flagged = F.coalesce(first(invariants, "ambigu_flagged")["at_least"], F.lit(0))
    plain = F.transform(booked, lambda v, i: wanted(F.when(i < income, "pemasukan").otherwise("pengeluaran"), v, hint, F.when(i < flagged, F.lit(True))))
    cast = lambda c: c.cast(WANTED)
    return F.when(is_non_transaction(invariants), F.array(F.array().cast(WANTED))).when(qty.isNotNull(), F.array(cast(split), cast(merged))).otherwise(F.array(cast(plain)))


def text_amounts(surfaces: Column, invariants: Column) -> Column:
    """The amounts a text must name, as a list with repeats: ordered surfaces and distractors."""
    return F.concat(surfaces, absent_amounts(invariants))


def excused(surfaces: Column, invariants: Column, direction: Column) -> Column:
    """Amounts a text names that no entry books: distractors, unbooked surfaces, a quantity's unit."""
    booked = F.transform(F.get(alternatives(invariants, direction), F.lit(0)), lambda e: e["jumlah"])
    unit = F.transform(of_kind(invariants, "qty_merge_ok"), lambda i: i["unit"])
    return F.array_union(F.array_union(absent_amounts(invariants), F.array_except(surfaces, booked)), unit)


def traceable(invariants: Column, direction: Column) -> Column:
    """Amounts that are right though no text names them: the merged total of a quantity."""
    merged = F.transform(F.get(alternatives(invariants, direction), F.lit(1)), lambda e: e["jumlah"])
    return F.coalesce(merged, F.array().cast("array<bigint>"))


def row_phase(text: Column, atoms: Column, label: Column, invariants: Column, surfaces: Column, direction: Column, leaked: Column | bool = False, raw: Column | None = None, repeated: Column | bool = False) -> Column:
    """The first gate a generated row fails; null for a row that passes all.

    ``atoms`` are the text's amounts (``amount_atoms``), kept in a column by the
    caller; ``leaked`` and ``repeated`` say whether the text is one of the scored
    corpus or came before; ``raw`` is the answer the label was read from.
    """
    gone = excused(surfaces, invariants, direction)
    booked = F.transform(label["entries"], lambda e: e["jumlah"])
    qty = F.size(of_kind(invariants, "qty_merge_ok")) > 0
    plain = F.try_parse_json(raw).isNull() if raw is not None else F.lit(False)
    odd = labels.unknown_keys(raw) if raw is not None else F.lit(False)
    return labels.first_phase(
        ("text:leak", F.lit(leaked)),
        ("text:bijection", ~labels.same_amounts(F.transform(atoms, lambda a: a["value"]), text_amounts(surfaces, invariants))),
        ("text:ambiguous-amount", amounts.ambiguous(atoms)),
        ("label:plain-json", plain),
        ("label:schema", odd | (F.size(labels.strict_issues(label, qty)) > 0)),
        ("label:trace", F.array_contains(labels.guard_trace(label, atoms, traceable(invariants, direction)), "none")),
        ("label:dropped-entry", F.size(amounts.unexcused(text, atoms, F.array_union(booked, gone))) > 0),
        ("agreement", F.size(labels.agreement(label, is_non_transaction(invariants), alternatives(invariants, direction), absent_amounts(invariants))) > 0),
        ("dedup", F.lit(repeated)))
