"""Grading of extracted entries: greedy matching, partial credit, composite scores, tiers.

Entries are arrays of structs of a message, a few elements by nature; folds over
them stay in one row and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import grading_norm, js_round, let


def amount_matches(got: Column, want: Column) -> Column:
    """Between the bounds if any is set (a missing one is the amount), else equal."""
    bounded = want["jumlah_min"].isNotNull() | want["jumlah_max"].isNotNull()
    return F.when(bounded, got["jumlah"].between(F.coalesce(want["jumlah_min"], want["jumlah"]), F.coalesce(want["jumlah_max"], want["jumlah"]))).otherwise(got["jumlah"] == want["jumlah"])


def amount_in_range(got: Column, want: Column) -> Column:
    """Within the bounds that are set and equal to the amount all the same: the partial-credit rule."""
    return (got["jumlah"] == want["jumlah"]) & (got["jumlah"] >= F.coalesce(want["jumlah_min"], got["jumlah"])) & (got["jumlah"] <= F.coalesce(want["jumlah_max"], got["jumlah"]))


def text_hit(got: Column, want: Column) -> Column:
    """Any keyword in the description or vendor; true without keywords."""
    text = grading_norm(F.concat_ws(" ", got["deskripsi"], F.coalesce(got["vendor"], F.lit(""))))
    return F.coalesce(F.size(want["words"]) <= 0, F.lit(True)) | F.coalesce(F.exists(want["words"], lambda w: F.contains(text, grading_norm(w))), F.lit(False))


def entry_matches(got: Column, want: Column) -> Column:
    hint = want["tanggal_hint"].isNull() | got["tanggal_hint"].isNull() | (got["tanggal_hint"] == "tidak_jelas") | (got["tanggal_hint"] == want["tanggal_hint"])
    flag = ~F.coalesce(want["ambigu"], F.lit(False)) | F.coalesce(got["ambigu"], F.lit(False))
    return (got["type"] == want["type"]) & amount_matches(got, want) & hint & flag & text_hit(got, want)


def without(items: Column, at: Column) -> Column:
    """The array less the element at place ``at`` (from 1); all of it for 0."""
    return F.when(at > 0, F.concat(F.slice(items, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(items, at + 1, F.size(items)))).otherwise(items)


def greedy(got: Column, want: Column, matches=entry_matches) -> Column:
    """matched and extra: each wanted entry in order takes the first entry left that matches."""

    def take(acc: Column, w: Column) -> Column:
        at = F.array_position(F.transform(acc["rest"], lambda g: F.coalesce(matches(g, w), F.lit(False))), True).cast("int")
        return let(at, lambda i: F.struct(without(acc["rest"], i).alias("rest"), (acc["n"] + F.when(i > 0, 1).otherwise(0)).alias("n")))

    start = F.struct(got.alias("rest"), F.lit(0).alias("n"))
    return F.aggregate(want, start, take, lambda a: F.struct(a["n"].alias("matched"), F.size(a["rest"]).alias("extra")))


def partial_credit(got: Column, want: Column) -> Column:
    """0 for the wrong direction; else 35 and up to 40 for the amount, 15 for the date, 10 for the text."""
    bounded = want["jumlah_min"].isNotNull() | want["jumlah_max"].isNotNull()
    near = F.least(got["jumlah"], want["jumlah"]) * 10 >= F.greatest(got["jumlah"], want["jumlah"], F.lit(1)) * 9
    amount = F.when(amount_in_range(got, want), 40).when(bounded, 0).when(near, 30).otherwise(0)
    date = F.when(want["tanggal_hint"].isNull(), 10).when(got["tanggal_hint"].eqNullSafe(want["tanggal_hint"]), 15).when(got["tanggal_hint"].eqNullSafe(F.lit("tidak_jelas")), 8).otherwise(0)
    return F.when(got["type"] == want["type"], F.least(F.lit(100), 35 + amount + date + F.when(text_hit(got, want), 10).otherwise(0))).otherwise(0)


def best_credit(got: Column, want: Column) -> Column:
    """amount, type, date and ambigu points over the wanted entries, and extra entries.

    Each wanted entry in order takes the entry left with the most credit (the
    first of equals) if that is at least 40.
    """

    def take(acc: Column, w: Column) -> Column:
        def place(credit: Column) -> Column:
            top = F.array_max(credit)
            return F.when(F.coalesce(top, F.lit(0)) >= 40, F.array_position(credit, top)).otherwise(0).cast("int")

        def gain(at: Column, g: Column) -> Column:
            near = F.least(g["jumlah"], w["jumlah"]) * 10 >= F.greatest(g["jumlah"], w["jumlah"], F.lit(1)) * 9
            amount = F.when(amount_in_range(g, w), 100).when(near, 70).otherwise(20)
            date = F.when(w["tanggal_hint"].isNull() | g["tanggal_hint"].eqNullSafe(w["tanggal_hint"]), 100).when(g["tanggal_hint"].eqNullSafe(F.lit("tidak_jelas")), 60).otherwise(0)
            flag = F.when(~F.coalesce(w["ambigu"], F.lit(False)) | F.coalesce(g["ambigu"], F.lit(False)), 100).otherwise(40)
            add = lambda name, points: (acc[name] + F.when(at > 0, points).otherwise(0)).alias(name)
            return F.struct(without(acc["rest"], at).alias("rest"), add("amount", amount), add("type", F.when(g["type"] == w["type"], 100).otherwise(0)), add("date", date), add("ambigu", flag))

        # each step is worked out once, however often the next one uses it
        at = let(F.transform(acc["rest"], lambda g: partial_credit(g, w)), place)
        return let(at, lambda i: let(F.get(acc["rest"], i - 1), lambda g: gain(i, g)))

    start = F.struct(got.alias("rest"), *(F.lit(0).alias(n) for n in ("amount", "type", "date", "ambigu")))
    n = F.greatest(F.size(want), F.lit(1))
    return F.aggregate(want, start, take, lambda a: F.struct(*((a[x] / n).alias(x) for x in ("amount", "type", "date", "ambigu")), F.size(a["rest"]).alias("extra")))


def no_hallucination(extra: Column, zero: Column, spurious: Column, copied: Column) -> Column:
    return F.greatest(F.lit(0), 100 - extra * 25 - zero * 30 - F.when(spurious, 40).otherwise(0) - F.when(copied, 35).otherwise(0))


def entry_count_score(got: Column, want: Column, alt: Column) -> Column:
    return F.when(got == want, 100).when(alt, 90).otherwise(F.greatest(F.lit(0), 100 - F.abs(got - want) * 25))


def composite(amount: Column, type_: Column, clean: Column, count: Column, date: Column, ambigu: Column, clean_strict: Column) -> Column:
    """Weights 30, 25, 20, 10, 5, 5 and 5 for free; at least 92 for a clean strict pass. Decimal, so ties are exact."""
    d = lambda c: c.cast("decimal(12,6)")
    total = (d(amount) * 30 + d(type_) * 25 + d(clean) * 20 + d(count) * 10 + d(date) * 5 + d(ambigu) * 5 + 500) / 100
    score = F.floor(total + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    return F.when(clean_strict, F.greatest(score, F.lit(92))).otherwise(score)


def tier(strict: Column, score: Column, entries: Column, spurious: Column, copied: Column, type_: Column) -> Column:
    return F.when(strict, "excellent").when(score >= 70, "usable_with_edit").when(score >= 50, "partially_usable").when((entries > 0) & (spurious | copied | (type_ < 50)), "misleading").otherwise("broken")


def non_transaction(flagged: Column, entries: Column) -> Column:
    return F.when(entries == 0, F.when(flagged, 100).otherwise(85)).otherwise(F.when(flagged, 50).otherwise(0))


def spurious_income(got: Column, want: Column, expect_none: Column) -> Column:
    """More income than wanted, income of zero, or any where none is wanted."""
    income = F.filter(got, lambda g: g["type"] == "pemasukan")
    n = F.size(F.filter(want, lambda w: w["type"] == "pemasukan"))
    return (F.size(income) > n) | F.exists(income, lambda g: g["jumlah"] == 0) | ((n == 0) & (F.size(income) > 0) & ~expect_none)


def price_copied(got: Column, want: Column) -> Column:
    """Does an entry carry the amount of another wanted line than its own (the first whose keyword it has)?"""

    def bled(g: Column) -> Column:
        at = F.array_position(F.transform(want, lambda w: (F.size(w["words"]) > 0) & text_hit(g, w)), True).cast("int")
        own = F.get(want, at - 1)["jumlah"]
        others = F.exists(without(want, at), lambda w: w["jumlah"] == g["jumlah"])
        return F.coalesce((at > 0) & (g["jumlah"] != own) & others, F.lit(False))

    amounts = F.array_distinct(F.transform(want, lambda w: w["jumlah"]))
    return (F.size(want) >= 2) & (F.size(amounts) >= 2) & F.exists(got, bled)


def alt_strict(got: Column, rule: Column, fixed_ok: Column) -> Column:
    """Other layouts that pass: merged or split quantities, principal and fee, one's own share.

    rule: kind, keyword, unit, count, principal, fee, personal, total.
    """
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, g: a + g["jumlah"])
    kw = F.filter(got, lambda g: F.contains(grading_norm(g["deskripsi"]), grading_norm(rule["keyword"])))
    split = F.size(F.filter(kw, lambda g: g["jumlah"] == rule["unit"])) == rule["count"]
    merged = (F.size(kw) >= 1) & (total(kw) == rule["unit"] * rule["count"])
    out = F.filter(got, lambda g: g["type"] == "pengeluaran")
    both = F.exists(out, lambda g: g["jumlah"] == rule["principal"]) & F.exists(out, lambda g: g["jumlah"] == rule["fee"])
    share = F.exists(got, lambda g: g["jumlah"] == rule["personal"])
    whole = F.get(F.filter(got, lambda g: g["jumlah"] == rule["total"]), F.lit(0))
    noted = F.coalesce(whole["ambigu"], F.lit(False)) | (F.coalesce(whole["catatan_ambigu"], F.lit("")) != "")
    k = rule["kind"]
    return F.coalesce(F.when(k.isin("qtyMerge", "totalOrSplit"), fixed_ok & (split | merged)).when(k == "principalPlusFee", both | (total(out) == rule["principal"] + rule["fee"])).when(k == "personalShare", share | noted), F.lit(False))


def strict_pass(flagged: Column, got: Column, want: Column, expect_none: Column) -> Column:
    """All wanted entries matched, none extra; nothing at all where no transaction is wanted."""
    m = greedy(got, want)
    return F.when(expect_none, flagged & (F.size(got) == 0)).otherwise((m["matched"] == F.size(want)) & (m["extra"] == 0) & ~(flagged & (F.size(want) > 0)))


def strict_outcome(flagged: Column, got: Column, want: Column, expect_none: Column, forgiven: Column, cleared: Column) -> Column:
    """passed, matched and extra where a scenario accepts other layouts.

    ``forgiven``: what is missing, and a wrong flag, is let pass, but entries left
    over still count (asked only where something is missing). ``cleared``: the
    layout passes as a whole, and no entry is left over.
    """
    none = expect_none & flagged & (F.size(got) == 0)

    def judged(m: Column) -> Column:
        all_ = m["matched"] == F.size(want)
        pardon = forgiven & ~all_
        extra = F.when(cleared, 0).otherwise(m["extra"])
        ok = cleared | ((all_ | pardon) & (extra == 0) & (pardon | ~(flagged & (F.size(want) > 0))))
        matched = F.when(cleared | pardon, F.size(want)).otherwise(m["matched"])
        return F.struct(F.when(expect_none, none).otherwise(ok).alias("passed"), F.when(expect_none, none.cast("int")).otherwise(matched).alias("matched"), F.when(expect_none, F.size(got)).otherwise(extra).alias("extra"))

    return let(greedy(got, want), judged)


def tier_of_twelve(strict: Column, score: Column, entries: Column, spurious: Column, copied: Column, type_: Column) -> Column:
    """The tier of the suite of twelve: as tier(); 85 points with the right directions are named apart."""
    near = (score >= 85) & (type_ >= 80) & ~spurious & ~copied
    return F.when(strict, "excellent").when(near, "near_correct").otherwise(tier(strict, score, entries, spurious, copied, type_))


def count_score_of_twelve(got: Column, want: Column, alt: Column) -> Column:
    """entry_count_score() of the suite of twelve: another layout costs 10 only with one entry too many."""
    return entry_count_score(got, want, alt & (got == want + 1))


def style_share(passed: Column) -> Column:
    return js_round(passed * 1000) / 1000
