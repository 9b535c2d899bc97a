"""Drafting a taxonomy of cells: budgets, per-cell draws, invariants, coherence, repair of what can't coexist, floors and marginals.

Drafting and repair of single cells are distributed.  Floors of tokens and
marginals are settled one move at a time, each depending on the last, so they
run on the driver over the few hundred cells a taxonomy has (``MAX_CELLS``
guards that).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import amounts, rng

# Entries that each cardinality stands for.
ENTRIES = {"zero": 0, "single": 1, "dua": 2, "tiga": 3, "banyak": 5}
# Notations whose surfaces are tokens, not numbers.
TOKEN_NOTATIONS = ["slang", "spelled", "regional_numeral"]
MAX_CELLS = 20_000


def draft(specs: DataFrame, axes: Sequence[str], budgets: dict[str, float], target: int, seed: int, least: int = 1) -> DataFrame:
    """Cells from specs (aspect, tier, weight, an array of values per axis): each axis drawn per cell.

    A tier's share of the target goes to its aspects by weight, largest
    remainders first, at least ``least`` each.  Draw k of cell n is a pure
    function of seed, aspect and n, so cells are made in parallel.
    """
    share = F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv))[F.col("tier")]
    tier, budget = W.partitionBy("tier"), F.floor(F.lit(target) * share + 0.5)
    exact = F.col("weight") / F.sum("weight").over(tier) * budget
    d = specs.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    d = d.withColumn("_rn", F.row_number().over(tier.orderBy((F.col("_exact") - F.col("_base")).desc(), "aspect"))).withColumn("_rest", budget - F.sum("_base").over(tier))
    d = d.withColumn("cells", F.greatest(F.lit(least), F.col("_base") + F.when(F.col("_rn") <= F.col("_rest"), 1).otherwise(0)).cast("int"))
    each = d.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    start = F.xxhash64(F.lit(seed), "aspect", "n")
    picks = {a: F.get(F.col(a), F.floor(rng.draw(start, F.lit(k + 1)) * F.size(a)).cast("int")) for k, a in enumerate(axes)}
    return each.select(F.format_string("%s-%02d", "aspect", "n").alias("id"), "aspect", "tier", *(c.alias(a) for a, c in picks.items()), *(F.col(a).alias(f"allowed_{a}") for a in axes))


def entries_of(cardinality: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in ENTRIES.items() for x in kv))[cardinality]


def relink(cells: DataFrame) -> DataFrame:
    """Values that can't stand together are put right, from the aspect's allowed ones where there are any.

    Columns: direction, cardinality, date_hint, register, register_intensity,
    magnitude, notation, has_nominal, allowed_cardinality, allowed_notation.
    """
    direction, card = F.col("direction"), F.col("cardinality")
    fit = lambda lo, hi, other: F.coalesce(F.get(F.filter("allowed_cardinality", lambda c: entries_of(c).between(lo, hi)), F.lit(0)), F.lit(other))
    bare = F.when(card == "zero", fit(1, 99, "single")).otherwise(card)
    both = F.when((direction == "mixed") & (entries_of(bare) < 2), fit(2, 99, "dua")).when((direction == "in") & (entries_of(bare) > 2), fit(1, 2, "single")).otherwise(bare)
    none = direction == "non_tx"
    can = F.create_map(*(x for k, (lo, hi) in amounts.BANDS.items() for x in (F.lit(k), F.array(*map(F.lit, writable(lo, hi))))))[F.col("magnitude")]
    feasible = F.array_intersect("allowed_notation", can)
    nominal = F.col("has_nominal") | ~none
    fixed = F.when(nominal & ~F.col("notation").isin(TOKEN_NOTATIONS) & ~F.array_contains(feasible, F.col("notation")), F.coalesce(F.get(feasible, F.lit(0)), F.lit("polos"))).otherwise(F.col("notation"))
    return cells.withColumns({
        "cardinality": F.when(none, "zero").otherwise(both), "date_hint": F.when(none, "tidak_jelas").otherwise(F.col("date_hint")), "has_nominal": nominal,
        "register_intensity": F.when(F.col("register") == "baku", "sisip").otherwise(F.col("register_intensity")), "notation": fixed})


#: What a cell asserts: every kind uses some of the fields.
INVARIANT = "struct<kind:string,rupiah:bigint,unit:bigint,n:int,masuk:int,keluar:int,total:bigint,hint:string,keyword:string>"
# The least amount a cell may name, and the aspects whose message is so many of one thing.
MONEY_FLOOR = 100
#: Numbers of entries that a cardinality allows.
CARD_RANGE = {"zero": (0, 0), "single": (1, 1), "dua": (2, 2), "tiga": (3, 3), "banyak": (4, 99)}


def assertion(kind: str, **fields: Column) -> Column:
    names = {"rupiah": "bigint", "unit": "bigint", "n": "int", "masuk": "int", "keluar": "int", "total": "bigint", "hint": "string", "keyword": "string"}
    return F.struct(F.lit(kind).alias("kind"), *(fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in names.items()))


def invariants(shadow: Column, qty: Column, keyword: Column, extra: dict[str, Column] | None = None) -> Column:
    """What a cell's label must hold, from its columns direction, values (array of amounts), date_hint, correction and aspect.

    ``shadow`` is an amount near the cell's own that the message names but
    doesn't book, ``qty`` how many of one thing a quantity cell has (null: no
    such cell), ``keyword`` that thing. ``extra`` gives conditions on the aspect
    for the kinds price_copy, share, discount, fuzzy, future, phantom, contested.
    """
    values, none = F.col("values"), F.array().cast(f"array<{INVARIANT}>")
    unit, n = F.coalesce(F.get(values, F.lit(0)), F.lit(10_000)), F.size(values)
    masuk = F.when(F.col("direction") == "in", n).when(F.col("direction") == "mixed", 1).otherwise(0)
    counted = F.concat(F.array(assertion("entry_count", n=n), assertion("direction_count", masuk=masuk, keluar=n - masuk)), F.transform(values, lambda v: assertion("amount_present", rupiah=v)))
    several = F.array(assertion("qty_merge_ok", keyword=keyword, unit=unit, n=qty), assertion("sum_out", total=unit * qty))
    absent = lambda v: assertion("amount_absent", rupiah=v)
    given = {k: F.coalesce(c, F.lit(False)) for k, c in (extra or {}).items()}
    when = lambda k, s: F.when(given.get(k, F.lit(False)), s)
    first = lambda other: F.coalesce(F.get(values, F.lit(0)), F.lit(other))
    more = F.array_compact(F.array(
        assertion("date_hint", hint=F.col("date_hint")),
        F.when(F.col("correction").isin("amount", "cancel"), absent(shadow)), F.when(F.col("correction") == "magnitude", absent(first(75_000) * 100)),
        when("price_copy", F.when(n >= 2, assertion("no_price_copy", n=F.size(F.array_distinct(values))))), when("share", absent(first(30_000) * 3)),
        when("discount", absent((F.floor(first(50_000) * 1.2 / 500 + 0.5) * 500).cast("long"))), when("fuzzy", assertion("ambigu_flagged", n=F.lit(1))), when("future", absent(shadow)), when("phantom", absent(shadow * 10)), when("contested", assertion("ambigu_flagged", n=F.lit(1)))))
    body = F.concat(F.when(qty.isNotNull(), several).otherwise(counted), more)
    return F.when(F.col("direction") == "non_tx", F.array(assertion("non_transaction"))).otherwise(F.coalesce(body, none))


def coherence(triggers: dict[str, list[str]], packs: Sequence[str]) -> dict[str, Column]:
    """Conditions that make a cell incoherent, by name.

    Columns: direction, cardinality, magnitude, date_hint, date_surface, values,
    surfaces (one for each value), invariants, vendors (array of struct(id, known,
    lo, hi, polarity)). ``triggers`` has the words of each date hint, ``packs`` the
    quantity words that stand for several items.
    """
    inv, values, tx = F.col("invariants"), F.col("values"), F.col("direction") != "non_tx"
    of = lambda kind: F.filter(inv, lambda i: i["kind"] == kind)
    has = lambda kind: F.size(of(kind)) > 0
    first = lambda kind: F.get(of(kind), F.lit(0))
    word = lambda text, words: text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b") if words else F.lit(False)
    foreign = F.lit(False)
    for hint, words in triggers.items():
        foreign = foreign | ((F.col("date_hint") != hint) & word(F.col("date_surface"), words))
    # lowest and highest amount of the cell's band; a band's end is not part of it
    low, high = (F.create_map(*(F.lit(x) for k, b in amounts.BANDS.items() for x in (k, b[i])))[F.col("magnitude")] for i in (0, 1))
    least, most = (F.create_map(*(F.lit(x) for k, r in CARD_RANGE.items() for x in (k, r[i])))[F.col("cardinality")] for i in (0, 1))
    top, n, dc = F.array_max(values), first("entry_count")["n"], first("direction_count")
    present = F.transform(of("amount_present"), lambda i: i["rupiah"])
    vendors = lambda f: F.exists("vendors", lambda v: F.coalesce(f(v), F.lit(False)))
    return {
        "future_hint": F.col("date_hint") == "lusa",
        "future_surface": tx & word(F.col("date_surface"), ["lusa"]),
        "foreign_trigger": foreign,
        "non_tx_entries": ~tx & (F.col("cardinality") != "zero"),
        "non_tx_invariants": ~tx & ((F.size(inv) != 1) | ~has("non_transaction")),
        "no_entries": tx & (F.col("cardinality") == "zero"),
        "no_values": tx & (F.size(values) == 0),
        "no_count": tx & ~has("entry_count") & ~has("qty_merge_ok"),
        "pack": tx & F.exists(of("qty_merge_ok"), lambda i: F.coalesce(word(i["keyword"], packs), F.lit(False))),
        "date_mismatch": tx & ((F.col("date_hint") != "tidak_jelas") != F.col("date_surface").isNotNull()),
        "below_floor": F.exists(values, lambda v: v < MONEY_FLOOR),
        "empty_surface": F.exists("surfaces", lambda x: F.trim(x) == ""),
        "outside_band": (top < low) | (top >= high),
        "count_of_values": n != F.size(values),
        "count_of_cardinality": (n < least) | (n > most),
        "income_in_expense": (F.col("direction") == "out") & (dc["masuk"] != 0),
        "expense_in_income": (F.col("direction") == "in") & (dc["keluar"] != 0),
        "mixed_one_way": (F.col("direction") == "mixed") & ((dc["masuk"] < 1) | (dc["keluar"] < 1)),
        "directions_sum": dc["masuk"] + dc["keluar"] != F.size(values),
        "present_and_absent": F.exists(of("amount_absent"), lambda i: F.array_contains(present, i["rupiah"])),
        "unknown_vendor": vendors(lambda v: ~v["known"]),
        "vendor_band": vendors(lambda v: v["known"] & ~amounts.bands_overlap(v["lo"], v["hi"] + 1, low, high)),
        "vendor_polarity": F.col("direction").isin("in", "out") & vendors(lambda v: v["known"] & (v["polarity"] != "any") & (v["polarity"] != F.col("direction"))),
    }


def writable(lo: int, hi: int) -> list[str]:
    """Number notations that can write some amount of a band [lo, hi)."""
    million, thousand = 1_000_000, 1_000
    able = {"polos": True, "rp_prefix": True, "dot_sep": hi > thousand, "rb_suffix": lo < million and hi > thousand, "k_suffix": lo < million, "jt_suffix": hi > million}
    return [n for n, ok in able.items() if ok]


def _small(cells: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in cells.orderBy("id").limit(MAX_CELLS + 1).collect()]
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells: not a taxonomy")
    return rows


def place_tokens(cells: DataFrame, tokens: dict[str, int], hosts: str, grow: str | None = None) -> dict[str, list[str]]:
    """For each token the ids of the cells that carry it: as many distinct cells as asked for.

    ``hosts`` is an array column with the tokens a cell may carry.  Tokens with
    the fewest hosts are placed first, each on the host with the fewest tokens
    so far. A token with too few hosts gets new cells, named ``grow`` and a
    number; without ``grow`` a ValueError names it.
    """
    rows = _small(cells)
    able = {t: [r["id"] for r in rows if t in (r[hosts] or [])] for t in tokens}
    load: Counter = Counter()
    out, made = {}, 0
    for t in sorted(tokens, key=lambda t: (len(able[t]) - tokens[t], t)):
        short = tokens[t] - len(able[t])
        if short > 0 and grow is None:
            raise ValueError(f"token {t!r} has {len(able[t])} hosts, needs {tokens[t]}")
        new = [f"{grow}-{made + n:02d}" for n in range(max(0, short))]
        made += len(new)
        out[t] = sorted(able[t], key=lambda i: (load[i], i))[: tokens[t]] + new
        load.update(out[t])
    return out


def repair_marginals(cells: DataFrame, axis: str, targets: dict[str, float], tolerance: float = 0.0) -> dict[str, str]:
    """New values of an axis, by cell id, that bring its shares to the targets as far as allowed values let them.

    In each step the value whose deficit is largest for the cells that could
    take it is served from the value with the largest surplus, by the cell with
    the fewest other values to take.  Stops when no move lowers the difference.
    """
    rows = _small(cells)
    value, allowed = {r["id"]: r[axis] for r in rows}, {r["id"]: set(r[f"allowed_{axis}"] or []) for r in rows}
    want = {v: t * len(rows) for v, t in targets.items()}
    moved: dict[str, str] = {}
    for _ in range(10 * len(rows)):
        have = Counter(value.values())
        need = {v: want[v] - have[v] for v in want if want[v] - have[v] >= max(1.0, tolerance * len(rows))}
        best = None
        for v, lack in need.items():
            able = [i for i in value if v in allowed[i] and value[i] != v and have[value[i]] - want.get(value[i], 0) >= 1]
            if able:
                donor = min(able, key=lambda i: (-(have[value[i]] - want.get(value[i], 0)), len(allowed[i]), i))
                best = max(best or (0.0, "", ""), (lack / len(able), v, donor))
        if best is None:
            break
        value[best[2]] = moved[best[2]] = best[1]
    return moved
