"""Rupiah amounts in chat: finding, tracing, excusing and rendering them.

Everything is a Column expression.  Matches of each family of surfaces come
with their places from one split by the family's pattern; families are tried in
order of priority, and a match that overlaps text already claimed is dropped.
Places count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, js_round

# Money slang and what it is worth.
SLANG = {
    "cepek": 100,
    "gopek": 500,
    "seceng": 1_000,
    "ceceng": 1_000,
    "noceng": 2_000,
    "goceng": 5_000,
    "ceban": 10_000,
    "goban": 50_000,
    "cetiao": 1_000_000,
    "gotiao": 5_000_000,
    "gocap": 50_000,
}
# Javanese numerals that stand before "ewu" (thousand).
JAVANESE = {"selawe": 25, "seket": 50, "rong": 2, "telung": 3, "patang": 4, "limang": 5, "nem": 6, "pitung": 7, "wolung": 8, "sangang": 9, "sepuluh": 10}
# Amounts in words.
SPELLED = {"setengah juta": 500_000, "seperempat juta": 250_000, "setengah jt": 500_000, "sejuta": 1_000_000, "semiliar": 1_000_000_000}
# Multipliers after a number, longer ones first.
SUFFIXES = {"miliar": 1_000_000_000, "milyar": 1_000_000_000, "juta": 1_000_000, "jute": 1_000_000, "ribu": 1_000, "rebu": 1_000, "jt": 1_000_000, "rb": 1_000, "k": 1_000}
# Units that make the number before them a quantity.
UNITS = [
    "kg", "gr", "gram", "ltr", "liter", "l", "ml", "lusin", "rim", "tusuk", "pcs", "pc",
    "buah", "biji", "bungkus", "porsi", "piring", "gelas", "botol", "kaleng", "sachet",
    "orang", "anak", "ekor", "lembar", "pack", "pak", "box", "dus", "kardus", "meter", "m",
]
# Cues that excuse an amount that is named but not booked.
CUES = {
    "koreksi": "eh|bukan|maksudnya|maksud|salah|ralat|koreksi|revisi|typo",
    "future": "besok|nanti|rencana|rencananya|mau|akan|minggu depan|bulan depan|lusa|sisanya|lunasin",
    "batal": "batal|cancel|gak jadi|ga jadi|nggak jadi|engga jadi|jadinya gak|refund gagal",
    "share": "total|patungan|bagian|share|bareng|split|urunan|masing-masing",
    "diskon": "diskon|disc|potongan|jadi cuma|net|setelah potong|harga asli",
}
# Bands of amounts, from (inclusive) to (exclusive).
BANDS = {"receh": (100, 5_000), "kecil": (5_000, 50_000), "sedang": (50_000, 500_000), "besar": (500_000, 5_000_000), "jumbo": (5_000_000, 100_000_000)}
BARE_FLOOR = 100
EXCUSE_REACH = 45
DISTINCT_MIN, DISTINCT_STEP, DISTINCT_MAX_DF = 10_000, 1_000, 2

#: ASCII word boundaries, whatever the engine thinks of other letters.
B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ATOM = "struct<start:int,end:int,raw:string,value:bigint,kind:string>"


def nothing() -> Column:
    return F.array().cast(f"array<{ATOM}>")


def spans(text: Column, pattern: str) -> Column:
    """start, end and raw text of every match, left to right."""
    raws = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(F.split(text, pattern, -1), raws, lambda gap, raw: F.struct(gap.alias("gap"), raw.alias("raw")))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["raw"])
        one = F.struct(start.alias("start"), end.alias("end"), p["raw"].alias("raw"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(p["raw"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,raw:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, add)["out"]).otherwise(none)


def number(s: Column) -> tuple[Column, Column]:
    """Value of a number as written in Indonesian, and whether its dots could be either kind."""
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    grouped = dot & ~comma & (F.length(F.element_at(F.split(s, r"\.", -1), -1)) == 3)
    plain = F.replace(s, F.lit("."))
    first_comma = F.regexp_replace(s, "^([^,]*),", "$1.")
    text = F.when(grouped, plain).when(comma & dot, F.regexp_replace(plain, "^([^,]*),", "$1.")).when(comma, first_comma).otherwise(s)
    return F.when(text.rlike(r"^(\d+\.?\d*|\.\d+)$"), text.try_cast("double")), grouped


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def amount_atoms(text: Column) -> Column:
    """Every amount in the text, left to right: start, end, raw, value, kind.

    Kinds: spelled, slang, suffix, suspect-dot-suffix, rp, dot, bare.  A bare
    whole number under 100, or before a unit, claims its place but is no amount.
    Numbers too odd to read have a null value.
    """
    javanese = f"(?i){B0}(?:(?:{'|'.join(JAVANESE)}){SPACE}+ewu|sewu){B1}"
    spelled = f"(?i){B0}(?:{'|'.join(s.replace(' ', SPACE + '+') for s in SPELLED)}){B1}"
    slang = f"(?i){B0}(?:{'|'.join(SLANG)}){B1}"
    suffix = f"(?i)[0-9][0-9.,]*{SPACE}*(?:{'|'.join(SUFFIXES)}){B1}"
    rp = f"(?i){B0}Rp\\.?{SPACE}*[0-9.,]+"
    dot = f"{B0}[0-9]{{1,3}}(?:\\.[0-9]{{3}})+{B1}"
    bare = f"{B0}[0-9]+{B1}"

    def tagged(pattern, value, kind):
        def atom(s):
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), value(s).cast("long").alias("value"), kind(s).alias("kind"))

        return F.transform(spans(text, pattern), atom)

    def javanese_value(s):
        word = F.regexp_extract(F.lower(s["raw"]), "^([a-z]+)", 1)
        return F.when(word == "sewu", 1_000).otherwise(_lookup(JAVANESE, word) * 1_000)

    def spelled_value(s):
        return _lookup(SPELLED, F.regexp_replace(F.lower(s["raw"]), f"{SPACE}+", " "))

    def digits(s):
        return F.regexp_extract(s["raw"], "([0-9.,]+)", 1)

    def suffix_value(s):
        times = _lookup(SUFFIXES, F.regexp_extract(F.lower(s["raw"]), "([a-z]+)$", 1))
        return js_round(number(digits(s))[0] * times)

    def suffix_kind(s):
        return F.when(number(digits(s))[1], "suspect-dot-suffix").otherwise("suffix")

    def rp_value(s):
        return js_round(number(F.regexp_extract(s["raw"], f"(?i)^Rp\\.?{SPACE}*([0-9.,]+)$", 1))[0])

    def bare_kind(s):
        after = F.lower(F.substr(text, s["end"] + 1, F.lit(12)))
        unit = F.regexp_extract(after, f"^{SPACE}*([a-z]+)", 1).isin(UNITS)
        small = F.regexp_replace(s["raw"], "^0+", "").rlike("^[0-9]{0,2}$")
        return F.when(small | unit, "none").otherwise("bare")

    families = [
        tagged(javanese, javanese_value, lambda s: F.lit("spelled")),
        tagged(spelled, spelled_value, lambda s: F.lit("spelled")),
        tagged(slang, lambda s: _lookup(SLANG, F.lower(s["raw"])), lambda s: F.lit("slang")),
        tagged(suffix, suffix_value, suffix_kind),
        tagged(rp, rp_value, lambda s: F.lit("rp")),
        tagged(dot, lambda s: F.replace(s["raw"], F.lit(".")).try_cast("long"), lambda s: F.lit("dot")),
        tagged(bare, lambda s: s["raw"].try_cast("long"), bare_kind),
    ]

    def claim(taken: Column, more: Column) -> Column:
        return F.concat(taken, F.filter(more, lambda m: ~F.exists(taken, lambda t: (m["start"] < t["end"]) & (t["start"] < m["end"]))))

    # one fold over the families in order of priority
    atoms = F.aggregate(F.array(*families), nothing(), claim)
    return F.array_sort(F.filter(atoms, lambda a: a["kind"] != "none"), lambda a, b: a["start"] - b["start"])


def derived(atoms: Column) -> Column:
    """Amounts that follow from atoms (multiples by 2 to 12, then sums and differences of pairs): value and via, first way first."""
    one = F.transform(atoms, lambda a, i: F.transform(F.sequence(F.lit(2), F.lit(12)), lambda q: F.struct((a["value"] * q).alias("value"), F.format_string("%d×%d", a["value"], q).alias("via"))))

    def pairs(a, i):
        rest = F.slice(atoms, i + 2, F.greatest(F.size(atoms), F.lit(1)))
        two = F.transform(rest, lambda b: F.array(F.struct((a["value"] + b["value"]).alias("value"), F.format_string("%d+%d", a["value"], b["value"]).alias("via")), F.struct(F.abs(a["value"] - b["value"]).alias("value"), F.format_string("|%d-%d|", a["value"], b["value"]).alias("via"))))
        return F.filter(F.flatten(two), lambda x: x["value"] > 0)

    two = F.transform(atoms, pairs)
    return F.flatten(F.zip_with(one, two, lambda x, y: F.concat(x, y)))


def trace(value: Column, atoms: Column) -> Column:
    """tier (direct, derived, none) and via of a value: an amount named, one that follows, or neither."""
    direct = F.get(F.filter(atoms, lambda a: a["value"] == value), F.lit(0))["raw"]
    other = F.get(F.filter(derived(atoms), lambda c: c["value"] == value), F.lit(0))["via"]
    return F.struct(F.when(direct.isNotNull(), "direct").when(other.isNotNull(), "derived").otherwise("none").alias("tier"), F.coalesce(direct, other).alias("via"))


def unexcused(text: Column, atoms: Column, consumed: Column) -> Column:
    """Atoms neither consumed nor within reach of a cue that excuses them."""
    cues = "(?i)" + B0 + "(?:" + "|".join(CUES.values()) + ")" + B1

    def near(a):
        start = F.greatest(F.lit(0), a["start"] - EXCUSE_REACH)
        return F.substr(text, start + 1, a["end"] + EXCUSE_REACH - start)

    return F.filter(atoms, lambda a: ~F.array_contains(consumed, a["value"]) & ~near(a).rlike(cues))


def ambiguous(atoms: Column) -> Column:
    return F.exists(atoms, lambda a: a["kind"] == "suspect-dot-suffix")


def lenient_amount(raw: Column) -> Column:
    """The amount in a graded answer: jt, then rb, then k, else all digits; 0 if none."""
    s = F.trim(F.lower(F.coalesce(raw, F.lit(""))))

    def lead(x):
        """The number a text begins with."""
        return F.regexp_extract(x, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")

    jt = F.regexp_extract(s, r"([0-9.,]+)\s*j[tu](?:\s*an)?", 1)
    rb = F.regexp_extract(s, r"([0-9.,]+)\s*r[b]?(?:\s*uan)?", 1)
    k = F.regexp_extract(s, rf"([0-9.,]+)\s*k{B1}", 1)
    one = lambda x: F.regexp_replace(x, "^([^,]*),", "$1.")
    jt_n = lead(one(F.replace(jt, F.lit("."))))
    rb_n = lead(F.when(F.contains(rb, F.lit(".")) & (F.length(rb) > 4), F.replace(rb, F.lit("."))).otherwise(one(rb)))
    k_n = lead(one(k))
    digits = F.coalesce(F.regexp_replace(s, "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))
    return F.when(jt_n.isNotNull(), js_round(jt_n * 1_000_000)).when(rb_n.isNotNull(), js_round(rb_n * 1000)).when(k_n.isNotNull(), js_round(k_n * 1000)).otherwise(digits)


def dotted(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ".")


def _decimal(v: Column, unit: int, places: int) -> Column:
    """v / unit with a comma, no zeros at the end."""
    whole, rest = F.floor(v / unit), v % unit
    frac = F.regexp_replace(F.lpad(F.floor(rest * 10**places / unit).cast("string"), places, "0"), "0+$", "")
    return F.when(rest == 0, whole.cast("string")).otherwise(F.concat(whole.cast("string"), F.lit(","), frac))


def render(v: Column, notation: str) -> Column:
    """An amount as chat would write it; null where the notation can't."""
    if notation == "polos":
        return v.cast("string")
    if notation == "dot_sep":
        return F.when(v >= 1_000, dotted(v))
    if notation == "rp_prefix":
        return F.concat(F.lit("Rp "), dotted(v))
    if notation == "rb_suffix":
        return F.when((v % 1_000 == 0) & (v < 1_000_000), F.concat(F.floor(v / 1_000).cast("string"), F.lit("rb")))
    if notation == "k_suffix":
        return F.when((v % 500 == 0) & (v < 1_000_000), F.concat(_decimal(v, 1_000, 1), F.lit("k")))
    if notation == "jt_suffix":
        return F.when((v >= 1_000_000) & (v % 50_000 == 0), F.concat(_decimal(v, 1_000_000, 2), F.lit("jt")))
    return F.lit(None).cast("string")


NOTATIONS = ["polos", "dot_sep", "rp_prefix", "rb_suffix", "k_suffix", "jt_suffix"]


def band(v: Column) -> Column:
    """The band an amount falls in; null outside all."""
    return reduce(lambda c, kv: c.when((v >= kv[1][0]) & (v < kv[1][1]), kv[0]), BANDS.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def bands_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def distinctive(v: Column, df: Column) -> Column:
    """An amount that marks a text: large, not round, and in few items."""
    return (v >= DISTINCT_MIN) & (v % DISTINCT_STEP != 0) & (F.coalesce(df, F.lit(0)) <= DISTINCT_MAX_DF)
