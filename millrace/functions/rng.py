"""A counter-based form of the mulberry32 generator: draw k of a seed as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2**32, in halves of 16 bits."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftrightunsigned(a, 16)
    b_low = b.bitwiseAND(0xFFFF)
    cross = (high * b_low + low * F.shiftrightunsigned(b, 16)).bitwiseAND(0xFFFF)
    return (low * b_low + cross * 65536).bitwiseAND(MASK)


def bits(seed: Column, k: Column) -> Column:
    """The k-th 32 bits (k from 1) of the generator that starts at seed.

    Each step is worked out once: nested plainly, the expression would double
    with every use.
    """
    def first(t: Column) -> Column:
        return _times(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))

    def second(x: Column) -> Column:
        y = x + _times(x.bitwiseXOR(F.shiftrightunsigned(x, 7)), x.bitwiseOR(F.lit(61).cast("long")))
        return x.bitwiseXOR(y.bitwiseAND(MASK))

    t = (seed.cast("long").bitwiseAND(MASK) + _times(k.cast("long").bitwiseAND(MASK), F.lit(STEP).cast("long"))).bitwiseAND(MASK)
    return let(let(let(t, first), second), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)))


def draw(seed: Column, k: Column) -> Column:
    """The k-th number in [0, 1)."""
    return bits(seed, k) / F.lit(4294967296.0)


def prompt_mode(seed: Column, row: Column) -> Column:
    """full for 8 rows in 10, short for 1.5, else none: the first draw of seed XOR row."""
    r = draw(seed.cast("long").bitwiseXOR(row.cast("long")), F.lit(1))
    return F.when(r < 0.8, "full").when(r < 0.95, "short").otherwise("none")
