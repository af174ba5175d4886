"""Unsigned 64-bit arithmetic and bitmaps as column expressions.

A 64-bit value travels as a BIGINT with the same bits. Equality, distinct, bit operations and
counts of bits need no care; order does (``unsigned_key``), and so do products and sums, which
overflow under ANSI mode: ``mul64`` and ``add64`` work on 32-bit halves and never do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF
SIGN = -(1 << 63)


def signed(x: int) -> int:
    """The BIGINT with the bits of an unsigned integer."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def bits(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def _halves(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(bits(LOW)), 32).bitwiseOR(low.bitwiseAND(bits(LOW)))


def add64(a: Column, b: Column) -> Column:
    """a + b mod 2^64."""
    low = a.bitwiseAND(bits(LOW)) + b.bitwiseAND(bits(LOW))
    return _halves(shr(a, 32) + shr(b, 32) + shr(low, 32), low)


def mul64(a: Column, factor: int) -> Column:
    """a * factor mod 2^64: 32-bit halves of a times 16-bit parts of the constant, no product above 2^48."""
    c = [(factor >> (16 * i)) & 0xFFFF for i in range(4)]
    low, high = a.bitwiseAND(bits(LOW)), shr(a, 32)
    first, second = low * F.lit(c[0]).cast("long"), low * F.lit(c[1]).cast("long")
    below = first.bitwiseAND(bits(LOW)) + F.shiftleft(second.bitwiseAND(bits(0xFFFF)), 16)
    top = low * F.lit(c[3]).cast("long") + high * F.lit(c[1]).cast("long")
    above = shr(first, 32) + shr(second, 16) + shr(below, 32) + low * F.lit(c[2]).cast("long") + high * F.lit(c[0]).cast("long") + F.shiftleft(top.bitwiseAND(bits(0xFFFF)), 16)
    return _halves(above, below)


def xorshift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(shr(x, n))


def rotl(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(shr(x, 64 - n))


def unsigned_key(x: Column) -> Column:
    """Sorts and compares as the unsigned value does."""
    return x.bitwiseXOR(bits(1 << 63))


def byte_swapped(x: Column) -> Column:
    for n, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(bits(mask)), n).bitwiseOR(shr(x, n).bitwiseAND(bits(mask)))
    return F.shiftleft(x, 32).bitwiseOR(shr(x, 32))


def hex16(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def words_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, hex16), "")


def low32(x: Column) -> Column:
    return x.bitwiseAND(bits(LOW))


def high32(x: Column) -> Column:
    return shr(x, 32)


def words_needed(n_colors: int) -> int:
    return max(1, -(-n_colors // 64))


def popcount(words: Column) -> Column:
    return F.aggregate(F.transform(words, F.bit_count), F.lit(0), lambda a, b: a + b)


def has_color(words: Column, color: int) -> Column:
    return F.getbit(F.element_at(words, color // 64 + 1), F.lit(color % 64)) == 1


def to_list(words: Column, n_colors: int) -> Column:
    """Ascending color ids of a bitmap. Colors of word i are its set bits plus 64 i."""
    none = F.array().cast("array<int>")
    in_word = F.transform(words, lambda w, i: F.when(w == 0, none).otherwise(_ids(w, i)))
    return F.filter(F.flatten(in_word), lambda c: c < n_colors)


def _ids(word: Column, i: Column) -> Column:
    """Colors of word i."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", word, b) == 1), lambda b: b + i * 64)


NONZERO = "array<struct<i:int,w:bigint>>"
"""Words that are not 0, with their places, in their order: a bitmap as large as what is set in it, however many
colors there are. The functions below want a column of it rather than an expression: they look at neighbours."""


def nonzero(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda e: e["w"] != 0)


def _gap(some: Column, e: Column, k: Column) -> Column:
    """How many words that are 0 stand before e, the entry k from 0."""
    return e["i"] - F.when(k == 0, F.lit(-1)).otherwise(F.element_at(some, F.greatest(k, F.lit(1)))["i"]) - 1


def _tail(some: Column, n_words: int) -> Column:
    return F.lit(n_words - 1) - F.coalesce(F.try_element_at(some, F.lit(-1))["i"], F.lit(-1))


def nonzero_words(some: Column, n_words: int) -> Column:
    """All words."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    return F.concat(F.flatten(F.transform(some, lambda e, k: F.concat(zeros(_gap(some, e, k)), F.array(e["w"])))), zeros(_tail(some, n_words)))


def nonzero_hex(some: Column, n_words: int) -> Column:
    """words_hex of all words."""
    zeros = lambda n: F.repeat(F.lit("0"), n * 16)
    return F.concat(F.array_join(F.transform(some, lambda e, k: F.concat(zeros(_gap(some, e, k)), hex16(e["w"]))), ""), zeros(_tail(some, n_words)))


def nonzero_list(some: Column, n_colors: int) -> Column:
    """Ascending color ids, as to_list."""
    return F.filter(F.flatten(F.transform(some, lambda e: _ids(e["w"], e["i"]))), lambda c: c < n_colors)


def nonzero_popcount(some: Column) -> Column:
    return F.aggregate(some, F.lit(0), lambda a, e: a + F.bit_count(e["w"]))


def from_list(colors: Column, n_colors: int) -> Column:
    """The bitmap words of color ids."""
    one = F.lit(1).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(words_needed(n_colors) - 1)),
        lambda w: F.aggregate(F.filter(colors, lambda c: F.floor(c / 64) == w), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", one, (c % 64).cast("int")))),
    )


def bits_needed(x: int) -> int:
    """Bits of the largest value x, as fields are wide: 8, 16, 32 or 64."""
    return next(n for n in (8, 16, 32, 64) if x < 1 << n)


class SparseLayout:
    """How a list of colors is packed in 64-bit words, and up to which length it is.

    Fields of ``width`` bits, the first one in the highest bits: the count, then the ids in
    ascending order; unused fields are 0. A set is sparse if it has at most ``threshold`` colors.
    ``parts``: the color counts of the two inputs that were merged last, whose words add up.
    """

    def __init__(self, n_colors: int, parts: tuple[int, int] | None = None):
        self.n_colors = n_colors
        self.width = bits_needed(n_colors - 1)
        self.per_word = 64 // self.width
        a, b = parts or (n_colors, 0)
        self.words = -(-a // 64) + -(-b // 64)
        self.threshold = (self.words - 1) * self.per_word - 1

    @property
    def split(self) -> bool:
        """Up to 64 colors there is one dense word and nothing to split."""
        return self.n_colors > 64


def sparse_pack(colors: Column, layout: SparseLayout) -> Column:
    """The packed words of an ascending list of color ids."""
    fields = F.concat(F.array(F.size(colors).cast("long")), F.transform(colors, lambda c: c.cast("long")))
    g, w = layout.per_word, layout.width

    def word(i: Column) -> Column:
        part = F.slice(fields, i * g + 1, g)
        return F.aggregate(
            F.transform(part, lambda f, s: F.call_function("shiftleft", f, ((F.lit(g - 1) - s) * w).cast("int"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)
        )

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(colors) / g).cast("int")), word)


def sparse_unpack(words: Column, layout: SparseLayout) -> Column:
    """The color ids of packed words."""
    g, w = layout.per_word, layout.width
    mask = bits((1 << w) - 1)
    fields = F.flatten(F.transform(words, lambda x: F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda s: F.call_function("shiftrightunsigned", x, ((F.lit(g - 1) - s) * w).cast("int")).bitwiseAND(mask))))
    return F.transform(F.slice(fields, F.lit(2), F.element_at(fields, 1).cast("int")), lambda c: c.cast("int"))
