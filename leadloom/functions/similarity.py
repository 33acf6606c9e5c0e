"""Similarity scores from 0 to 100 as column expressions (longest common subsequence based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 62


def _letters(c: Column) -> Column:
    """Characters of a text; an empty array for the empty text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def _lcs_bits(short: Column, long: Column) -> Column:
    """Bit-parallel length of the longest common subsequence; `short` has at most 62 characters."""
    size = F.size(short)
    full = F.aggregate(short, F.lit(0).cast("long"), lambda acc, _: acc * 2 + 1)  # one bit per letter

    def mask(letter: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("bit"))
        return F.aggregate(
            short, start,
            lambda s, x: F.struct(
                F.when(x == letter, s["bits"].bitwiseOR(s["bit"])).otherwise(s["bits"]).alias("bits"),
                (s["bit"] * 2).alias("bit"),
            ),
            lambda s: s["bits"],
        )

    def step(v: Column, m: Column) -> Column:
        both = v.bitwiseAND(m)
        return (v + both).bitwiseOR(v - both).bitwiseAND(full)

    rest = F.aggregate(F.transform(long, mask), full, step)
    return size - F.bit_count(rest).cast("int")


def _lcs_words(short: Column, long: Column) -> Column:
    """The same for any length: the bits of `short` lie in several words, and a sum hands its carry to the next one."""
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(short) - 1) / F.lit(_BITS)).cast("int")), lambda i: F.slice(short, i * _BITS + 1, F.lit(_BITS)))
    full = F.transform(words, lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda acc, _: acc * 2 + 1))

    def masks(letter: Column) -> Column:
        """Places of a letter, word by word; the last letter of a word has its highest bit."""
        return F.transform(words, lambda w: F.aggregate(F.reverse(w), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x == letter, 1).otherwise(0)))

    def step(v: Column, m: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("v"), F.lit(0).cast("long").alias("carry"))

        def word(s: Column, x: Column) -> Column:
            both = x["v"].bitwiseAND(x["m"])
            total = x["v"] + both + s["carry"]
            return F.struct(
                F.concat(s["v"], F.array(total.bitwiseOR(x["v"] - both).bitwiseAND(x["full"]))).alias("v"),
                F.when(total > (1 << _BITS) - 1, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("carry"))

        together = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.struct(F.get(v, i).alias("v"), F.get(m, i).alias("m"), F.get(full, i).alias("full")))
        return F.aggregate(together, start, word, lambda s: s["v"])

    rest = F.aggregate(F.transform(long, masks), full, step)
    return F.size(short) - F.aggregate(rest, F.lit(0), lambda n, v: n + F.bit_count(v).cast("int"))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts."""
    x, y = _letters(a), _letters(b)
    shorter = F.when(F.size(x) <= F.size(y), x).otherwise(y)
    longer = F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0))
        .when(F.size(shorter) <= _BITS, _lcs_bits(shorter, longer))
        .otherwise(_lcs_words(shorter, longer))
    )


def tokens(c: Column) -> Column:
    """Sorted distinct words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two token arrays (see `tokens`): shared words count once, the rest by subsequence."""
    shared = F.array_join(F.array_intersect(a, b), " ")
    rest_a, rest_b = F.array_join(F.array_except(a, b), " "), F.array_join(F.array_except(b, a), " ")
    ls, la, lb = F.length(shared), F.length(rest_a), F.length(rest_b)
    gap = F.when(ls > 0, 1).otherwise(0)
    distance = la + lb - 2 * lcs(rest_a, rest_b)

    def similarity(d: Column, total: Column) -> Column:
        return F.when(total > 0, F.lit(100.0) * (total - d) / total).otherwise(F.lit(100.0))

    mixed = similarity(distance, 2 * (ls + gap) + la + lb)
    with_a = similarity(gap + la, 2 * ls + gap + la)
    with_b = similarity(gap + lb, 2 * ls + gap + lb)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when((ls > 0) & ((la == 0) | (lb == 0)), F.lit(100.0))
        .when(ls == 0, mixed)
        .otherwise(F.greatest(mixed, with_a, with_b))
    )


def token_set_floor(a: Column, b: Column) -> Column:
    """Lower limit of `token_set_ratio` from the lengths of shared and other words alone."""
    shared = F.length(F.array_join(F.array_intersect(a, b), " "))
    rest_a, rest_b = (F.length(F.array_join(F.array_except(x, y), " ")) for x, y in ((a, b), (b, a)))
    least = lambda rest: F.lit(200.0) * shared / (2 * shared + 1 + rest)
    return F.when(shared > 0, F.greatest(least(rest_a), least(rest_b))).otherwise(F.lit(0.0))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best similarity of the shorter text against same-length windows, prefixes and suffixes of the
    longer; of two texts of equal length either may be the longer."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    m, n = F.length(short), F.length(long)

    def best(piece_of: Column, whole: Column) -> Column:
        def window(i: Column) -> Column:
            begin = F.greatest(i, F.lit(0))
            size = F.least(i + m, n) - begin
            return F.lit(200.0) * lcs(whole, piece_of.substr(begin + 1, size)) / (m + size)

        return F.array_max(F.transform(F.sequence(F.lit(1) - m, n - 1), window))

    return (
        F.when((m == 0) & (n == 0), F.lit(100.0)).when(m == 0, F.lit(0.0))
        .when(m == n, F.greatest(best(long, short), best(short, long))).otherwise(best(long, short))
    )
