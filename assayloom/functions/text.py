"""Text column expressions: cleaning, tokens, hashed and dictionary bits, patterns.

An expression used several times is bound with ``let``. Spark writes projections out into each
other when it moves filters, and an array expression inside a lambda would then be computed
again for every element; a bound value is computed once wherever the expression ends up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayloom.settings import HASH_BITS

# Every character that Python counts as white space, written so that Java and RE2 agree.
WHITE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
TOKEN_BREAK = r"[ \t\n\r\f]+"
LINE_BREAK = r"\r\n|\n|\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def iso_timestamp(moment: Column) -> Column:
    """A timestamp as text, to the microsecond."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def content_key(text: Column, version: str | None = None) -> Column:
    """MD5 of the text; with a version, keys of different feature sets never meet."""
    key = F.md5(text)
    return key if version is None else F.concat(key, F.lit(f"-{version}"))


def row_hash(key: Column, seed: int) -> Column:
    """Uniform 32-digit hex string that depends on key and seed only."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: t != "")


def ngrams(toks: Column, n: int) -> Column:
    """Runs of n neighbouring tokens joined by one space."""
    grams = toks
    for k in range(2, n + 1):
        left = F.greatest(F.size(toks) - (k - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), left),
            F.slice(toks, F.lit(k), left),
            lambda g, t: F.concat_ws(" ", g, t),
        )
    return grams


def hashed_bits(toks: Column, radius: int = 2, width: int = HASH_BITS) -> Column:
    """Sorted positions of the bits set by all 1..(radius+1)-grams."""

    def bit(gram: Column) -> Column:
        # Ten hex digits spread evenly over any width.
        return (F.conv(F.substring(F.md5(gram), 1, 10), 16, 10).cast("bigint") % width).cast("int")

    def bits(t: Column) -> Column:
        grams = F.concat(*[ngrams(t, n) for n in range(1, radius + 2)])
        return F.array_sort(F.array_distinct(F.transform(grams, bit)))

    return let(toks, bits)


def dictionary_bits(text: Column, keys: Sequence[str | None]) -> Column:
    """0/1 per dictionary entry; a ``None`` entry is a reserved position that stays 0."""
    if not keys:
        return F.array().cast("array<int>")
    def bit(t: Column, key: str | None) -> Column:
        if key is None:
            return F.lit(0)
        return F.coalesce(F.contains(t, F.lit(key)), F.lit(False)).cast("int")

    return let(text, lambda t: F.array(*[bit(t, k) for k in keys]))


def pattern_flag(text: Column, pattern: str | None) -> Column:
    """1 if the pattern occurs; a pattern that failed to compile (``None``) gives 0."""
    if pattern is None:
        return F.lit(0)
    return F.coalesce(text.rlike(pattern), F.lit(False)).cast("int")


def pattern_count(text: Column, pattern: str | None) -> Column:
    if pattern is None:
        return F.lit(0)
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def dense_bits(bits: Column, width: int) -> Column:
    """0/1 float array of the given width from sorted set positions, in linear time."""
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")

    def spread(b: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(-1)), b), F.lit(1), F.size(b))
        runs = F.zip_with(
            b, before, lambda x, prev: F.concat(F.array_repeat(zero, x - prev - 1), F.array(one))
        )
        last = F.coalesce(F.array_max(b), F.lit(-1))
        return F.flatten(F.concat(runs, F.array(F.array_repeat(zero, F.lit(width - 1) - last))))

    return let(bits, spread)


def bits_from_string(bit_string: Column) -> Column:
    """``'0110'`` to ``[0, 1, 1, 0]``."""
    return F.transform(F.filter(F.split(bit_string, ""), lambda c: c != ""),
                       lambda c: c.cast("int"))


def select_indices(vector: Column, indices: Sequence[int] | None) -> Column:
    """The entries at the given positions, in that order; ``None`` keeps all."""
    if indices is None:
        return vector
    indices = [int(i) for i in indices]
    if not indices:
        return F.slice(vector, 1, 0)
    if any(a >= b for a, b in zip(indices, indices[1:])):
        return F.array(*[F.get(vector, F.lit(i)) for i in indices])
    # Ascending positions: mark the wanted entries and filter by the mark.
    wanted = set(indices)
    marks = F.array(*[F.lit(i in wanted) for i in range(indices[-1] + 1)])
    marked = F.zip_with(vector, marks, lambda x, m: F.struct(x.alias("x"), m.alias("m")))
    return F.transform(F.filter(marked, lambda s: s["m"]), lambda s: s["x"])
