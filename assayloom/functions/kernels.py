"""Arrow kernels: token statistics, hashed n-gram bits and dictionary bits of texts in one pass, and
scaling of whole vectors.

A text goes to Python once and only numbers come back. Null texts and vectors give null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property, lru_cache
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # CPython's own MD5 takes a third of the time of OpenSSL's for texts as short as a gram
    from _md5 import md5
except ImportError:
    from hashlib import md5

_BREAK, _BYTE_BREAK = re.compile(r"[ \t\n\r\f]+"), re.compile(rb"[ \t\n\r\f]+")
#: Texts whose bytes are looked up together; a byte that no UTF-8 text holds parts them.
SLICE, _APART = 256, b"\xff"


def split_tokens(text: str) -> list[str]:
    return [t for t in _BREAK.split(text) if t]


def split_words(data: bytes) -> list[bytes]:
    """The tokens of a text in UTF-8; ``bytes.split`` also breaks at vertical tabs, which are no break here."""
    return [w for w in _BYTE_BREAK.split(data) if w] if b"\v" in data else data.split()


@lru_cache(64)
def _codes(characters: str) -> np.ndarray:
    return np.frombuffer(characters.encode(), np.uint8).astype(np.intp)


class TextFacts:
    """What the statistics of one text share; each is found when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return split_words(self.data)

    @cached_property
    def distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def lengths(self) -> list[int]:
        if len(self.data) == len(self.text):
            return list(map(len, self.words))
        return [len(w.decode()) for w in self.words]

    @cached_property
    def bytes_counted(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.data, np.uint8), minlength=256)

    def count(self, characters: str) -> int:
        """How many of these ASCII characters the text has."""
        return int(self.bytes_counted[_codes(characters)].sum())

    def share(self, characters: str) -> float:
        return self.count(characters) / len(self.text) if self.text else 0.0


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_PUNCTUATION = "".join(map(chr, (*range(33, 48), *range(58, 65))))
STATISTICS = {
    "n_chars": lambda t: len(t.text),
    "n_tokens": lambda t: len(t.words),
    "n_distinct_tokens": lambda t: t.distinct,
    "distinct_share": lambda t: t.distinct / len(t.words) if t.words else 0.0,
    "mean_token_length": lambda t: sum(t.lengths) / len(t.words) if t.words else 0.0,
    "max_token_length": lambda t: max(t.lengths, default=0),
    "n_lines": lambda t: t.count("\n") + 1,
    "digit_share": lambda t: t.share("0123456789"),
    "upper_share": lambda t: t.share(_LOWER.upper()),
    "space_share": lambda t: t.share(" \t\n\r\f"),
    "punctuation_share": lambda t: t.share(_PUNCTUATION),
    "n_sentences": lambda t: t.count(".!?"),
    "n_commas": lambda t: t.count(","),
    "n_brackets": lambda t: t.count("[](){}"),
    "vowel_share": lambda t: t.share("aeiouAEIOU"),
    "lower_share": lambda t: t.share(_LOWER),
    "min_token_length": lambda t: min(t.lengths, default=0),
    "n_long_tokens": lambda t: sum(n >= 8 for n in t.lengths),
}


_digest = methodcaller("digest")


@lru_cache(1 << 16)
def _word_digest(word: bytes) -> bytes:
    return md5(word).digest()


def gram_bits(text: bytes, radius: int, width: int) -> np.ndarray:
    """Sorted positions of the bits that all 1..(radius+1)-grams of a text in UTF-8 set, by their MD5's first
    40 bits."""
    words, grams = split_words(text), set()
    for n in range(2, radius + 2):
        grams.update(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    made = b"".join([*map(_word_digest, set(words)), *map(_digest, map(md5, grams))])
    row = np.zeros(width, bool)
    row[(np.frombuffer(made, ">u8")[::2] >> np.uint64(24)) % np.uint64(width)] = True
    return np.flatnonzero(row)


class KeyTable:
    """Which keys of a dictionary occur in texts. Keys of one or two bytes are read off tables of all
    bytes and byte pairs, in one pass over many texts; only longer ones are searched for."""

    def __init__(self, keys: Sequence[str | None]):
        self.width = len(keys)
        # Keys by their value as a number; the last place stands for values that are no key.
        self._tables = {n: np.full(256**n, len(keys), np.int64) for n in (1, 2)}
        self._copies: list[tuple[int, int]] = []
        self._longer: list[tuple[int, str]] = []
        self._always: list[int] = []
        for at, key in enumerate(keys):
            data = (key or "").encode()
            if key is None:
                continue
            if not data:
                self._always.append(at)
            elif len(data) > 2:
                self._longer.append((at, key))
            else:
                value = int.from_bytes(data, "big")
                first = int(self._tables[len(data)][value])
                if first < len(keys):
                    self._copies.append((first, at))
                else:
                    self._tables[len(data)][value] = at

    def found(self, texts: Sequence[str]) -> np.ndarray:
        """0/1 per text and key."""
        out = np.zeros((len(texts), self.width + 1), np.uint8)
        parts = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(_APART.join(parts) + _APART, np.uint8)
        owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        out[owner, self._tables[1][data]] = 1
        pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
        out[owner[:-1], self._tables[2][pairs]] = 1
        for at, key in self._longer:
            out[:, at] = [key in t for t in texts]
        for first, at in self._copies:
            out[:, at] = out[:, first]
        out[:, self._always] = 1
        return out[:, :-1]


def _lists(rows: list, kept: list[int], n: int, kind: pa.DataType) -> pa.Array:
    """A list array of ``n`` entries with ``rows`` at ``kept`` and null elsewhere."""
    sizes = np.zeros(n, np.int64)
    sizes[kept] = [len(r) for r in rows]
    missing = np.ones(n, bool)
    missing[kept] = False
    flat = np.concatenate(rows) if rows else np.zeros(0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind), mask=pa.array(missing))


def _sliced(texts: pa.Array, made) -> pa.Array:
    parts = []
    for at in range(0, len(texts), SLICE):
        some = texts.slice(at, SLICE).to_pylist()
        kept = [i for i, t in enumerate(some) if t is not None]
        parts.append(made([some[i] for i in kept], kept, len(some)))
    return pa.concat_arrays(parts)


def text_statistics(text: Column, names: Sequence[str]) -> Column:
    """Array of doubles: the named statistics of each text."""
    wanted = [STATISTICS[n] for n in names]

    def of(texts, kept, n):
        rows = [np.array([f(t) for f in wanted], float) for t in map(TextFacts, texts)]
        return _lists(rows, kept, n, pa.float64())

    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, of)

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(text)


def text_bits(text: Column, radius: int, width: int) -> Column:
    """Array of the sorted positions of the bits that the tokens' n-grams set."""
    def of(texts, kept, n):
        return _lists([gram_bits(t.encode("utf-8", "replace"), radius, width) for t in texts], kept, n, pa.int32())

    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, of)

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def text_keys(text: Column, keys: Sequence[str | None]) -> Column:
    """Array of 0/1 per key of the dictionary."""
    table = KeyTable(keys)

    def of(texts, kept, n):
        return _lists(list(table.found(texts)), kept, n, pa.int32())

    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, of)

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def text_vector(
    text: Column, names: Sequence[str], radius: int, width: int, keys: Sequence[str | None], lower: bool
) -> Column:
    """Struct of the statistics and, as one float array, the dense n-gram bits and dictionary bits."""
    wanted, table = [STATISTICS[n] for n in names], KeyTable(keys)

    def of(texts, kept, n):
        facts = [np.array([f(t) for f in wanted], float) for t in map(TextFacts, texts)]
        source = [t.lower() for t in texts] if lower else texts
        dense = np.zeros((len(source), width + table.width), np.float32)
        for row, t in zip(dense, source):
            row[gram_bits(t.encode("utf-8", "replace"), radius, width)] = 1
        dense[:, width:] = table.found(source)
        return pa.StructArray.from_arrays(
            [_lists(facts, kept, n, pa.float64()), _lists(list(dense), kept, n, pa.float32())],
            ["statistics", "dense"])

    def run(texts: pa.Array) -> pa.Array:
        return _sliced(texts, of)

    made = T.StructType.fromDDL("statistics array<double>, dense array<float>")
    return F.arrow_udf(run, made)(text)


def linear_value(
    vector: Column, width: int, kept: Sequence[int], centres: Sequence[float], divisors: Sequence[float],
    weights: Sequence[float], intercept: float,
) -> Column:
    """The line's value for the scaled entries at ``kept``; null for a null vector. A vector of another width, or
    with a null entry, is an error."""
    kept, centre, divisor = np.array(kept, int), np.array(centres, float), np.array(divisors, float)
    slopes = np.array(weights, float)

    def run(vectors: pa.Array) -> pa.Array:
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        made = np.zeros(len(vectors))
        flat = vectors.drop_null().flatten()
        if flat.null_count:
            raise ValueError("a vector has a null entry")
        values = flat.to_numpy(zero_copy_only=False).reshape(int(valid.sum()), width)
        at = np.flatnonzero(valid)
        for i in range(0, len(at), 1024):
            some = values[i:i + 1024, kept].astype(float)
            made[at[i:i + 1024]] = ((some - centre) / divisor) @ slopes + intercept
        return pa.array(made, mask=~valid)

    return F.arrow_udf(run, T.DoubleType())(vector)


def scaled_vector(vector: Column, centres: Sequence[float], divisors: Sequence[float]) -> Column:
    """(x - centre) / divisor for each position; an entry that is null stays null. A vector of another
    width is an error."""
    centre, divisor = np.array(centres, float), np.array(divisors, float)

    def run(vectors: pa.Array) -> pa.Array:
        kept = vectors.drop_null()
        flat = kept.flatten().cast(pa.float64())
        values = flat.to_numpy(zero_copy_only=False).reshape(len(kept), len(centre))
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        made = pa.array(((values - centre) / divisor).ravel(), mask=missing if missing.any() else None)
        sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), len(centre), 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, made, mask=vectors.is_null())

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(vector)
