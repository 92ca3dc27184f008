"""Feature vectors over text keys, from ordered registries.

A vector is named descriptors + hashed n-gram bits + dictionary bits + pattern columns. All of
it is projection, without a shuffle. Registered descriptors, bits and dictionary come from one Arrow
kernel; patterns, and descriptors given as columns, are Spark expressions. Bits stay sparse (sorted
positions) until a dense vector is asked for.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.kernels import text_bits, text_keys, text_statistics, text_vector
from assayloom.functions.numeric import default_on_error, finite_or_zero
from assayloom.functions.text import let, pattern_count, pattern_flag, tokens
from assayloom.operators.curate import not_blank
from assayloom.settings import DICTIONARY_BITS, HASH_BITS, HASH_RADIUS

#: A statistic of the kernel by its name, or a function of the columns (text, tokens) to a number.
Descriptor = str | Callable[[Column, Column], Column]

DESCRIPTORS: dict[str, Descriptor] = {name: name for name in (
    "n_chars", "n_tokens", "n_distinct_tokens", "distinct_share", "mean_token_length",
    "max_token_length", "n_lines", "digit_share", "upper_share", "space_share", "punctuation_share",
)}

# Seven more, for the wider variant of the vector.
WIDE_DESCRIPTORS: dict[str, Descriptor] = DESCRIPTORS | {name: name for name in (
    "n_sentences", "n_commas", "n_brackets", "vowel_share", "lower_share", "min_token_length",
    "n_long_tokens",
)}


def default_dictionary(size: int = DICTIONARY_BITS) -> list[str | None]:
    """Reserved position 0, letters, digits, punctuation marks, then vowel-consonant pairs."""
    vowels = "aeiou"
    singles = [*string.ascii_lowercase, *string.digits, *"!\"#$%&'()*+,-./:;<=>?@[]_"]
    pairs = [v + c for v in vowels for c in string.ascii_lowercase if c not in vowels]
    entries: list[str | None] = [None, *singles, *pairs]
    if len(entries) < size:
        raise ValueError(f"the default dictionary has only {len(entries)} entries")
    return entries[:size]


@dataclass(frozen=True)
class Pattern:
    """A named regular expression; ``count`` columns hold occurrences, others hold 0 or 1."""

    name: str
    regex: str | None
    count: bool = False

    def column(self, text: Column) -> Column:
        made = pattern_count if self.count else pattern_flag
        return made(text, self.regex)


# --- Fixed values: pattern columns, in vector order ---------------------------
# Names of the six pattern columns; the expressions match the line notation as plain text.
PATTERNS = (
    Pattern("HasIndole", r"c1cc2c\(cc1\)\[nH\]c2"),
    Pattern("HasTryptamine", r"CCN\(CC\)CCC1=CNC2=CC=CC=C12"),
    Pattern("HasPhenethylamine", r"NCCc1ccc\(O\)cc1"),
    Pattern("MethoxyCount", r"CO", count=True),
    Pattern("HalogenCount", r"F|Cl|Br|I", count=True),
    Pattern("HasNNDimethyl", r"N\(C\)C"),
)
# Per-target scaffold columns of the wider variant.
SCAFFOLDS = (
    Pattern("DAT_Phenylethylamine", r"NCCc1ccccc1"),
    Pattern("5HT2A_Indole", r"c1cc2c\(cc1\)\[nH\]c2"),
    Pattern("CB1_Dibenzopyran", r"c1cc2c\(cc1\)Cc3ccccc3C2"),
    Pattern("CB2_Dibenzopyran", r"c1cc2c\(cc1\)Cc3ccccc3C2"),
    Pattern("MuOpioid_Morphinan",
            r"C1CC\[C@\]23c4ccc\(O\)cc4O\[C@H\]2\[C@@H\]\(O\)C=C\[C@H\]3\[C@H\]1C5"),
    Pattern("DeltaOpioid_Enkephalin", r"CC\(C\)C\[C@H\]\(N\)C\(=O\)NCC\(=O\)N"),
    Pattern("KappaOpioid_Cyclohexanecarboxamide", r"C1CCCCC1C\(=O\)N"),
)


@dataclass(frozen=True)
class FeatureSet:
    """Ordered registries that fix the vector layout; the version is part of every store key."""

    descriptors: dict[str, Descriptor] = field(default_factory=lambda: dict(DESCRIPTORS))
    hash_bits: int = HASH_BITS
    radius: int = HASH_RADIUS
    dictionary: tuple[str | None, ...] = field(default_factory=lambda: tuple(default_dictionary()))
    patterns: tuple[Pattern, ...] = PATTERNS
    lower: bool = True
    label: str = "base"
    udfs: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    @classmethod
    def wide(cls) -> FeatureSet:
        """18 descriptors and the per-target scaffold columns."""
        return cls(
            descriptors=dict(WIDE_DESCRIPTORS), patterns=PATTERNS + SCAFFOLDS, label="wide"
        )

    def with_feature(self, name: str, descriptor: Descriptor) -> FeatureSet:
        """A set with one more descriptor at the end of the descriptor block."""
        if name in self.descriptors:
            raise ValueError(f"feature {name} is already registered")
        return replace(self, descriptors={**self.descriptors, name: descriptor})

    def with_udf(self, name: str, function: Callable[[Column], Column]) -> FeatureSet:
        """A set with one more number per text from a user's (pandas) UDF, after the descriptors.

        Give the set a new ``label`` when the code behind a name changes.
        """
        if name in self.descriptors or name in self.udfs:
            raise ValueError(f"feature {name} is already registered")
        return replace(self, udfs={**self.udfs, name: function})

    def with_pattern(self, pattern: Pattern) -> FeatureSet:
        return replace(self, patterns=(*self.patterns, pattern))

    @property
    def names(self) -> list[str]:
        return [
            *self.descriptors,
            *self.udfs,
            *[f"ECFP4_{i}" for i in range(self.hash_bits)],
            *[f"MACCS_{i}" for i in range(len(self.dictionary))],
            *[p.name for p in self.patterns],
        ]

    @property
    def width(self) -> int:
        return len(self.names)

    @property
    def version(self) -> str:
        parts = [self.label, *self.descriptors, *self.udfs, self.hash_bits, self.radius, self.dictionary,
                 [(p.name, p.regex, p.count) for p in self.patterns], self.lower]
        return hashlib.md5(repr(parts).encode()).hexdigest()[:8]


def feature_names(spark: SparkSession, features: FeatureSet) -> DataFrame:
    """(pos, name), aligned with the assembled vector; bit names come from a sequence."""

    def numbered(prefix: str, n: int) -> Column:
        if n == 0:
            return F.array().cast("array<string>")
        return F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.format_string(f"{prefix}_%d", i)
        )

    names = F.concat(
        F.array(*[F.lit(n) for n in [*features.descriptors, *features.udfs]]).cast("array<string>"),
        numbered("ECFP4", features.hash_bits),
        numbered("MACCS", len(features.dictionary)),
        F.array(*[F.lit(p.name) for p in features.patterns]).cast("array<string>"),
    )
    return spark.range(1).select(F.posexplode(names).alias("pos", "name"))


def _statistics(descriptors: dict[str, Descriptor]) -> list[str]:
    return [d for d in descriptors.values() if isinstance(d, str)]


def _descriptor_array(
    text: Column, descriptors: dict[str, Descriptor], found: Column | None = None
) -> Column:
    """All descriptors as one double array; ``found`` are those of the kernel, if known already."""
    names = _statistics(descriptors)
    if found is None and names:
        found = text_statistics(text, names)
    if len(names) == len(descriptors) and names:
        return found
    own = [d for d in descriptors.values() if not isinstance(d, str)]
    # Bound once; the kernel cannot run inside a lambda, so its numbers are put between outside.
    made = let(tokens(text), lambda toks: F.array(*[
        finite_or_zero(default_on_error(f(text, toks).cast("double"))) for f in own
    ]).cast("array<double>"))
    places, numbers = {}, {True: 0, False: 0}
    for name, d in descriptors.items():
        kind = isinstance(d, str)
        places[name] = F.get(found if kind else made, F.lit(numbers[kind]))
        numbers[kind] += 1
    return F.array(*places.values()).cast("array<double>")


def text_descriptors(
    df: DataFrame, text: str, descriptors: dict[str, Descriptor] | None = None
) -> DataFrame:
    """Adds the named descriptors as double columns; failures and non-finite values are 0."""
    descriptors = descriptors or DESCRIPTORS
    made = df.withColumn("_desc", _descriptor_array(F.col(text), descriptors))
    return made.select(
        *df.columns, *[F.get("_desc", F.lit(i)).alias(n) for i, n in enumerate(descriptors)]
    )


def hashed_fingerprint(
    df: DataFrame, text: str, radius: int = HASH_RADIUS, width: int = HASH_BITS, out: str = "bits"
) -> DataFrame:
    """Adds the sorted set positions of the hashed 1..(radius+1)-grams."""
    return df.withColumn(out, text_bits(F.lower(F.col(text)), radius, width))


def dictionary_keys(
    df: DataFrame, text: str, keys: Sequence[str | None] | None = None, out: str = "keys"
) -> DataFrame:
    """Adds 0/1 per dictionary entry, looked up in the lower-cased text."""
    return df.withColumn(out, text_keys(F.lower(F.col(text)), keys or default_dictionary()))


def pattern_columns(df: DataFrame, text: str, patterns: Sequence[Pattern]) -> DataFrame:
    return df.withColumns({p.name: p.column(F.col(text)) for p in patterns})


def sparse_features(df: DataFrame, text: str, features: FeatureSet) -> DataFrame:
    """Adds the feature groups unassembled: descriptors, set bits, dictionary, patterns."""
    source = F.lower(F.col(text)) if features.lower else F.col(text)
    return df.withColumns({
        "descriptors": _descriptor_array(F.col(text), features.descriptors),
        "bits": text_bits(source, features.radius, features.hash_bits),
        "keys": text_keys(source, features.dictionary),
        "patterns": F.array(*[p.column(F.col(text)) for p in features.patterns]).cast("array<int>"),
    })


def vector_column(text: Column, features: FeatureSet) -> Column:
    """The dense float vector in registry order."""
    made = text_vector(text, _statistics(features.descriptors), features.radius, features.hash_bits,
                       features.dictionary, features.lower)
    groups = [
        _descriptor_array(text, features.descriptors, made["statistics"]),
        F.array(*[
            finite_or_zero(default_on_error(f(text).cast("double"))) for f in features.udfs.values()
        ]),
        made["dense"],
        F.array(*[p.column(text) for p in features.patterns]),
    ]
    return F.concat(*[g.cast("array<float>") for g in groups])


def assemble_features(
    df: DataFrame,
    text: str,
    features: FeatureSet | None = None,
    out: str = "features",
    valid: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds the dense float vector in registry order; an invalid text gives null."""
    check = (valid or not_blank)(F.col(text))
    return df.withColumn(out, F.when(check, vector_column(F.col(text), features or FeatureSet())))


def descriptor_unpivot(
    df: DataFrame, vector: str, names: Sequence[str], keep: Sequence[str], digits: int = 2
) -> DataFrame:
    """The first ``len(names)`` vector entries as (keep..., pos, name, value, shown) rows."""
    entries = F.zip_with(
        F.slice(vector, 1, len(names)),
        F.array(*[F.lit(n) for n in names]),
        lambda x, n: F.struct(n.alias("name"), x.cast("double").alias("value")),
    )
    return (
        df.select(*keep, F.posexplode(entries).alias("pos", "_e"))
        .select(*keep, "pos", "_e.name", "_e.value")
        .withColumn("shown", F.format_string(f"%.{digits}f", "value"))
    )
