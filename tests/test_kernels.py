"""Arrow kernels against plain searches."""

import random

import numpy as np
from pyspark.sql import functions as F

from assayloom.functions.kernels import SLICE, KeyTable, split_tokens, text_keys, text_statistics
from assayloom.functions.text import tokens
from assayloom.operators.featurise import WIDE_DESCRIPTORS, default_dictionary


def some_texts(n):
    rng = random.Random(6)
    parts = ["a", "e", "b", " ", ".", "é", "日本", "ß", "\n", "xyz", "é" * 3, "İ", "1"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(n)]


def test_keys_equal_substring_search(spark):
    keys = [None, "a", "ab", "é", "日本", "xyz", "ba", "a", "", "éé", "\n", "ß", "11", "zzz"]
    texts = some_texts(2 * SLICE + 3)
    want = [[0 if k is None else int(k in t) for k in keys] for t in texts]
    assert KeyTable(keys).found(texts).tolist() == want
    assert KeyTable([]).found(["x"]).tolist() == [[]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.k for r in rows.select("i", text_keys(F.col("t"), keys).alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] is None


def test_pairs_do_not_cross_texts():
    assert KeyTable(["ab"]).found(["a", "b", "ab"]).tolist() == [[0], [0], [1]]


def test_default_dictionary_is_read_off_tables():
    assert all(k is None or len(k.encode()) <= 2 for k in default_dictionary())


def test_statistics_equal_columns(spark):
    """The kernel's tokens and counts against Spark's own expressions."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*some_texts(300), "", None])], "i int, t string")
    t, toks = F.col("t"), tokens(F.col("t"))
    made = rows.select("t", text_statistics(t, list(WIDE_DESCRIPTORS)).alias("s"), toks.alias("toks"),
                       F.length(t).alias("n"), F.regexp_count(t, F.lit("[aeiouAEIOU]")).alias("vowels"),
                       F.size(F.array_distinct(toks)).alias("distinct")).collect()
    for r in made:
        if r.t is None:
            assert r.s is None
            continue
        got = dict(zip(WIDE_DESCRIPTORS, r.s))
        assert split_tokens(r.t) == r.toks
        assert (got["n_chars"], got["n_tokens"], got["n_distinct_tokens"]) == (r.n, len(r.toks), r.distinct)
        assert got["vowel_share"] == (r.vowels / r.n if r.n else 0.0)
        sizes = [len(x) for x in r.toks]
        assert got["min_token_length"] == min(sizes, default=0) and got["n_long_tokens"] == sum(x >= 8 for x in sizes)
        assert np.isclose(got["mean_token_length"], np.mean(sizes) if sizes else 0.0)


def test_grams_are_hashed_without_the_set_up_of_long_messages():
    import hashlib
    import time

    from assayloom.functions import kernels

    grams = [f"one{i} two{i * 7} three".encode() for i in range(20_000)]
    took = {}
    for name, md5 in (("kernel", kernels.md5), ("hashlib", hashlib.md5)):
        best = []
        for _ in range(3):
            start = time.perf_counter()
            made = [md5(g).digest() for g in grams]
            best.append(time.perf_counter() - start)
        took[name] = min(best)
        assert made == [hashlib.md5(g).digest() for g in grams]
    assert took["kernel"] < 0.8 * took["hashlib"]


def test_words_of_bytes_are_the_tokens(spark):
    from assayloom.functions.kernels import TextFacts, split_words

    for text in [*some_texts(200), "a\vb c\x1cd\x85e f\tg", "\v", " \f", ""]:
        assert [w.decode() for w in split_words(text.encode())] == split_tokens(text)
        assert TextFacts(text).lengths == [len(t) for t in split_tokens(text)]
