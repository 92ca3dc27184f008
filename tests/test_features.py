import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F

from assayloom.functions.text import bits_from_string, dense_bits, select_indices
from assayloom.operators.featurise import (
    FeatureSet, Pattern, assemble_features, descriptor_unpivot, feature_names, sparse_features,
)
from assayloom.operators.lookup import uncached_keys
from assayloom.sources.stores import (
    clear_features, featurise_with_store, read_features, upsert_features,
)

TEXTS = [
    (1, "CC(=O)OC1=CC=CC=C1C(=O)O"), (2, "one two  three\ntwo one two"), (3, "   "), (4, None),
    (5, "Ébène 12,5 Fluor"), (6, "one"),
]


def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, t string")


def expected_bits(text, radius=2, width=1024):
    toks = [t for t in re.split(r"[ \t\n\r\f]+", text.lower()) if t]
    grams = {" ".join(toks[i:i + n]) for n in range(1, radius + 2) for i in range(len(toks) - n + 1)}
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:10], 16) % width for g in grams})


def test_bits_spread_evenly_over_any_width(spark):
    from assayloom.functions.text import hashed_bits

    words = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: i.cast("string"))
    bits = spark.range(1).select(hashed_bits(words, radius=0, width=3000).alias("b")).first().b
    below = sum(b < 1096 for b in bits) / len(bits)
    assert abs(below - 1096 / 3000) < 0.04


def test_widths_and_names(spark):
    base, wide = FeatureSet(), FeatureSet.wide()
    assert base.width == 1208 == len(base.names) and wide.width == 1222 == len(wide.names)
    assert base.version != wide.version
    table = [r.name for r in feature_names(spark, wide).orderBy("pos").collect()]
    assert table == wide.names
    for fs in (base, wide):
        rows = assemble_features(texts(spark), "t", fs).collect()
        assert {r.id for r in rows if r.features is None} == {3, 4}
        assert all(len(r.features) == fs.width for r in rows if r.features)


def test_hashed_bits_match_brute_force(spark):
    rows = texts(spark).where("t is not null")
    for r in sparse_features(rows, "t", FeatureSet()).collect():
        assert r.bits == expected_bits(r.t)
    for r in assemble_features(rows, "t").where("features is not null").collect():
        dense = r.features[11:11 + 1024]
        assert [i for i, x in enumerate(dense) if x == 1.0] == expected_bits(r.t)
        assert set(dense) <= {0.0, 1.0}


def test_descriptors_keys_and_patterns(spark):
    fs = FeatureSet()
    r = assemble_features(texts(spark).where("id = 2"), "t", fs).first()
    got = dict(zip(fs.names, r.features))
    assert got["n_chars"] == 26 and got["n_tokens"] == 6 and got["n_distinct_tokens"] == 3
    assert got["max_token_length"] == 5 and got["n_lines"] == 2 and got["digit_share"] == 0.0
    assert got["MACCS_0"] == 0 and fs.dictionary[1] == "a" and got["MACCS_1"] == 0
    assert got[f"MACCS_{fs.dictionary.index('on')}"] == 1
    smiles = dict(zip(fs.names, assemble_features(texts(spark).where("id = 1"), "t", fs).first().features))
    assert smiles["MethoxyCount"] == 0 and smiles["HalogenCount"] == 0
    halogens = spark.createDataFrame([("FC(Cl)(Br)CO",)], "t string")
    h = dict(zip(fs.names, assemble_features(halogens, "t", fs).first().features))
    assert h["HalogenCount"] == 3 and h["MethoxyCount"] == 1 and h["HasNNDimethyl"] == 0


def test_registry_extension_changes_layout_and_version(spark):
    small = FeatureSet(hash_bits=8, dictionary=(None, "o"), patterns=())
    more = small.with_feature("n_dots", lambda text, toks: F.regexp_count(text, F.lit("[.]")))
    more = more.with_pattern(Pattern("HasTwo", "two")).with_pattern(Pattern("Broken", None))
    assert more.width == small.width + 3 and more.version != small.version
    r = assemble_features(texts(spark).where("id = 2"), "t", more).first()
    assert r.features[more.names.index("HasTwo")] == 1 and r.features[-1] == 0


def test_pandas_udf_feature(spark):
    @F.pandas_udf("double")
    def half_length(s: pd.Series) -> pd.Series:
        return s.str.len() / 2

    fs = FeatureSet(hash_bits=8, dictionary=(None, "o"), patterns=()).with_udf("half", half_length)
    assert fs.names[11] == "half" and fs.width == 22
    got = {r.id: r.features for r in assemble_features(texts(spark), "t", fs).collect()}
    assert got[6][11] == 1.5 and got[4] is None and len(got[2]) == 22


def test_store_hit_equals_recompute(spark, folder):
    fs = FeatureSet(hash_bits=64, dictionary=(None, "o"))
    rows = texts(spark)
    path = f"{folder}/store"
    first = upsert_features(rows.where("id < 3"), "t", path, fs)
    assert first.count() == 2
    missing = uncached_keys(rows, "t", read_features(spark, path), version=fs.version)
    assert sorted(r.t for r in missing.collect()) == sorted(["   ", TEXTS[4][1], "one"])
    found = featurise_with_store(rows, "t", "id", path, fs)
    direct = {r.id: r.features for r in assemble_features(rows, "t", fs).collect()}
    assert {r.id: r.features for r in found.collect()} == direct
    assert upsert_features(rows, "t", path, fs).count() == 4
    # Another feature set never reads these vectors.
    other = FeatureSet(hash_bits=32, dictionary=())
    assert upsert_features(rows.where("id = 6"), "t", path, other).count() == 5
    clear_features(spark, path)
    assert read_features(spark, path).count() == 0
    assert upsert_features(rows, "t", path, fs).count() == 4


def test_filter_on_vector_stays_cheap(spark):
    """A filter on the vector is pushed below it; binding keeps that linear in the text."""
    long_text = " ".join(f"w{i}" for i in range(6000))
    rows = spark.createDataFrame([(1, long_text)], "id int, t string")
    out = assemble_features(rows, "t").where(F.col("features").isNotNull())
    assert len(out.first().features) == 1208


def test_vector_helpers(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0, 2], "0110")], "v array<double>, b array<int>, s string")
    got = row.select(
        select_indices(F.col("v"), [1, 3]).alias("up"), select_indices(F.col("v"), [3, 0]).alias("any"),
        select_indices(F.col("v"), []).alias("none"), select_indices(F.col("v"), None).alias("all"),
        dense_bits(F.col("b"), 4).alias("dense"),
        dense_bits(F.array().cast("array<int>"), 3).alias("zero"),
        bits_from_string(F.col("s")).alias("bits"),
    ).first()
    assert (got.up, got.any, got.none, got.all) == ([2.0, 4.0], [4.0, 1.0], [], [1.0, 2.0, 3.0, 4.0])
    assert got.dense == [1.0, 0.0, 1.0, 0.0] and got.zero == [0.0] * 3 and got.bits == [0, 1, 1, 0]
    shown = descriptor_unpivot(row, "v", ["a", "b"], ["s"]).collect()
    assert [(r.name, r.value, r.shown) for r in shown] == [("a", 1.0, "1.00"), ("b", 2.0, "2.00")]


def test_wide_vectors_are_computed_once(spark):
    from assayloom import bindings

    bindings.load()
    made = bindings.QUERIES["wide_features"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
