"""Importance resampling against a plain version, and the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from assayloom.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, percent, least, longest=1, buckets=10_000, seed=2024):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for d, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_docs(n):
    rng = random.Random(3)
    letters = ["Haus", "mit", "Über", "x-1", "`tick`", "été", "a_b", "NUL\x00l", "　ｗ", "9"]
    return [(i * 7, " ".join(rng.choices(letters, k=rng.randrange(40)))) for i in range(n)]


def test_equals_a_plain_version(spark, make_docs):
    docs = some_docs(300) + [(None, "a b c d e f g"), (5, None), (6, ""), (7, "Haus " * 30), (7, "Haus " * 30),
                             (-4, "lang " * 100_000)]
    target = ["Über dem Haus", "ein Haus", None]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    for percent, least, longest in ((10, 20, 1), (60, 3, 2), (100, 0, 3)):
        got = resampling.resample(make_docs(docs).repartition(4), goal, "item_id", percent, least, longest)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert result(got) == plain(docs, target, percent, least, longest)


def test_radix_sort_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, -(1 << 63), (1 << 63) - 1, rng.randrange(1 << 40)]), rng.randrange(-90, 90))
            for _ in range(3000)]
    rows += [(i, 0) for i in range(1500)]  # one hot score
    frame = spark.createDataFrame(rows, "doc_id bigint, score bigint").repartition(6)
    got = resampling.radix_ranked(frame, block_bits=6).collect()
    assert sorted(r["place"] for r in got) == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["place"])] == want


def test_a_pass_is_stable(spark):
    frame = spark.createDataFrame([(i, i % 3) for i in range(200)], "place bigint, k int")
    from pyspark.sql import functions as F

    got = {r["k"]: [] for r in frame.collect()}
    for r in resampling.radix_pass(frame.withColumn("old", F.col("place")), F.col("k"), 4).orderBy("place").collect():
        got[r["k"]].append(r["old"])
    assert all(own == sorted(own) for own in got.values())


def test_empty_tables(spark, make_docs):
    goal = spark.createDataFrame(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    assert resampling.resample(make_docs([]), goal, "item_id").count() == 0
    docs = some_docs(40)
    assert result(resampling.resample(make_docs(docs), goal, "item_id", 50, 1)) == plain(docs, [], 50, 1)
