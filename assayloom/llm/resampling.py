"""Importance resampling of documents towards a target distribution, ranked by a radix sort.

1. Every text becomes the bucket numbers of its features (runs of words, by CRC-32), two bytes each,
   in a stored table; so the texts are read once.
2. Counts per bucket over all documents and over all target texts give one array of gains, as long
   as there are buckets. A document's weight is the floored mean of its features' gains, and
   Gumbel noise from its id's hash turns the highest scores into a draw without replacement.
3. A histogram of scores tells the score of the last document drawn; documents below it are settled.
4. The others are ranked by an LSD radix sort over the digits of the composite key (score down, then
   doc_id up): in each pass every block of rows counts its digits, prefix sums over (digit, block)
   give each block its destinations, and rows keep their order inside a digit. The last
   destinations are the ranks.

No task ranks more than a block of rows, whatever scores they share; the tables that Spark
broadcasts or collects hold one row per bucket or the extremes of the keys.

Defined cases: null text has no words; a document without features has weight 0; a null doc_id hashes
as an empty id and stands after all others in a tie; rows with equal doc_id count each on its own,
and equal rows take ranks in any order; texts of any length; without target texts all counts of the
target are 0; no documents give no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import as_bytes, slices
from assayloom.session import stored

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bits of a radix digit, and rows of a block (as a power of two) whose digits are counted together.
DIGIT_BITS, BLOCK_BITS = 11, 20

#: Bytes to words: letters in lower case, digits and all beyond ASCII stay, others become spaces.
_WORD_BYTES = bytes(
    b if b > 127 or chr(b) in string.digits + string.ascii_lowercase
    else b + 32 if chr(b) in string.ascii_uppercase else 32
    for b in range(256)
)


def feature_buckets(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``longest`` words."""
    words = text.translate(_WORD_BYTES).split()
    runs = list(map(crc32, words))
    hashes = [runs]
    for more in range(1, longest):
        # A run's checksum goes on from that of the run one word shorter.
        runs = [crc32(word, crc32(b" ", run)) for run, word in zip(runs, words[more:])]
        hashes.append(runs)
    flat = np.fromiter((h for own in hashes for h in own), np.uint32) if longest > 1 else np.array(
        runs, np.uint32)
    return len(words), (flat % buckets).astype("<u2")


def _bucketed(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [feature_buckets(t, longest, buckets) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([n for n, _ in own], pa.int64()),
                pa.array([len(b) for _, b in own], pa.int64()),
                pa.array([b.tobytes() for _, b in own], pa.binary()),
            ], ["doc_id", "n_words", "n_features", "buckets"])

    return run


def bucketed(texts: DataFrame, key: str, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id (from ``key``), n_words, n_features and the features' buckets of every row."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in two bytes")
    return texts.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_bucketed(longest, buckets),
                 "doc_id bigint, n_words bigint, n_features bigint, buckets binary")


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket; a task sends one row for each bucket at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("buckets")), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = rows.select("buckets").mapInArrow(count, "bucket bigint, n bigint")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of Gumbel noise, rounded down, from the hash of the id."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[_flat(batch.column("buckets"))])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            noise = np.array([gumbel(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"),
                 pa.array(weight), pa.array(weight + noise)],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def scored(rows: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    return rows.mapInArrow(
        _scored(gains, seed),
        "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


# --- ranks -------------------------------------------------------------------------------------


def last_score(rows: DataFrame, wanted: int) -> int:
    """The score of the row ``wanted`` from the top. Scores are thousandths of logarithms of counts, so
    there are some ten thousand different ones at most and one task may run along them."""
    down = Window.orderBy(F.desc("score"))
    upto = rows.groupBy("score").agg(F.count("*").alias("n")).select(
        "score", F.sum("n").over(down).alias("upto"))
    return upto.where(F.col("upto") >= wanted).agg(F.max("score")).first()[0]


def _digits(key: Column, span: int) -> list[Column]:
    """Digits of a number from 0 to ``span``, the least first; 64 bits count as unsigned."""
    mask = F.lit((1 << DIGIT_BITS) - 1)
    return [F.shiftrightunsigned(key, at).bitwiseAND(mask)
            for at in range(0, span.bit_length(), DIGIT_BITS)]


def _id_digits(first: int, last: int) -> list[Column]:
    """Digits that sort ids from ``first`` to ``last``, null after them."""
    if last - first < (1 << 63) - 1:
        own = _digits(F.col("doc_id") - F.lit(first), last - first)
    else:  # ids of both signs, too far apart for a difference
        own = _digits(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), (1 << 64) - 1)
    return [F.coalesce(d, F.lit(0)) for d in own] + [F.col("doc_id").isNull().cast("bigint")]


def radix_pass(rows: DataFrame, digit: Column, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with the new ``place`` that a stable counting sort by ``digit`` gives them.

    Places are different numbers from 0; blocks are stretches of 2 ** ``block_bits`` of them.
    """
    dealt = rows.withColumn("block", F.shiftright("place", block_bits)).withColumn("digit", digit)
    counts = dealt.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # One row per digit, then one per block of a digit.
    below = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_digit = counts.groupBy("digit").agg(F.sum("n").alias("all")).select(
        "digit", F.coalesce(F.sum("all").over(below), F.lit(0)).alias("base"))
    starts = counts.select(
        "digit", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    ).join(of_digit, "digit").select("digit", "block", (F.col("base") + F.col("start")).alias("start"))
    turn = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
    return dealt.withColumn("turn", turn).join(starts, ["digit", "block"]).withColumn(
        "place", F.col("start") + F.col("turn")).select(rows.columns)


def radix_ranked(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` (doc_id, score, others) with ``place``: from 0, score down, then doc_id up."""
    ends = rows.agg(F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    low, high, first, last = (x if x is not None else 0 for x in ends)
    digits = _id_digits(first, last) + _digits(F.lit(high) - F.col("score"), high - low)
    placed = stored(rows.withColumn("place", F.monotonically_increasing_id()), "radix")
    for digit in digits:
        placed = stored(radix_pass(placed, digit, block_bits), "radix")
    return placed


def resample(
    docs: DataFrame, target: DataFrame, target_key: str, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null if not drawn.

    Of the N documents with ``least_words`` words or more, N * ``percent`` // 100 are drawn.
    """
    rows = stored(bucketed(docs, "doc_id", longest, buckets), "buckets")
    goal = bucketed(target, target_key, longest, buckets)
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(goal, buckets))
    all_scored = stored(scored(rows, gains, seed), "scores")
    fit = F.col("n_words") >= least_words
    wanted = all_scored.where(fit).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return all_scored.select(*columns, no_rank)
    limit = last_score(all_scored.where(fit), wanted)
    doubtful = fit & (F.col("score") >= limit)
    ranked = radix_ranked(all_scored.where(doubtful).select(*columns))
    rank = F.col("place") + 1
    return all_scored.where(~doubtful).select(*columns, no_rank).unionByName(
        ranked.select(*columns, F.when(rank <= wanted, rank).alias("rank")))


ORACLE_SQL = r"""WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, row_number() OVER () AS row_id, id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
features AS (
  SELECT side, row_id, w, count(*) AS n
  FROM (SELECT side, row_id, unnest(ws) AS w FROM words) GROUP BY ALL),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), repeat([0::BIGINT], 8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM features)),
placed AS (SELECT side, row_id, bucket, n FROM features JOIN hashed USING (w)),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s,
                  coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain
          FROM counts, sums),
weights AS (SELECT row_id, floor(sum(n * gain) / sum(n))::BIGINT AS weight
            FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id),
scores AS (
  SELECT id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:'
           || coalesce(id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row_id) WHERE side = 'd'),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS fit FROM scores)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranks"""
