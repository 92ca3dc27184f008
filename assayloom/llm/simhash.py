"""SimHash near-duplicates by deletion-variant signatures.

The 64 bits are cut into three segments. Fingerprints at most four bits apart differ by at most
one bit in some segment, so they share that segment with one of its bits struck out. Each
different fingerprint is indexed under all 64 one-wildcard variants, an equality join on the
variant brings candidates together, and the whole distance decides.

A variant that many fingerprints share is not joined pair by pair: its members are dealt to
blocks, every two blocks meet in one task, and a task returns a spanning forest of the links it
verifies, so what leaves a task grows with its members and connectivity loses nothing.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links
like any other; texts of fewer than four words are one shingle; rows with the same doc_id share
a component; a null doc_id takes part through its text and never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import SPACES, as_bytes, certainly_without, possibly_with, slices
from assayloom.llm.components import component_labels
from assayloom.session import stored

SHINGLE = 4
RADIUS = 4
#: (lowest bit, width) of the segments: radius 4 leaves one of three with at most one wrong bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a variant, or of a block of a larger variant, that one task compares at once.
BLOCK = 1 << 15
#: Variants of up to so many members are compared pair by pair in array steps.
SHORT = 32
_SEED = 42
_BLANKS = bytes.maketrans(SPACES, b" " * len(SPACES))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CLEAN = bytes(_LOWER[_BLANKS[i]] for i in range(256))


def fingerprint(text: bytes) -> int:
    """A bit is set if more than half of the shingle hashes have it set."""
    words = text.translate(_CLEAN).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1:] or ends[-1:]
    hashes = np.fromiter(
        (digest(line[a:b], _SEED) for a, b in zip(starts, last)), np.uint64, len(last)
    )
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):  # long texts in pieces: bounded memory
        bits = np.unpackbits(hashes[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    ones = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(ones.view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of the whole text, as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _prints, "doc_id bigint, print bigint"
    )


def _segment(low: int, width: int) -> Column:
    return F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << width) - 1))


def _variants(at: int, segment: Column) -> list[Column]:
    """Keys of a segment value: segment number, struck-out bit, the value without that bit."""
    width = SEGMENTS[at][1]
    return [
        segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))).cast("bigint")
        + F.lit((at * 32 + bit) << 22)
        for bit in range(width)
    ]


def variants(prints: DataFrame) -> DataFrame:
    """``key, print``: every different fingerprint under its 64 one-wildcard variants."""
    keys = [k for at, place in enumerate(SEGMENTS) for k in _variants(at, _segment(*place))]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "print")


def crowded_variants(prints: DataFrame) -> DataFrame:
    """``key, blocks`` of variants that may hold more than BLOCK fingerprints.

    A variant joins two segment values, so its size follows from counts per value, three rows a
    fingerprint, and one of the two values must hold over half a block.
    """
    values = None
    for at, (low, width) in enumerate(SEGMENTS):
        one = prints.groupBy(_segment(low, width).alias("value")).count().where(
            F.col("count") > BLOCK // 2
        ).select(F.lit(at).alias("at"), "value", "count")
        values = one if values is None else values.unionByName(one)
    keys = F.lit(None)
    for at in range(len(SEGMENTS)):
        keys = F.when(F.col("at") == at, F.array(*_variants(at, F.col("value")))).otherwise(keys)
    # The other value may hold up to half a block without being listed.
    return values.select(F.explode(keys).alias("key"), "count").groupBy("key").agg(
        F.ceil((F.sum("count") + BLOCK // 2) / F.lit(BLOCK)).cast("int").alias("blocks")
    ).where("blocks > 1")


def spanning_links(sides: tuple[np.ndarray, np.ndarray] | tuple[np.ndarray]):
    """Links that connect what all links at most RADIUS bits apart connect, at most one for each
    member: breadth first, each step against the members not yet reached. With two sides only
    links from one to the other count."""
    left, links = list(sides), []
    across = len(left) - 1
    for side in range(len(left) if across else 1):
        while len(left[side]):
            queue = [(left[side][0], side)]
            left[side] = left[side][1:]
            while queue:
                one, own = queue.pop()
                to = own ^ across
                if not len(left[to]):
                    continue
                hit = np.bitwise_count(left[to] ^ one) <= RADIUS
                if hit.any():
                    links += [(one, x) for x in left[to][hit]]
                    queue += [(x, to) for x in left[to][hit]]
                    left[to] = left[to][~hit]
    return links


def _crossed(key: int, prints: np.ndarray) -> tuple[np.ndarray, ...]:
    """The members of a variant as the sides to be linked.

    Equal segments meet in each variant of the segment; they are linked in its first only.
    """
    at, bit = key >> 27, key >> 22 & 31
    if bit == 0:
        return (prints,)
    one = (prints >> np.uint64(SEGMENTS[at][0] + bit) & np.uint64(1)).astype(bool)
    return prints[one], prints[~one]


def _pairs(table: dict, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Verified links of all short runs, all pairs at once, one lag after the other."""
    prints, found = table["print"].view(np.uint64), [np.zeros((0, 2), np.uint64)]
    for lag in range(1, int(sizes.max(initial=0))):
        counts = np.maximum(sizes - lag, 0)
        first = np.repeat(starts, counts)
        x = first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
        key, a, b = table["key"][x], prints[x], prints[x + lag]
        apart = a ^ b
        bit = (key >> 22) & 31
        place = np.array([low for low, _ in SEGMENTS])[key >> 27] + bit
        struck = (apart >> place.astype(np.uint64) & np.uint64(1)).astype(bool)
        hit = (np.bitwise_count(apart) <= RADIUS) & ((bit == 0) | struck)
        found.append(np.stack([a[hit], b[hit]], 1))
    return np.concatenate(found)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal (key, i, j); rows come sorted by these."""
    rest = None
    for batch in _with_end(batches):
        table = rest
        if batch is not None:
            new = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            table = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in new}
        if table is None or not len(table["key"]):
            continue
        n, change = len(table["key"]), False
        for c in ("key", "i", "j"):
            change = change | (table[c][1:] != table[c][:-1])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        upto = n if batch is None else starts[-1]  # the last run may go on in the next batch
        rest = {c: v[upto:] for c, v in table.items()}
        starts = starts[starts < upto]
        sizes = np.diff(np.append(starts, upto))
        short = (sizes > 1) & (sizes <= SHORT)
        found = [_pairs(table, starts[short], sizes[short])]
        for start, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            prints = table["print"][start:start + size].view(np.uint64)
            links = spanning_links(_crossed(int(table["key"][start]), prints))
            found.append(np.array(links, np.uint64).reshape(-1, 2))
        pairs = np.concatenate(found)
        if len(pairs):
            pairs = np.unique(np.stack([pairs.min(1), pairs.max(1)], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"]
            )


def _with_end(batches):
    yield from batches
    yield None


def links(prints: DataFrame) -> DataFrame:
    """``x, y``: verified links between different fingerprints; they connect all that links do."""
    crowded = stored(crowded_variants(prints), "crowded")
    every = variants(prints).join(crowded, "key", "left")
    zero = F.lit(0)
    usual = every.where("blocks is null").select("key", zero.alias("i"), zero.alias("j"), "print")
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(zero, F.col("blocks") - 1))
    dealt = (
        every.where("blocks is not null").withColumn("block", block).withColumn("other", other)
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "print")
    )
    met = usual.unionByName(dealt).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(_links, "x bigint, y bigint").distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    labels = component_labels(links(prints.select("print")).select(
        F.col("x").alias("a"), F.col("y").alias("b")
    ))
    classes = prints.join(labels, prints["print"] == labels["node"], "left").select(
        "print", "first_id", F.coalesce("label", "print").alias("label")
    )
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stored(classes.join(smallest, "label").select("print", "component_id"), "classes")
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, all columns as they are.

    Rows that share a doc_id (a null one too) are one document and stay or go together.
    """
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_own")
    classes = near_duplicate_classes(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")
    gone = stored(
        classes.groupBy(own).agg(F.max(stays).alias("stay")).where("stay = 0").select("_own"), "gone"
    )
    rows = docs.select(F.struct("*").alias("row"), own)
    # Most documents stay, and are told so where they lie.
    left = possibly_with(rows, gone, "_own").join(gone, "_own", "left_anti")
    return certainly_without(rows, gone, "_own").unionByName(left).select("row.*")
