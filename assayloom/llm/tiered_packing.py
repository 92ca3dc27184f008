"""Hierarchical packing of documents into sequences of several lengths, without padding.

Sequences have a power of two of tokens (a tier), so those that are full need no padding.

1. A document longer than the window gives full windows of its own; only its rest goes on. Rests are
   routed to the shortest tier that takes them; below the least tier all share that one.
2. From the longest tier down, each tier opens as many sequences as the tokens left can fill, one for
   each of its rests, the longest first.
3. The gap of an open sequence is filled from the shorter rests, the longest that fits first. Where
   none fits, a rest is cut to the gap, and what is left of it goes back to its own tier. As tokens
   suffice for what a tier opens, each of its sequences ends full.
4. What is less than the least tier goes into ever shorter powers of two.
5. The sequences of a tier are dealt to step groups in turns, back and forth, by the cost of attention
   (squares of piece lengths), so the groups of a tier cost about the same.

All of this needs only the number of rests of each length, at most one count per token of the window,
and treats equal sequences as one run. Spark then ranks the rests of each length, and the rank
tells a rest's pieces and places.

Defined cases: null text counts as empty; an empty text is the end id alone; rows with equal doc_id
are packed each on its own; texts of any length; no rows give no rows; extra columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.byte_bpe import _CUTS as BYTE_CUTS
from assayloom.llm.common import slices
from assayloom.llm.packing import ranked
from assayloom.llm.tokens import PieceEncoder, letters_first, load_tokenizer
from assayloom.session import stored

WINDOW = 1024
#: The least context size that documents are routed to; smaller ones only take the last tokens.
LEAST_TIER = 128
#: Sequences of a step group.
STEP = 64
END_ID = 0


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """Function from texts to arrays of ids, by the byte-level vocabulary at ``path``."""
    encoder = PieceEncoder(letters_first(load_tokenizer(path)))
    return lambda texts: encoder.ids([BYTE_CUTS.findall(t) for t in texts])


# --- the plan, on counts per length ------------------------------------------------------------


@dataclass(frozen=True)
class Stretch:
    """Rests of ``length`` tokens with ranks from ``lo`` up to ``hi``, their tokens from ``start``."""

    length: int
    start: int
    lo: int
    hi: int


@dataclass(frozen=True)
class Piece:
    """``size`` tokens from ``start`` of each rest of a stretch. The rests fill the sequences of a run
    one after the other, ``per`` in each, from number ``first`` on, at ``offset``."""

    rests: Stretch
    size: int
    first: int
    per: int
    offset: int


class _Supply:
    """Rests not yet placed, by the number of tokens they have left."""

    def __init__(self, counts: dict[int, int]):
        self._own: dict[int, list[Stretch]] = {}
        self._count: dict[int, int] = {}
        self._sizes: list[int] = []
        self.tokens = 0
        for length, count in sorted(counts.items()):
            if count:
                self.give(length, Stretch(length, 0, 0, count))

    def give(self, size: int, rests: Stretch) -> None:
        if not self._count.get(size):
            self._own[size], self._count[size] = [], 0
            self._sizes.insert(bisect_right(self._sizes, size), size)
        self._own[size].append(rests)
        self._count[size] += rests.hi - rests.lo
        self.tokens += size * (rests.hi - rests.lo)

    def count(self, size: int) -> int:
        return self._count.get(size, 0)

    def longest(self, most: int | None = None) -> int:
        """The largest size there is, or the largest of at most ``most``; 0 if there is none."""
        at = len(self._sizes) if most is None else bisect_right(self._sizes, most)
        return self._sizes[at - 1] if at else 0

    def take(self, size: int, n: int) -> list[Stretch]:
        out, own = [], self._own[size]
        self._count[size] -= n
        self.tokens -= size * n
        if not self._count[size]:
            self._sizes.remove(size)
        while n:
            last = own.pop()
            some = min(n, last.hi - last.lo)
            out.append(Stretch(last.length, last.start, last.lo, last.lo + some))
            if some < last.hi - last.lo:
                own.append(Stretch(last.length, last.start, last.lo + some, last.hi))
            n -= some
        return out


class Run:
    """``times`` sequences of ``tier`` tokens with pieces of the same sizes."""

    def __init__(self, tier: int, times: int, pieces: list[Piece], filled: int, cost: int):
        self.tier, self.times, self.pieces = tier, times, pieces
        self.filled, self.cost = filled, cost

    def split(self, n: int) -> tuple[Run, Run]:
        """The first ``n`` sequences and the others."""
        parts: tuple[list, list] = ([], [])
        for p in self.pieces:
            at = min(max(n * p.per - p.first, 0), p.rests.hi - p.rests.lo)
            r = p.rests
            if at:
                parts[0].append(Piece(Stretch(r.length, r.start, r.lo, r.lo + at), p.size, p.first, p.per, p.offset))
            if r.lo + at < r.hi:
                parts[1].append(Piece(Stretch(r.length, r.start, r.lo + at, r.hi), p.size,
                                      p.first + at - n * p.per, p.per, p.offset))
        return (Run(self.tier, n, parts[0], self.filled, self.cost),
                Run(self.tier, self.times - n, parts[1], self.filled, self.cost))

    def add(self, stretches: list[Stretch], size: int, per: int) -> None:
        first = 0
        for r in stretches:
            self.pieces.append(Piece(r, size, first, per, self.filled))
            first += r.hi - r.lo
        self.filled += size * per
        self.cost += per * size * size


def _filled(run: Run, supply: _Supply) -> Iterator[Run]:
    """The sequences of ``run``, full; there are tokens enough."""
    todo = [run]
    while todo:
        run = todo.pop()
        gap = run.tier - run.filled
        if not gap:
            yield run
            continue
        size = supply.longest(gap)
        whole = bool(size)
        if not whole:
            size = supply.longest()
        per = min(gap // size, supply.count(size)) if whole else 1
        times = min(run.times, supply.count(size) // per)
        if times < run.times:
            run, later = run.split(times)
            todo.append(later)
        taken = supply.take(size, per * times)
        if whole:
            run.add(taken, size, per)
        else:
            run.add(taken, gap, 1)
            for r in taken:
                supply.give(size - gap, Stretch(r.length, r.start + gap, r.lo, r.hi))
        todo.append(run)


def tiered_plan(counts: dict[int, int], window: int = WINDOW, least: int = LEAST_TIER) -> list[Run]:
    """Runs of full sequences that hold ``counts[length]`` rests of each length below ``window``."""
    supply, out, tier = _Supply(counts), [], window
    while supply.tokens:
        size = supply.longest()
        floor = tier // 2 if tier > least else 0  # a tier's own rests are longer than this
        opened = min(supply.count(size), supply.tokens // tier) if size > floor else 0
        if not opened:
            tier //= 2
            continue
        run = Run(tier, opened, [], 0, 0)
        taken = supply.take(size, opened)
        run.add(taken, min(size, tier), 1)
        if size > tier:
            for r in taken:
                supply.give(size - tier, Stretch(r.length, r.start + tier, r.lo, r.hi))
        out.extend(_filled(run, supply))
    return out


def step_groups(runs: list[Run], step: int = STEP) -> list[tuple[Run, int, int, int]]:
    """(run, rank of its first sequence by cost in its tier, groups of the tier, number of the
    tier's first group); tiers from the longest, each with groups of its own."""
    out, base = [], 0
    for tier in sorted({r.tier for r in runs}, reverse=True):
        own = sorted((r for r in runs if r.tier == tier), key=lambda r: -r.cost)
        groups, rank = -(-sum(r.times for r in own) // step), 0
        for run in own:
            out.append((run, rank, groups, base))
            rank += run.times
        base += groups
    return out


def dealt(rank: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and turn of a rank: every other turn runs back."""
    turn, at = np.divmod(rank, groups)
    return np.where(turn % 2, groups - 1 - at, at), turn


#: Columns of a placement: what a piece of the plan says about the rests of one length.
_LO, _HI, _START, _SIZE, _FIRST, _PER, _OFFSET, _RANK, _GROUPS, _BASE, _TIER = range(11)


def placements(runs: list[Run], step: int = STEP) -> dict[int, np.ndarray]:
    """Per length of rest, its pieces as rows, by start and then by first rank."""
    rows: dict[int, list] = {}
    for run, rank, groups, base in step_groups(runs, step):
        for p in run.pieces:
            rows.setdefault(p.rests.length, []).append(
                (p.rests.lo, p.rests.hi, p.rests.start, p.size, p.first, p.per, p.offset, rank,
                 groups, base, run.tier))
    return {length: np.array(sorted(own, key=lambda r: (r[_START], r[_LO])), np.int64)
            for length, own in rows.items()}


def located(length: int, rank: np.ndarray, table: np.ndarray, step: int) -> dict[str, np.ndarray]:
    """Pieces of the rests of one length with these ranks: row, start, size, sequence, offset,
    tier, group."""
    found, row = [], []
    start, index = np.zeros(len(rank), np.int64), np.arange(len(rank))
    key = table[:, _START] * (1 << 44) + table[:, _LO]
    while len(index):
        at = np.searchsorted(key, start[index] * (1 << 44) + rank[index], side="right") - 1
        found.append(at)
        row.append(index)
        start[index] += table[at, _SIZE]
        index = index[start[index] < length]
    at, row = np.concatenate(found), np.concatenate(row)
    t = table[at]
    number = t[:, _FIRST] + rank[row] - t[:, _LO]
    group, turn = dealt(t[:, _RANK] + number // t[:, _PER], t[:, _GROUPS])
    group += t[:, _BASE]
    return {
        "row": row, "start": t[:, _START], "length": t[:, _SIZE], "sequence_id": group * step + turn,
        "offset": t[:, _OFFSET] + number % t[:, _PER] * t[:, _SIZE], "tier": t[:, _TIER],
        "step_group": group,
    }


# --- Spark -------------------------------------------------------------------------------------

_RESTS = "doc_id bigint, doc_tokens bigint, length bigint, ids binary, windows array<bigint>"
_PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
           "sequence_id bigint, offset bigint, tier bigint, step_group bigint")
_NAMES = [field.split()[0] for field in _PIECES.split(", ")]


def _cutter(path: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in slices(batches):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(),
                                   encode([t or "" for t in batch.column("text").to_pylist()])):
                own = np.append(own, np.uint32(END_ID)).astype("<u4")
                whole = len(own) // window * window
                full = [zlib.crc32(own[a:a + window].tobytes()) for a in range(0, whole, window)]
                rows.append((doc_id, len(own), len(own) - whole, own[whole:].tobytes(), full))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                ["doc_id", "doc_tokens", "length", "ids", "windows"])

    return cut


def token_rests(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_tokens, ids behind the last full window (unsigned 32-bit), their number, and the
    CRC-32 of each full window."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _cutter(path, window), _RESTS)


def _placer(places: dict[int, np.ndarray], step: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            ids = batch.column("ids").to_pylist()
            tokens, doc = batch.column("doc_tokens").to_numpy(), batch.column("doc_id")
            out: dict[str, list] = {n: [] for n in _NAMES}
            for one in np.unique(length):
                own = np.flatnonzero(length == one)
                got = located(int(one), rank[own], places[int(one)], step)
                row = own[got.pop("row")]
                ends = got["start"] + got["length"]
                out["ids_crc32"] += [zlib.crc32(ids[r][4 * a:4 * b]) for r, a, b in zip(
                    row.tolist(), got["start"].tolist(), ends.tolist())]
                got["start"] = got["start"] + tokens[row] - one  # behind the full windows
                out["doc_tokens"].append(tokens[row])
                out["doc_id"].append(doc.take(pa.array(row)))
                for name, values in got.items():
                    out[name].append(values)
            columns = [pa.concat_arrays(out[n]) if n == "doc_id" else
                       pa.array(out[n] if n == "ids_crc32" else np.concatenate(out[n]), pa.int64())
                       for n in _NAMES]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return place


def pack_tiers(docs: DataFrame, path: str, window: int = WINDOW, least: int = LEAST_TIER,
               step: int = STEP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group. Full windows cut from one document have negative sequence ids, and each ``step`` of
    them in a task is a step group of its own."""
    rows = stored(
        token_rests(docs, path, window).withColumn("row_id", F.monotonically_increasing_id()), "rests")
    left = rows.where("length > 0").drop("windows")
    # At most ``window`` counts come to the driver.
    counts = {r["length"]: r["n"] for r in
              left.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = placements(tiered_plan(counts, window, least), step)
    packed = ranked(left, sum(counts.values())).select(
        "doc_id", "doc_tokens", "length", "ids", "rank").mapInArrow(_placer(places, step), _PIECES)
    size = F.lit(window).cast("bigint")
    full = rows.where(F.size("windows") > 0).select(
        "doc_id", "doc_tokens", F.posexplode("windows").alias("at", "ids_crc32")
    ).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return packed.unionByName(full.select(
        "doc_id", (F.col("at") * size).alias("start"), size.alias("length"), "ids_crc32",
        "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"), size.alias("tier"),
        F.floor(F.col("sequence_id") / F.lit(step)).alias("step_group"),
    ))
