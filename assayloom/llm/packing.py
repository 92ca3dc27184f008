"""Best-fit packing of documents into sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so the whole decision needs only how many pieces
there are of each length: at most 4,096 counts, whatever the corpus.

1. Large lengths are sorted and cut into groups of equal cardinality; each group is rounded up
   to its largest length.
2. For these few sizes a linear program over configurations is solved by column generation
   (a knapsack finds the next column) and its whole parts are taken.
3. Configurations are filled with the actual lengths, which gives back what rounding took.
4. Lengths left by the whole parts and small lengths, longest first, go where they fit best; the
   rest opens new sequences.

Sequences with the same content are kept as one run (content, how many), so the plan stays small.
Spark then ranks the pieces of each length, and rank and plan give sequence and offset.

Defined cases: null text counts as empty; an empty text is the end id alone; rows with the same
doc_id are packed each on its own; no rows give no rows; extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import slices, work_parts
from assayloom.llm.tokens import REMEMBERED_BYTES, word_encoder
from assayloom.session import stored

CAPACITY = 4096
END_ID = 1
#: Lengths above this share of the capacity are large.
LARGE_SHARE = 0.25
#: Numbers of groups of the large lengths that are tried; the plan with fewest sequences counts.
GROUPS = (48, 128, 256)
#: Rows of a bucket in which one task ranks pieces.
BUCKET_ROWS = 1 << 17

_PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _cutter(path: str, capacity: int, remembered: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path, remembered)
        for batch in slices(batches):
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids):
                own = np.append(own, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start:start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names)
            )

    return cut


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED_BYTES
) -> DataFrame:
    """Each document's ids and the end id, cut where longer than ``capacity``."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _cutter(path, capacity, remembered), _PIECES
    )


# --- the plan, on counts per length ------------------------------------------------------------


def grouped_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths from the longest down in groups of equal cardinality: (size rounded up to,
    [(length, count)])."""
    total = sum(counts.values())
    each, out, room = -(-total // groups) if total else 1, [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            take = min(left, room)
            out[-1][1].append((length, take))
            left, room = left - take, room - take
    merged: dict[int, list] = {}
    for size, own in out:  # groups of one and the same length count as one
        merged.setdefault(size, []).extend(own)
    return list(merged.items())


def best_configuration(sizes: list[int], values: np.ndarray, limits: list[int], capacity: int):
    """Counts per size of a filling with the highest total value (a knapsack over capacity)."""
    best = np.zeros(capacity + 1)
    takes = []
    for size, value, limit in zip(sizes, values, limits):
        new, take = best.copy(), np.zeros(capacity + 1, np.int16)
        for k in range(1, min(limit, capacity // size) + 1):
            with_k = best[: capacity + 1 - k * size] + k * value
            better = with_k > new[k * size:] + 1e-12
            new[k * size:][better] = with_k[better]
            take[k * size:][better] = k
        best = new
        takes.append(take)
    at, counts = capacity, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        counts[i] = int(takes[i][at])
        at -= counts[i] * sizes[i]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400):
    """[(counts per size, times)]: the whole parts of the linear program's solution. They leave
    less than one sequence for each size."""
    n = len(sizes)
    columns = [[capacity // s if i == j else 0 for i in range(n)] for j, s in enumerate(sizes)]
    for _ in range(rounds):
        basis = np.array(columns, float).T
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, new = best_configuration(sizes, prices, [capacity] * n, capacity)
        if value <= 1 + 1e-7:
            break
        use = np.linalg.solve(basis, np.array(demand, float))
        step = np.linalg.solve(basis, np.array(new, float))
        ratio = np.full(n, np.inf)
        ratio[step > 1e-9] = use[step > 1e-9] / step[step > 1e-9]
        columns[int(ratio.argmin())] = new
    use = np.linalg.solve(np.array(columns, float).T, np.array(demand, float))
    left, chosen = list(demand), []

    def take(counts: list[int], times: int) -> None:
        fits = [left[i] // c for i, c in enumerate(counts) if c]
        times = min(times, min(fits)) if fits else 0
        if times > 0:
            chosen.append((counts, times))
            for i, c in enumerate(counts):
                left[i] -= c * times

    for counts, times in zip(columns, use):
        take(counts, int(times + 1e-6))
    return chosen


class Run:
    """``times`` sequences with the same content: [(length, how many)] and the room left."""

    __slots__ = ("content", "times", "room")

    def __init__(self, content: tuple, times: int, room: int):
        self.content, self.times, self.room = content, times, room

    def with_more(self, length: int, per: int, times: int) -> Run:
        return Run((*self.content, (length, per)), times, self.room - length * per)


def substituted(chosen, groups, capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Configurations filled with actual lengths, the longest of a group first, and the
    lengths that are left."""
    supply = [list(own)[::-1] for _, own in groups]  # pop from the end: longest first
    out = []
    for counts, times in chosen:
        slots = [i for i, c in enumerate(counts) for _ in range(c)]
        lanes: list[list[tuple[int, int]]] = []
        for i in slots:
            lane, need = [], times
            while need:
                length, have = supply[i].pop()
                got = min(have, need)
                lane.append((length, got))
                need -= got
                if have > got:
                    supply[i].append((length, have - got))
            lanes.append(lane)
        at = [0] * len(lanes)
        used = [0] * len(lanes)
        done = 0
        while done < times:
            span = min(lane[at[k]][1] - used[k] for k, lane in enumerate(lanes))
            content = tuple((lane[at[k]][0], 1) for k, lane in enumerate(lanes))
            out.append(Run(content, span, capacity - sum(length for length, _ in content)))
            done += span
            for k, lane in enumerate(lanes):
                used[k] += span
                if used[k] == lane[at[k]][1]:
                    at[k], used[k] = at[k] + 1, 0
    left: dict[int, int] = {}
    for length, count in (pair for own in supply for pair in own):
        left[length] = left.get(length, 0) + count
    return out, left


def best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Lengths, longest first, each into the sequences with the least room that fits."""
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        by_room[run.room].append(run)
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left:
            while room < capacity and not by_room[room]:
                room += 1
            if room == capacity:  # no open sequence fits: new ones, as full as they get
                per = capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    by_room[capacity - per * length].append(
                        Run(((length, per),), whole, capacity - per * length))
                if rest:
                    by_room[capacity - rest * length].append(
                        Run(((length, rest),), 1, capacity - rest * length))
                break
            run = by_room[room].pop()
            per = room // length
            whole, rest = divmod(left, per)
            if whole >= run.times:
                by_room[room - per * length].append(run.with_more(length, per, run.times))
                left -= per * run.times
                continue
            if whole:
                by_room[room - per * length].append(run.with_more(length, per, whole))
            untouched = run.times - whole - (1 if rest else 0)
            if rest:
                by_room[room - rest * length].append(run.with_more(length, rest, 1))
            if untouched:
                by_room[room].append(Run(run.content, untouched, room))
            left = 0
    return [run for own in by_room for run in own]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of sequences that hold ``counts[length]`` pieces of each length."""
    full = [Run(((capacity, 1),), counts[capacity], 0)] if counts.get(capacity) else []
    limit = max(1, int(capacity * LARGE_SHARE))
    large = {k: v for k, v in counts.items() if limit < k < capacity and v}
    small = {k: v for k, v in counts.items() if k <= limit and v}
    if not large:
        return best_fit(full, small, capacity)
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    plans = []
    for n in GROUPS:
        groups = grouped_sizes(large, n)
        demand = [sum(c for _, c in own) for _, own in groups]
        chosen = configurations([size for size, _ in groups], demand, capacity)
        filled, left = substituted(chosen, groups, capacity)
        runs = best_fit(full + filled, left | small, capacity)
        plans.append((sum(run.times for run in runs), len(plans), runs))
        # Enough: one sequence in 10,000 above the least possible, or more groups change nothing.
        if plans[-1][0] * 10_000 <= least * 10_001 or len(groups) < n:
            break
    return min(plans)[2]


def placements(runs: list[Run]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, per sequence, offset), by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for run in runs:
        offset = 0
        for length, per in run.content:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, per, offset))
            ranks[length] = rank + per * run.times
            offset += length * per
        sequence += run.times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def _placer(places: dict[int, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                own, rows = np.flatnonzero(length == one), places[int(one)]
                found = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - found[:, 0]
                sequence[own] = found[:, 1] + inside // found[:, 2]
                offset[own] = found[:, 3] + inside % found[:, 2] * one
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return place


def ranked(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with their rank, from 0, among the rows of the same length.

    Ranks count inside buckets of bounded size and start after the buckets before; so a length
    that a third of all rows share is ranked by many tasks.
    """
    buckets = max(work_parts(rows.sparkSession), -(-n_rows // BUCKET_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    own = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = own.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"))
    turn = Window.partitionBy("length", "bucket").orderBy("row_id")
    return (
        dealt.withColumn("turn", F.row_number().over(turn) - 1).join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("turn") + F.col("s")).drop("turn", "s", "bucket", "row_id")
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED_BYTES
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A worker keeps
    known pieces of text in about ``remembered`` bytes until it ends."""
    rows = stored(
        pieces(docs, path, capacity, remembered).withColumn("row_id", F.monotonically_increasing_id()),
        "pieces",
    )
    # At most ``capacity`` counts come to the driver.
    counts = {r["length"]: r["n"] for r in
              rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = placements(packing_plan(counts, capacity))
    return ranked(rows, sum(counts.values())).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank"
    ).mapInArrow(_placer(places), _PIECES + ", sequence_id bigint, offset bigint")
