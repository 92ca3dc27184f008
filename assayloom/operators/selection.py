"""Values at exact ranks, by radix selection on an order-preserving image of doubles.

The 64-bit image of a double grows with it. A histogram over the first 16 bits tells which cell holds
each wanted rank; the histogram is taken again over the next 16 bits inside those cells, until a cell
holds one value only, which four levels always reach. So no rows are ranked, whatever the
values: the worst a cell can hold in the end is copies of one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.numeric import double_of_image, with_double_image
from assayloom.session import stored

DIGIT = 16
#: ``cells(shift, held)``: by..., _outer, _base, _n, _cell, _in, _lo, _hi of the next level. Level
#: one has no ``held``, and its _outer and _base are 0.
Cells = Callable[[int, DataFrame | None], DataFrame]
#: ``wanted(before, upto, n)``: array of the numbers of cuts whose rank, from 0, lies in
#: [before, upto) of n rows.
Wanted = Callable[[Column, Column, Column], Column]


def descend(cells: Cells, by: Sequence[str], wanted: Wanted) -> DataFrame:
    """by..., cut, _n (rows of the group) and ``value`` at every wanted rank.

    Each level keeps one row per group and cut at most, in a stored table, so Spark knows its size when
    it chooses how to join it with the rows of the next level.
    """
    by, found, held = list(by), [], None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        level = cells(shift, held)
        if held is None:
            level = level.withColumn("_n", F.sum("_in").over(Window.partitionBy(*by)))
        # At most 2 ** DIGIT cells inside a cell.
        upto = F.col("_base") + F.sum("_in").over(Window.partitionBy(*by, "_outer").orderBy("_cell"))
        level = level.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_in"))
        level = level.withColumn("cuts", wanted(F.col("_before"), F.col("_upto"), F.col("_n")))
        level = stored(
            level.where(F.size("cuts") > 0)
            .select(*by, "_cell", F.col("_before").alias("_base"), "_n", "_lo", "_hi", "cuts"), "cells")
        found.append(level.where("_lo = _hi"))
        held = level.where("_lo < _hi").select(
            *by, F.col("_cell").alias("_outer"), "_base", "_n")
        if not shift or held.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select(
        *by, F.explode("cuts").alias("cut"), "_n", double_of_image(F.col("_lo")).alias("value"))


def _column_cells(rows: DataFrame, by: list[str]) -> Cells:
    def cells(shift: int, held: DataFrame | None) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        if held is None:
            inside = rows.withColumns({"_outer": zero, "_base": zero})
            keys = [*by, "_outer", "_base"]
        else:
            r, h = rows.alias("r"), held.alias("h")
            same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]
            same.append(F.shiftright("_image", shift + DIGIT) == F.col("_outer"))
            inside = r.join(h, reduce(Column.__and__, same)).select(
                *[F.col(f"r.{c}").alias(c) for c in by], "_image", "_outer", "_base", "_n")
            keys = [*by, "_outer", "_base", "_n"]
        return inside.groupBy(*keys, F.shiftright("_image", shift).alias("_cell")).agg(
            F.count("*").alias("_in"), F.min("_image").alias("_lo"), F.max("_image").alias("_hi"))

    return cells


def values_at_ranks(df: DataFrame, value: str, by: Sequence[str], wanted: Wanted) -> DataFrame:
    """by..., cut, _n, ``value``: exact values at ranks of each group; null and NaN do not count."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = with_double_image(rows.select(*by, F.col(value).cast("double").alias("_value")), "_value",
                             "_image")
    return descend(_column_cells(rows.select(*by, "_image"), by), by, wanted)


# --- vectors -----------------------------------------------------------------------------------


def images(values: np.ndarray) -> np.ndarray:
    """Images of doubles: their bits, mirrored for negative ones."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, -(bits & np.int64((1 << 63) - 1)), bits)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (position, cell, count, least, greatest), each position and cell once."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
    starts = np.concatenate([[0], starts]) if len(rows) else np.zeros(0, np.int64)
    return np.stack([
        rows[starts, 0], rows[starts, 1], np.add.reduceat(rows[:, 2], starts),
        np.minimum.reduceat(rows[:, 3], starts), np.maximum.reduceat(rows[:, 4], starts),
    ], axis=1) if len(rows) else rows


def _histogram(shift: int, held: dict[int, np.ndarray] | None):
    """Counts per position and cell of a task's vectors: what leaves it has one row for each cell."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own, times = batch.column(0).slice(at, 512), batch.column(1).slice(at, 512).to_numpy()
                times = times[own.is_valid().to_numpy(zero_copy_only=False)]
                own = own.drop_null()
                sizes = pa.compute.list_value_length(own).to_numpy(zero_copy_only=False)
                flat = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                if len(sizes) and sizes.min() == sizes.max() and not np.isnan(flat).any():
                    # Whole vectors: each wanted position is sorted by itself.
                    wide = flat.reshape(len(sizes), -1)
                    places = np.arange(wide.shape[1]) if held is None else np.array(
                        sorted(p for p in held if p < wide.shape[1]), np.int64)
                    image = images(np.ascontiguousarray(wide[:, places].T))
                    pos = np.repeat(places, len(sizes))
                    if (times == 1).all():
                        image, times = np.sort(image, axis=1).ravel(), np.ones(image.size, np.int64)
                    else:
                        order = np.argsort(image, axis=1)
                        image, times = np.take_along_axis(image, order, 1).ravel(), times[order].ravel()
                else:
                    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    good = ~np.isnan(flat)
                    image, pos, times = images(flat[good]), pos[good], np.repeat(times, sizes)[good]
                    order = np.lexsort((image, pos))
                    image, pos, times = image[order], pos[order], times[order]
                if held is not None:
                    inside = np.zeros(len(pos), bool)
                    outer = image >> np.int64(shift + DIGIT)
                    edges = np.searchsorted(pos, np.arange(len(sizes) and int(sizes.max()) + 1))
                    for p in held:
                        if p + 1 < len(edges):
                            a, b = edges[p], edges[p + 1]
                            inside[a:b] = np.isin(outer[a:b], held[p])
                    image, pos, times = image[inside], pos[inside], times[inside]
                if not len(pos):
                    continue
                cell = image >> np.int64(shift)
                first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (cell[1:] != cell[:-1])]))
                last = np.append(first[1:], len(pos))
                parts.append(np.stack([pos[first], cell[first], np.add.reduceat(times, first), image[first],
                                       image[last - 1]], axis=1))
                size += len(first)
                if size > 1 << 20:
                    parts = [_merged(parts)]
                    size = len(parts[0])
                    if size > 1 << 19:  # many cells: hand them on
                        yield _cell_batch(parts.pop())
                        size = 0
        if parts:
            yield _cell_batch(_merged(parts))

    return count


def _cell_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[:, 0].astype(np.int32)), *(pa.array(rows[:, i]) for i in range(1, 5))],
        ["pos", "_cell", "_in", "_lo", "_hi"])


def vector_values_at_ranks(df: DataFrame, features: str, wanted: Wanted, weight: str | None = None) -> DataFrame:
    """pos, cut, _n, ``value`` for every position of a vector column; a row counts ``weight`` times.

    The vectors stay whole: a task sends one row per position and cell, however many vectors it has.
    The cells held at a level, one per position and cut at most, travel with the tasks.
    """
    numbers = F.col(features)
    if not isinstance(df.schema[features].dataType.elementType, T.FloatType):  # the kernel widens floats
        numbers = numbers.cast("array<double>")
    times = F.lit(1) if weight is None else F.col(weight)
    vectors = df.select(numbers.alias("v"), times.cast("bigint").alias("times"))

    def cells(shift: int, held: DataFrame | None) -> DataFrame:
        inside = None
        if held is not None:
            # As many numbers as the vector has positions, times the cuts.
            inside = {}
            for row in held.select("pos", "_outer").collect():
                inside.setdefault(row["pos"], []).append(row["_outer"])
            inside = {p: np.array(own, np.int64) for p, own in inside.items()}
        counted = vectors.mapInArrow(
            _histogram(shift, inside), "pos int, _cell bigint, _in bigint, _lo bigint, _hi bigint"
        ).groupBy("pos", "_cell").agg(
            F.sum("_in").alias("_in"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        if held is None:
            zero = F.lit(0).cast("bigint")
            return counted.withColumns({"_outer": zero, "_base": zero})
        return counted.withColumn("_outer", F.shiftright("_cell", DIGIT)).join(held, ["pos", "_outer"])

    return descend(cells, ["pos"], wanted)
