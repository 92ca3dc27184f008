"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task reduces its texts to a narrow row: SHA-256 of the text without white space and its
   first 64 bits as fingerprint. Rows get a part number (at most ``PART_ROWS`` rows each).
2. A part sends its distinct fingerprints, sorted and Golomb-coded, to the owners of the
   fingerprint ranges. An owner decodes them and returns one bit per fingerprint: set if another
   part sent it too. A fingerprint that a whole third of the rows share is sent once per part.
3. Parts read the bitmaps; rows whose bit is set, or that repeat inside the part, are suspects.
4. Only the texts of suspects are aggregated by their bytes, copies first inside each task.

Defined cases: null text counts as empty; all texts of white space alone are equal; rows equal
in every respect form a group of which one stays; a null doc_id is a value like any other, last
in the order; extra columns are left alone; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import (
    SPACES,
    as_bytes,
    certainly_without,
    possibly_with,
    slices,
    work_parts,
)
from assayloom.llm.golomb import decode, encode
from assayloom.session import stored

#: Rows of a part at most; an owner and a part hold a few times this many fingerprints.
PART_ROWS = 1 << 16
#: A group with more than this share of all rows is hot; so there are fewer than 1,000.
HOT_SHARE = 1e-3

ORACLE_SQL = r"""WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (SELECT *, count(*) OVER g AS group_size,
        first_value(doc_id) OVER (g ORDER BY cp DESC, doc_id ROWS UNBOUNDED PRECEDING) AS keep_id
      FROM n WINDOW g AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""

_NARROW = "doc_id bigint, n_points bigint, text_sha256 string, fingerprint bigint"


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = as_bytes(batch.column("text"))
        digests = [hashlib.sha256(t.translate(None, SPACES)).digest() for t in texts]
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), points, pa.array([d.hex() for d in digests], pa.string()),
            pa.array(np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)),
        ], ["doc_id", "n_points", "text_sha256", "fingerprint"])


def narrow_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, text_sha256, fingerprint of every row; texts are read whole."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _narrow, _NARROW
    )


def _owned(fingerprints: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and the bounds of each owner's range among them."""
    values = np.unique(fingerprints.astype(np.uint64))
    step = -(-(1 << 64) // owners)
    starts = [min(i * step, (1 << 64) - 1) for i in range(1, owners)]
    cuts = np.searchsorted(values, np.array(starts, np.uint64))
    return values, np.concatenate([[0], cuts, [len(values)]]).astype(np.int64)


def _sender(owners: int):
    def send(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        values, bounds = _owned(group.column("fingerprint").to_numpy(), owners)
        rows = []
        for owner in np.flatnonzero(np.diff(bounds)):
            own = values[bounds[owner]:bounds[owner + 1]]
            rows.append((int(owner), part, len(own), *encode(own)))
        return pa.table(
            dict(zip(("owner", "part", "n", "width", "unary", "low"), zip(*rows)))
        )

    return send


def _answer(group: pa.Table) -> pa.Table:
    """An owner's reply: one bit for each fingerprint of each message, set if sent twice."""
    sent = [
        decode(m["n"], m["width"], m["unary"], m["low"])
        for m in group.select(["n", "width", "unary", "low"]).to_pylist()
    ]
    seen, index, counts = np.unique(
        np.concatenate(sent), return_inverse=True, return_counts=True
    )
    bits = np.split(counts[index] > 1, np.cumsum([len(x) for x in sent])[:-1])
    return pa.table({
        "part": group.column("part"), "owner": group.column("owner"),
        "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
    })


def _receiver(owners: int):
    def receive(rows: pa.Table, replies: pa.Table) -> pa.Table:
        prints = rows.column("fingerprint").to_numpy().astype(np.uint64)
        values, bounds = _owned(prints, owners)
        flags = np.zeros(len(values), bool)
        for owner, bits in zip(replies.column("owner").to_pylist(),
                               replies.column("bits").to_pylist()):
            lo, hi = bounds[owner], bounds[owner + 1]
            flags[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8))[: hi - lo]
        _, index, counts = np.unique(prints, return_inverse=True, return_counts=True)
        suspect = flags[index] | (counts[index] > 1)
        return rows.select(["row_id", "doc_id", "n_points", "text_sha256"]).append_column(
            "suspect", pa.array(suspect)
        )

    return receive


def suspects(narrow: DataFrame, n_rows: int) -> DataFrame:
    """``narrow`` with the flag ``suspect``: another row has the same fingerprint."""
    # An owner sees about a million fingerprints, and there are as many owners as that takes.
    owners = max(work_parts(narrow.sparkSession), -(-n_rows // (1 << 20)))
    messages = narrow.select("part", "fingerprint").groupBy("part").applyInArrow(
        _sender(owners), "owner bigint, part bigint, n bigint, width bigint, unary binary, low binary"
    )
    replies = messages.groupBy("owner").applyInArrow(
        _answer, "part bigint, owner bigint, bits binary"
    )
    return narrow.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(
        _receiver(owners),
        "row_id bigint, doc_id bigint, n_points bigint, text_sha256 string, suspect boolean",
    )


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t.translate(None, SPACES) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
             pa.array(texts, pa.binary())],
            ["text_sha256", "body"],
        )


def verified(docs: DataFrame, suspect_rows: DataFrame) -> DataFrame:
    """text_sha256, n_bodies: the different texts behind each suspect digest (one, in truth).

    Only texts of suspects move, but for a few that share a filter cell with one; copies merge
    inside each task before they are compared.
    """
    ids = suspect_rows.select(F.coalesce("doc_id", F.lit(-1)).alias("_id")).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_id"),
                       F.col("text").cast("string"))
    texts = (
        possibly_with(rows, ids, "_id").join(ids, "_id", "left_semi").select("text")
        .mapInArrow(_normal, "text_sha256 string, body binary")
    )
    return texts.groupBy("text_sha256", "body").agg(F.lit(1).alias("n")).groupBy(
        "text_sha256"
    ).agg(F.sum("n").alias("n_bodies"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Equal are texts with the same bytes once white space is deleted. Of a group the row with the
    most code points in the original text, then the smallest doc_id, stays.
    """
    rows = stored(
        narrow_rows(docs)
        .withColumn("row_id", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row_id", PART_ROWS.bit_length() - 1)),
        "digests",
    )
    n_rows = rows.count()
    flagged = stored(suspects(rows, n_rows), "suspects")
    doubtful = flagged.where("suspect")
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "row_id")
    groups = (
        doubtful.groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        .join(verified(docs, doubtful), "text_sha256")
        .select(
            "text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"),
            F.when(F.col("n_bodies") == 1, F.col("best.row_id"))
            .otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")))
            .alias("keep_row"),
        )
    )
    groups = stored(groups, "groups")
    hot = groups.where(F.col("group_size") > max(1, HOT_SHARE * n_rows))
    cold = groups.where(F.col("group_size") <= max(1, HOT_SHARE * n_rows))
    # Fewer than 1 / HOT_SHARE groups can be hot, so their table may be broadcast.
    first = flagged.join(F.broadcast(hot), "text_sha256", "left")
    found = first.where("group_size is not null")
    rest = first.where("group_size is null").select(flagged.columns)
    joined = found.unionByName(
        rest.where("suspect").join(cold, "text_sha256", "left")
        .unionByName(rest.where("not suspect"), allowMissingColumns=True)
    )
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        "text_sha256", "n_points",
    )


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by (doc_id, digest, length); of rows equal in all three as many stay as
    the groups say. Texts whose doc_id loses no row stay where they are.
    """
    lossy = stored(
        duplicate_groups(docs)
        .select(F.coalesce("doc_id", F.lit(-1)).alias("_id"),
                F.col("text_sha256").alias("_sha"), F.col("n_points").alias("_n"),
                F.col("kept").cast("int").alias("one"))
        .groupBy("_id", "_sha", "_n").agg(F.sum("one").alias("_stay"), F.count("*").alias("rows"))
        .where("_stay < rows").drop("rows"),
        "lossy",
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_id")
    )
    keys, text = ["_id", "_sha", "_n"], F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    marked = possibly_with(rows, lossy, "_id").select(
        "row", "_id", F.sha2(F.translate(text, SPACES.decode(), ""), 256).alias("_sha"),
        F.char_length(text).cast("bigint").alias("_n"),
    )
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    some = marked.join(lossy, keys, "left").withColumn("_turn", turn).where(
        F.coalesce(F.col("_turn") <= F.col("_stay"), F.lit(True))
    )
    whole = certainly_without(rows, lossy, "_id")
    return whole.select("row").unionByName(some.select("row")).select("row.*")
