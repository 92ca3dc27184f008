"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Deleted, or cut at, by the text rules: code points 0x20 and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32 as text is divisible by five; a null id counts as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def work_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Different labels that a sample covers at most, the most frequent ones.
MOST_LABELS = 1000


def labelled_sample(
    rows: DataFrame, label: str, per_label: int, key: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """At most ``per_label`` rows of each of MOST_LABELS labels, chosen by a hash of ``key``.

    ``rows`` is narrow (keys and labels). Counts per label give a hash limit that leaves about
    twice the rows wanted, so that the ranking works on a few rows whatever the table's size.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_count")).orderBy(
        F.desc("_count"), label
    ).limit(MOST_LABELS)
    order = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = (
        rows.withColumn("_order", order).join(F.broadcast(counts), label)
        .where(F.col("_order") < F.lit(2.0 * per_label + 50) / F.col("_count"))
    )
    first = Window.partitionBy(label).orderBy("_order", *key)
    ranked = few.withColumn("_rank", F.row_number().over(first))
    return ranked.where(F.col("_rank") <= per_label).select(rows.columns)


def labelled_texts(
    rows: DataFrame, label: str, per_label: int, labels: DataFrame | None = None
) -> DataFrame:
    """(label, text) of at most ``per_label`` different rows of each of MOST_LABELS labels.

    ``rows`` has doc_id, text and label, unless ``labels`` gives the label by doc_id. A row is known by
    its doc_id and a hash of its text, so many rows of one doc_id are as many rows to draw from, and
    equal ones count once. Texts stay where they are until their keys are chosen.
    """
    key, own = ["doc_id", "_text"], [label] if labels is None else []
    keyed = rows.select("doc_id", "text", *own, F.xxhash64("text").alias("_text"))
    narrow = keyed.select(*key, *own).distinct()
    if labels is not None:
        narrow = narrow.join(labels.select("doc_id", label).distinct(), "doc_id")
    chosen = labelled_sample(narrow, label, per_label, tuple(key))
    # At most MOST_LABELS * per_label keys; copies of a row merge before they move.
    return keyed.join(F.broadcast(chosen), [*key, *own]).groupBy(*key, label).agg(
        F.first("text").alias("text")).select(label, "text")


def word_vocabulary() -> str:
    """Path of the public word vocabulary, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_rows(docs: DataFrame, function, added: str) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and what ``function`` adds from the text.

    ``function`` maps Arrow batches of ``text`` to batches of the fields ``added``. Only the text
    goes to Python, once, and only what is added comes back; the row waits in the JVM.
    """
    def find(texts: pa.Array) -> pa.Array:
        own = [pa.RecordBatch.from_arrays([texts], ["text"])]
        found = [batch.to_struct_array() for batch in function(iter(own))]
        return pa.concat_arrays(found)

    # Marked so that Spark runs it once for each row, however often its fields are used.
    found = F.arrow_udf(find, T.StructType.fromDDL(added)).asNondeterministic()
    return docs.select(
        F.struct("*").alias("row"), found(F.col("text").cast("string")).alias("found")
    ).select("row", "found.*")


def byte_vocabulary() -> str:
    """Path of the public byte-level vocabulary, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks() -> str:
    """Path of the public rank file of byte-level tokens, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Cells of a key filter; so many rows of one number is the most that is ever broadcast for it.
FILTER_CELLS = 1 << 21


def _celled(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_flag``: null if no key of ``keys`` hashes to the row's cell."""
    cell = F.pmod(F.xxhash64(key), F.lit(FILTER_CELLS)).cast("int").alias("_cell")
    flags = keys.select(cell).distinct().withColumn("_flag", F.lit(True))
    return rows.select("*", cell).join(F.broadcast(flags), "_cell", "left").drop("_cell")


def certainly_without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` that surely have none of the keys; they need not move to be told so.

    A filter of hash cells with a fixed size decides. With far more keys than cells nearly all
    rows are left to ``possibly_with``, which is slower and as right.
    """
    return _celled(rows, keys, key).where("_flag is null").drop("_flag")


def possibly_with(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The other rows: all that have a key of ``keys``, and a few that only share a cell."""
    return _celled(rows, keys, key).where("_flag is not null").drop("_flag")
