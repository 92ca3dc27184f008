"""Curated, raw and feature stores: partitioned parquet instead of one file per row."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.text import content_key
from assayloom.operators.curate import not_blank
from assayloom.operators.featurise import FeatureSet, assemble_features
from assayloom.operators.lookup import cached_lookup, uncached_keys
from assayloom.session import remove_others


def read_if_exists(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """The parquet table at a path, or ``None`` if nothing was written there yet.

    Only a missing path counts as a miss; a damaged store is an error, not an empty cache.
    """
    try:
        reader = spark.read
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# --- curated rows, one directory per target -------------------------------------


def save_curated(curated: DataFrame, path: str, target: str = "target_id") -> None:
    """Replaces the partitions of the targets present in the frame, keeps all others."""
    (
        curated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(target)
        .parquet(path)
    )


def read_curated(
    spark: SparkSession, path: str, target_id: str, target: str = "target_id"
) -> DataFrame | None:
    """Rows of one target (only its directory is read), or ``None`` if it is not stored."""
    stored = read_if_exists(spark, path)
    if stored is None:
        return None
    rows = stored.where(F.col(target).cast("string") == target_id)
    return None if rows.isEmpty() else rows


def load_or_refresh(
    spark: SparkSession,
    path: str,
    target_id: str,
    fetch: Callable[[str], DataFrame],
    preprocess: Callable[[DataFrame], DataFrame],
    force_refresh: bool = False,
    target: str = "target_id",
) -> DataFrame:
    """Stored rows unless missing or ``force_refresh``; else fetch, preprocess, store, read.

    If nothing is left of the fetched rows, old rows of the target are removed too: they are not
    returned as fresh.
    """
    if not force_refresh:
        stored = read_curated(spark, path, target_id, target)
        if stored is not None:
            return stored
    fresh = preprocess(fetch(target_id))
    if target not in fresh.columns:
        fresh = fresh.withColumn(target, F.lit(target_id))
    if fresh.isEmpty():
        drop_curated(spark, path, target_id, target)
        raise ValueError(f"No rows of target {target_id} passed the curation")
    save_curated(fresh, path, target)
    return read_curated(spark, path, target_id, target)


def drop_curated(spark: SparkSession, path: str, target_id: str, target: str = "target_id") -> None:
    """Removes the directory of one target, if there is one."""
    stored = read_curated(spark, path, target_id, target)
    if stored is None:
        return
    # The files of one target lie in one directory.
    file = stored.select(F.input_file_name()).first()[0]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)


# --- raw snapshots ---------------------------------------------------------------


def save_raw(raw: DataFrame, path: str) -> None:
    raw.write.mode("append").parquet(path)


def read_raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Raw rows with an explicit schema, or ``None`` before the first snapshot."""
    return read_if_exists(spark, path, schema)


# --- feature store -----------------------------------------------------------------
#
# Vectors lie in bucketed files by key: the plan of a lookup moves the wanted keys to the buckets, not
# the store. A mark, written last, names the folder of the current generation; compaction and clearing
# start a new one.

FEATURE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
])
#: So many wanted keys are named in the filter, which reads their buckets only; more are joined.
NAMED_KEYS = 200


def _mark(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.option("wholetext", True).text(f"{path}/mark").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return json.loads(row[0]) if row else None


def _registered(spark: SparkSession, path: str, mark: dict) -> str:
    """The name under which this session knows the generation that ``mark`` describes."""
    folder = f"{path}/{mark['folder']}"
    name = f"feature_store_{hashlib.md5(folder.encode()).hexdigest()}"
    location = folder.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (key STRING, features ARRAY<FLOAT>) USING parquet "
        f"CLUSTERED BY (key) SORTED BY (key) INTO {mark['buckets']} BUCKETS LOCATION '{location}'"
    )
    spark.catalog.refreshTable(name)  # another session may have appended
    return name


def _new_generation(spark: SparkSession, buckets: int) -> dict:
    return {"folder": f"vectors-{uuid.uuid4().hex}", "buckets": buckets}


def _set_mark(spark: SparkSession, path: str, mark: dict) -> None:
    spark.createDataFrame([(json.dumps(mark),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/mark")


def _store(spark: SparkSession, path: str, buckets: int | None = None) -> tuple[str, dict]:
    """Table name and mark of the store; a new store gets ``buckets`` (the shuffle partitions, four a core at least)."""
    mark = _mark(spark, path)
    if mark is None:
        mark = _new_generation(
            spark, buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                  4 * spark.sparkContext.defaultParallelism))
        _set_mark(spark, path, mark)
    return _registered(spark, path, mark), mark


def _append(spark: SparkSession, name: str, rows: DataFrame) -> None:
    rows.select("key", "features").write.insertInto(name)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The store with one row per key: a retried or concurrent append may repeat some. Copies of a
    key share a bucket, so nothing moves."""
    mark = _mark(spark, path)
    if mark is None:
        return spark.createDataFrame([], FEATURE_SCHEMA)
    return spark.table(_registered(spark, path, mark)).dropDuplicates(["key"])


def lookup_features(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, features) of those ``keys`` that the store holds, each once.

    Only wanted rows are de-duplicated. A few keys are named in the filter, so Spark reads their
    buckets and skips row groups by the sorted keys; many are shuffled to the buckets.
    """
    mark = _mark(spark, path)
    if mark is None:
        return spark.createDataFrame([], FEATURE_SCHEMA)
    held, wanted = spark.table(_registered(spark, path, mark)), keys.select("key").distinct()
    few = wanted.limit(NAMED_KEYS + 1).collect()
    if len(few) <= NAMED_KEYS:
        held = held.where(F.col("key").isin([r["key"] for r in few]))
    else:
        held = held.join(wanted.repartition(mark["buckets"], "key"), "key", "left_semi")
    return held.dropDuplicates(["key"])


def upsert_features(
    df: DataFrame, text: str, path: str, features: FeatureSet | None = None,
    buckets: int | None = None, valid: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Computes and appends what the store lacks for the texts of ``df``; returns the store.

    Stored keys are never recomputed, and of the store only keys are read to find what is missing. Texts
    that are invalid (by default blank ones) have no vector and are not stored. The new texts, not their longer vectors, are
    dealt to the buckets; each task then writes one file.
    """
    spark = df.sparkSession
    features = features or FeatureSet()
    name, mark = _store(spark, path, buckets)
    missing = uncached_keys(df, text, spark.table(name), version=features.version)
    # Checked on the text: a filter on the vector would compute every vector twice. The key is made anew, else Spark
    # takes the join's partitions for the asked ones and merges them to about a task a core, of unlike sizes.
    wanted = missing.where((valid or not_blank)(F.col(text))).select(
        content_key(F.col(text), features.version).alias("key"), text).repartition(mark["buckets"], "key")
    _append(spark, name, assemble_features(wanted, text, features, valid=valid))
    return read_features(spark, path)


def featurise_with_store(
    df: DataFrame, text: str, row_id: str, path: str, features: FeatureSet | None = None,
    valid: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows with ``features`` from the store, computing misses once; null if invalid."""
    features = features or FeatureSet()
    upsert_features(df, text, path, features, valid=valid)
    keys = df.where(F.col(text).isNotNull()).select(content_key(F.col(text), features.version).alias("key"))
    wanted = lookup_features(df.sparkSession, path, keys)
    found = cached_lookup(df, text, wanted, spread_by=[row_id], version=features.version)
    return found.drop("key")


def compact_features(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """Rewrites the store with each key once and one file per bucket; the number of rows dropped.

    With ``buckets`` the store is dealt anew. Readers keep the generation they have; appends made
    while this runs go to the old one and are computed again when wanted.
    """
    mark = _mark(spark, path)
    if mark is None:
        return 0
    old = _registered(spark, path, mark)
    fresh = _new_generation(spark, buckets or mark["buckets"])
    name = _registered(spark, path, fresh)
    rows = spark.table(old).dropDuplicates(["key"])
    _append(spark, name, rows.repartition(fresh["buckets"], "key") if buckets else rows)
    dropped = spark.table(old).count() - spark.table(name).count()
    _set_mark(spark, path, fresh)
    return dropped


def clear_features(spark: SparkSession, path: str) -> None:
    """Empties the store by a new generation of as many buckets."""
    mark = _mark(spark, path)
    if mark is not None:
        _set_mark(spark, path, _new_generation(spark, mark["buckets"]))


def vacuum_features(spark: SparkSession, path: str) -> int:
    """Removes generations that the mark does not name; the number removed."""
    mark = _mark(spark, path)
    return 0 if mark is None else remove_others(spark, path, "vectors-", mark["folder"])
