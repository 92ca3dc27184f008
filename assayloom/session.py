"""Session defaults and the one shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Application id -> folder, for local sessions without a shared folder of their own.
_LOCAL_FOLDERS: dict[str, str] = {}
# Paths handed out by fresh_path, per application id; clean_up removes them.
_HANDED_OUT: dict[str, list[str]] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "assayloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; keyword keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a ``local`` master without that setting gets a fresh temporary folder: on a cluster
    a machine-local path would be lost with its machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses.

    Results may still read it lazily, so it stays until ``clean_up`` or the end of the session.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    handed = _HANDED_OUT.setdefault(spark.sparkContext.applicationId, [])
    if not handed:
        atexit.register(clean_up, spark)
    handed.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Removes every path that ``fresh_path`` gave this application; the number removed."""
    if spark.sparkContext._jsc is None:  # the session has ended
        return 0
    handed = _HANDED_OUT.get(spark.sparkContext.applicationId, [])
    conf, removed = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while handed:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(handed.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def remove_others(spark: SparkSession, path: str, prefix: str, current: str) -> int:
    """Deletes the folders of ``path`` whose names begin with ``prefix``, but ``current``; how many."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in system.listStatus(root)
           if f.getPath().getName().startswith(prefix) and f.getPath().getName() != current]
    return sum(system.delete(p, True) for p in old)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts the lineage,
    survives lost executors, and gives every later reader the same rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def constant_table(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A small table given as name -> (Spark type, values).

    Arrow data becomes a local relation inside the plan: no Python workers, known size.
    """
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(),
             "bigint": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    return spark.createDataFrame(
        pa.table({n: pa.array(v, types[t]) for n, (t, v) in columns.items()})
    )


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """For heavy work per row: the rows hashed over ``spark.sql.shuffle.partitions`` tasks, unless ``df``, a
    scan, has a task for every core by itself."""
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
