"""The folder that the driver and all executors share, and tables that are written there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The kept tables of the running application.
_KEPT: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factlattice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """A path as Hadoop knows it, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: What one task reads of a shuffle or a table, in bytes as stored. Facts are texts that compress by 20 to 80 times, so that
#: the engine's own 64 and 128 MB are gigabytes in a task's memory.
TASK_BYTES = 4 << 20


def fitted(spark: SparkSession, size: int) -> None:
    """Lets the number of tasks grow with the input's size in bytes, not the rows of a task; settings that are finer already stay."""
    conf = spark.conf
    many = -(-size // TASK_BYTES)
    if many > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(many))
    for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if _bytes(spark, conf.get(name)) > TASK_BYTES:
            conf.set(name, str(TASK_BYTES))
    # Else each small file would be a task.
    if _bytes(spark, conf.get("spark.sql.files.openCostInBytes")) > TASK_BYTES // 16:
        conf.set("spark.sql.files.openCostInBytes", str(TASK_BYTES // 16))
    # A table in a few parts is written without sorting whole rows by part.
    if conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0":
        conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")


def _bytes(spark: SparkSession, value: str) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder, in parts by the columns given, and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    # Small row groups, so that a file can be read by several tasks.
    (df.write.partitionBy(*by) if by else df.write).option("parquet.block.size", str(2 * TASK_BYTES)).parquet(path)
    where, fs = path_of(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], *by: str) -> DataFrame:
    """The table of a key, made and written the first time that the application wants it."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        _KEPT[key] = written(make(), *by)
    return _KEPT[key]


def is_kept(spark: SparkSession, key: tuple) -> bool:
    return (spark.sparkContext.applicationId, *key) in _KEPT
