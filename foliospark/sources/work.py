"""Where jobs keep intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers get whole texts in batches of 8 MB, unless the session asks for fewer bytes: an executor holds several at once."""
    asked = str(spark.conf.get(BATCH_BYTES)).rstrip("b")
    if not asked.isdigit() or not 0 < int(asked) <= BATCH:  # in another unit, unbounded, or more
        spark.conf.set(BATCH_BYTES, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster's driver and executors share. Where it is unset: a new local folder if all tasks run in the driver, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Spark's own file system for a path, the path in its form, and a function that makes others of such."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make(path), make


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later jobs start from these files, whatever executors are lost. Its shuffle files go once it is written."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Up to so many rows of a table of queries are sent to the scans of other tables; beyond, Spark chooses the joins.
FEW = 100_000
#: Up to so many ids alone (about 32 bytes each in a task's executor) are sent to the rows of a table that they hide; beyond, these rows would be shuffled by id.
SENT_IDS = 4_000_000


def few(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """df stored, and whether it has at most FEW rows; it is marked for broadcast then."""
    out = stored(df, name)
    is_few = out.count() <= FEW
    return (F.broadcast(out) if is_few else out), is_few


def large(df: DataFrame) -> DataFrame:
    """df marked as a side of a join that grows with the documents: Spark goes by the size of compressed files, and by rows before they are exploded, and would send many times that through the driver. The other side is still sent if few() marked it."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote (others are left alone), once nothing that is still to be run reads them."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            with contextlib.suppress(Exception):  # files that stay only take up room
                fs, to, _ = file_system(t.sparkSession, path)
                fs.delete(to, True)
