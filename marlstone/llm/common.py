"""Helpers that the corpus operators share: tables, the shared folder, row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has written, by path.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all tasks
    run in this process (as in tests); on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: the lineage ends there, and a lost executor costs nothing but its own tasks.

    The folder stays until `dropped` or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("errorifexists").parquet(path)
    _made[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def owned(spark: SparkSession, path: str) -> str:
    """The path, to be removed by `dropped` or at the end of the process like what `written` writes."""
    _made[path] = spark
    return path


def dropped(*frames: DataFrame) -> None:
    """Remove what `written` wrote, once nothing reads it any more."""
    for df in frames:
        _remove(df.written_to)


def _remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_made):
        try:
            _remove(path)
        except Exception:  # the JVM may have ended before
            return


def utf8(text):
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of a bounded number of bytes, whatever the length of the texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "9223372036854775807", "9223372036854775807b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def row_keys(id_col: str, text_col: str):
    """Two columns that tell rows apart by id and text, null ids included, to join by without null-safe equality."""
    nulls = F.col(id_col).isNull()
    return [
        F.when(nulls, F.lit("")).otherwise(F.col(id_col).cast("string")).alias("k1"),
        F.xxhash64(nulls, F.col(text_col)).alias("k2"),
    ]
