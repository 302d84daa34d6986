"""The folder that driver and executors share, for tables a job keeps for itself."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of our own if all tasks run in this process. It is
    removed at the end of the process, or by `remove`."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(shared_folder, "own", None)
        if root is None:
            root = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="marlstone-core-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_made):
        try:
            remove(path)
        except Exception:  # the JVM may have ended before
            return
