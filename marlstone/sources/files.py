"""Small files on any file system that Spark reaches: whole or not there, written by the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """(file system, qualified path)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def listed(spark: SparkSession, path: str) -> list:
    """The statuses of what lies in a folder; none where nothing is there."""
    fs, where = place(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = place(spark, path)
    return fs.exists(where)


def read(spark: SparkSession, path: str) -> str:
    fs, where = place(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write aside, then rename in one step. False, and nothing changed, where the file is there and isn't to be replaced."""
    fs, where = place(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_pending-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1 if replace else 0)
    if replace:
        how[0] = kind.OVERWRITE
    try:
        hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, where, how)
    except (Py4JJavaError, PySparkException):
        fs.delete(aside, False)
        if not replace and fs.exists(where):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> bool:
    """Whether something was there."""
    fs, where = place(spark, path)
    return fs.exists(where) and fs.delete(where, True)
