"""A sink of numbered blocks: each is there whole and once, or not at all."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError


class BlockSink:
    """Blocks of rows in a folder, as JSON lines or another format.

    A block is written aside, in a folder whose name Spark's readers pass by, and comes to be by one rename that fails where the
    block is there already. So a job that dies within a block leaves nothing to be read of it; if the block is written again
    under its number, by a retry or a second writer, the first whole one stays. `vacuum` removes what was left aside. The
    file system must rename folders in one step, as HDFS and local ones do. Files that lie in the folder besides are read too."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "json"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(self._at())] if fs.exists(self._at()) else []

    @staticmethod
    def _name(number: int) -> str:
        return f"block-{number:012d}"

    def blocks(self) -> list[int]:
        return sorted(int(n[6:]) for n in self._names() if n.startswith("block-"))

    def next(self) -> int:
        return max(self.blocks(), default=-1) + 1

    def write(self, rows: DataFrame, number: int) -> bool:
        """Whether this call made the block; False where it was there before or another writer was first."""
        if number < 0:
            raise ValueError("blocks are numbered from 0")
        if number in self.blocks():
            return False
        aside = f"_pending-{uuid.uuid4().hex}"
        rows.write.format(self.fmt).save(f"{self.path}/{aside}")
        return self._rename(aside, self._name(number))

    def _rename(self, aside: str, name: str) -> bool:
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs
        src, dst = self._at(aside), self._at(name)
        where = src.getFileSystem(self.spark._jsc.hadoopConfiguration())
        context = fs.FileContext.getFileContext(where.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(where.makeQualified(src), where.makeQualified(dst), none)
        except (Py4JJavaError, PySparkException):
            if int(name[6:]) in self.blocks():  # another writer was first
                where.delete(src, True)
                return False
            raise
        return True

    def read(self, schema: str | None = None) -> DataFrame | None:
        """All whole blocks; None where nothing was written."""
        if not any(not n.startswith(("_", ".")) for n in self._names()):
            return None
        reader = self.spark.read.format(self.fmt).option("recursiveFileLookup", "true")
        return (reader.schema(schema) if schema else reader).load(self.path)

    def remove(self, number: int) -> bool:
        """Whether there was such a block."""
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.delete(self._at(self._name(number)), True)

    def missing(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key no block has."""
        kind = dict(rows.dtypes)[key]
        held = self.read(f"`{key}` {kind}")
        return rows if held is None else rows.join(held.select(F.col(key)).distinct(), key, "left_anti")

    def vacuum(self) -> int:
        """Removes what writers that died left aside; no writer may be at work. How many folders went."""
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [n for n in self._names() if n.startswith("_pending-")]
        for n in gone:
            fs.delete(self._at(n), True)
        return len(gone)
