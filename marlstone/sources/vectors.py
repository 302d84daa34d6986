"""A vector table with upserts by id, kept as Parquet."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import point_id
from marlstone.operators.retrieval import dense
from marlstone.operators.streams import ROUND, Best


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.sqrt((x * x).sum(axis=1))) == 0, 1.0, n)[:, None]


def upserted(base: DataFrame, changes: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """The union of both with the last write for each key; writes with one version go to `changes`."""
    both = base.withColumn("__w", F.lit(0)).unionByName(changes.withColumn("__w", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("__w").desc())
    return both.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r", "__w")


class VectorStore:
    """upsert, query, len, close over versions of a Parquet table.

    Rows lie in `buckets` by a hash of their id, and a pointer `current-<version>` names the folder of each. An upsert writes its
    own rows, and again only those buckets that it touches and that held rows before; the others stay where they are. Folders
    that a version names are never changed. A pointer is written aside and comes to be by one rename, so a crash leaves the
    version before; the highest one counts. `vacuum` removes what the latest versions don't name. The number of buckets is
    fixed when a store is made. `recreate` starts empty; without it a store attaches to what is there, so that nothing need be
    embedded again."""

    def __init__(self, spark: SparkSession, path: str, recreate: bool = False, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table: DataFrame | None = None
        self.held: tuple[list, np.ndarray] | None = None
        self.version, self.folders = 0, {}
        versions = self._versions()
        if recreate:
            self.version = versions[-1] if versions else 0
        elif versions:  # what is there must be readable
            now = json.loads(self.spark.read.text(f"{self.path}/{self._pointer(versions[-1])}").first()[0])
            self.version, self.buckets = now["version"], now["buckets"]
            self.folders = {int(b): name for b, name in now["folders"].items()}
            self.table = self._read(self.folders)
        elif self._fs().exists(self._at("current")):  # a store of earlier make
            head = spark.read.text(f"{self.path}/current").first()[0]
            if head.startswith("{"):
                now = json.loads(head)
                self.version, self.buckets = now["version"], now["buckets"]
                self.folders = {int(b): name for b, name in now["folders"].items()}
                self.table = self._read(self.folders)
            else:  # of one folder, without buckets: the next upsert deals it out
                self.version, name = int(head.split()[0]), head.split()[1]
                self.table = spark.read.parquet(f"{self.path}/{name}")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("current").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return [x.getPath().getName() for x in self._fs().listStatus(where)] if self._fs().exists(where) else []

    @staticmethod
    def _pointer(version: int) -> str:
        return f"current-{version:012d}"

    def _versions(self) -> list[int]:
        return sorted(int(n[8:]) for n in self._names() if n.startswith("current-"))

    def _point(self) -> None:
        """The present version's pointer, whole or not at all."""
        now = json.dumps({"version": self.version, "buckets": self.buckets, "folders": self.folders})
        aside = f"pending-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(now,)], "value string").coalesce(1).write.text(f"{self.path}/{aside}")
        if self._fs().exists(self._at(self._pointer(self.version))) or not self._fs().rename(self._at(aside), self._at(self._pointer(self.version))):
            raise RuntimeError(f"version {self.version} was made by another writer")

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the latest `keep` versions names, and the pointers before them: how many names went."""
        if keep < 1:
            raise ValueError("the latest version stays")
        kept = self._versions()[-keep:]
        named = {self._pointer(v) for v in kept}
        for v in kept:
            folders = json.loads(self.spark.read.text(f"{self.path}/{self._pointer(v)}").first()[0])["folders"]
            named |= {f.split("/")[0] for f in folders.values()}
        gone = [n for n in self._names() if n not in named] if kept else []
        for n in gone:
            self._fs().delete(self._at(n), True)
        return len(gone)

    def _read(self, folders: dict[int, str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{folders[b]}" for b in sorted(folders)]) if folders else None

    def _dealt(self, rows: DataFrame) -> dict[int, str]:
        """Rows written by bucket, in files of even size; the folder of each bucket that has any."""
        name = f"v{self.version}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets))
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        found = [x.getPath().getName() for x in self._fs().listStatus(self._at(name))]
        return {int(n[7:]): f"{name}/{n}" for n in found if n.startswith("bucket=")}

    def upsert(self, ids_and_vectors: DataFrame, order: str | None = None) -> int:
        """Rows (id, v): how many ids were written. The same id again overwrites; within one batch the last row of an id counts, by
        the column `order` or else as rows come."""
        self.version += 1
        last = F.col(order) if order else F.monotonically_increasing_id()
        new = ids_and_vectors.select("id", F.col("v").cast("array<double>").alias("v"), point_id(F.col("id").cast("string")).alias("point"), F.lit(self.version).cast("long").alias("version"), last.alias("__at"))
        latest = Window.partitionBy("id").orderBy(F.col("__at").desc())
        new = new.withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r", "__at")
        if self.table is not None and not self.folders:
            new = upserted(self.table, new)
        made = self._dealt(new)
        written = self._read(made).filter(F.col("version") == self.version).count() if made else 0
        if again := {b: f for b, f in made.items() if b in self.folders}:
            made |= self._dealt(upserted(self._read({b: self.folders[b] for b in again}), self._read(again)))
        self.folders = {**self.folders, **made}
        self._point()
        self.table, self.held = self._read(self.folders) if self.folders else self.spark.createDataFrame([], new.schema), None
        return written

    def upsert_lists(self, ids: list[str], vectors: list[list[float]]) -> int:
        if len(ids) != len(vectors):
            raise ValueError(f"{len(ids)} ids for {len(vectors)} vectors")
        if not ids:
            return 0
        rows = [(i, v, n) for n, (i, v) in enumerate(zip(ids, vectors))]
        return self.upsert(self.spark.createDataFrame(rows, "id string, v array<double>, n long"), "n")

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """Rankings for queries (qid, v); none for k <= 0 or an empty store."""
        if self.table is None or k <= 0:
            return self.spark.createDataFrame([], "qid string, chunk_id string, rank long, score double")
        return dense(self.table, queries, k)

    def attach(self, least_bytes: int = 256 << 20) -> bool:
        """Hold the vectors on the driver, if they take fewer bytes than that, for single questions without a Spark job."""
        n = len(self)
        width = self.table.select(F.max(F.size("v"))).first()[0] if n else 0
        if n == 0 or n * width * 8 > least_bytes:
            return False
        rows = self.table.select("id", "v").collect()  # bounded above
        self.held = [r.id for r in rows], unit_rows(np.array([r.v for r in rows], np.float64))
        return True

    def nearest(self, v: list[float], k: int) -> list[tuple[str, float]]:
        """(id, cosine) of the k nearest of an attached store."""
        ids, x = self.held
        best = Best([0], k)
        best.see(ids, x @ unit_rows(np.array([v], np.float64)).T)
        return [(i, s / 10**ROUND) for i, s in zip(best.ids[0], best.scores[0])]

    def attachable(self, n: int) -> bool:
        """Whether it already holds n rows or more."""
        return len(self) >= n

    def __len__(self) -> int:
        return 0 if self.table is None else self.table.count()

    def close(self) -> None:
        self.table = self.held = None


class InsertStore(VectorStore):
    """A store that always begins empty, tells nearness as 1 - distance, and whose length counts what was put in, repeats and
    all; what it holds is one vector an id, as ever."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, recreate=True, buckets=buckets)
        self.put_in = 0

    def upsert(self, ids_and_vectors: DataFrame, order: str | None = None) -> int:
        n = ids_and_vectors.count()
        super().upsert(ids_and_vectors, order)
        self.put_in += n
        return n

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """Rankings with the cosine distance, and the score that it gives; a ranking without a distance scores zero."""
        rows = super().query(queries, k).withColumn("distance", F.lit(1.0) - F.col("score"))
        return rows.withColumn("score", F.coalesce(F.lit(1.0) - F.col("distance"), F.lit(0.0)))

    def __len__(self) -> int:
        return self.put_in
