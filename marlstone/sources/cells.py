"""A stored approximate index: vectors in cells on disk, with codes of a few bytes that lookup tables score."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.streams import Best, arrow, blocks_of, ranked_by_score, ranking_schema

#: Dimensions of a part of a vector, words of a part's codebook, queries of one pass, bytes of the largest sample to fit on.
PART, WORDS, QUERY_BLOCK, SAMPLE_BYTES = 8, 256, 256, 128 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.sqrt((x * x).sum(axis=1))) == 0, 1.0, n)[:, None]


def directions(x: np.ndarray, n: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Centres of unit vectors, of length one: k-means on the sphere."""
    near = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(rounds):
        own = (x @ near.T).argmax(axis=1)
        sums = np.zeros_like(near)
        np.add.at(sums, own, x)
        near = np.where((sums * sums).sum(axis=1)[:, None] > 0, unit(sums), near)
    return near


def codebook(x: np.ndarray, words: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Plain k-means of a part's differences; short samples give as many words as they have rows."""
    at = x[np.random.default_rng(seed).permutation(len(x))[:words]]
    for _ in range(rounds):
        own = closest(x, at)
        count = np.bincount(own, minlength=len(at))
        sums = np.stack([np.bincount(own, x[:, d], len(at)) for d in range(x.shape[1])], axis=1)
        at = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], at)
    return np.concatenate([at, np.zeros((words - len(at), x.shape[1]))])


def closest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1) - 2 * (x @ words.T)).argmin(axis=1)


class Codes:
    """Centres of cells and, for what vectors differ from them by, a codebook for each part of PART dimensions."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, words: int = WORDS, seed: int = 1) -> "Codes":
        x = unit(x)
        centres = directions(x, cells, seed=seed)
        apart = cls._parts(x - centres[(x @ centres.T).argmax(axis=1)])
        few = apart[np.random.default_rng(seed).permutation(len(apart))[: 16 * words]]
        return cls(centres, np.stack([codebook(few[:, m], words, seed=seed) for m in range(few.shape[1])]))

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        m = -(-x.shape[1] // PART)
        return np.pad(x, ((0, 0), (0, m * PART - x.shape[1]))).reshape(len(x), m, PART)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (a byte a part) of each unit vector."""
        cell = (x @ self.centres.T).argmax(axis=1)
        apart = self._parts(x - self.centres[cell])
        return cell, np.stack([closest(apart[:, m], self.books[m]) for m in range(apart.shape[1])], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and part, the product with each word."""
        return np.einsum("qmp,mwp->qmw", self._parts(q), self.books)


class CellIndex:
    """build, append, search over vectors (id, v) by cosine.

    Rows lie in a folder a cell (`cells/cell=7/`), sorted by id, with their code beside the vector. A search reads the codes of
    the cells that its queries probe and of no other (partitions are pruned before reading, and vectors are another column),
    scores them by lookup tables, keeps `shortlist` rows a query, reads those rows' vectors from their cells, and ranks
    by the exact cosine. The model is fitted on a bounded sample chosen by a hash of the id (`sample` rows, SAMPLE_BYTES at
    most); every vector is indexed. Probing all cells with a shortlist as long as the index is exact. A cell is many files
    where it is large, so a crowded one is many tasks.

    Null vectors and ids are passed over; a vector of zeros scores zero; repeated ids are rows of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/model").first()  # written last: an index without it was never finished
        self.cells = row.cells
        if self.cells:
            centres = np.array(row.centres).reshape(row.cells, -1)
            self.codes = Codes(centres, np.array(row.books).reshape(-1, row.words, PART))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = 64, sample: int = 20_000, words: int = WORDS, seed: int = 1) -> "CellIndex":
        spark, path = vectors.sparkSession, path.rstrip("/")
        kind = dict(vectors.dtypes)["id"]
        rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).filter("id is not null and v is not null")
        dims = rows.select(F.max(F.size("v"))).first()[0] or 0
        sample = min(sample, max(1, SAMPLE_BYTES // (8 * max(1, dims))))
        x = np.array([r.v for r in rows.select("v").orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).collect()], np.float64)
        if len(x):
            made = Codes.fit(x, min(cells, len(x)), words, seed)
            n, centres, books = len(made.centres), made.centres.ravel().tolist(), made.books.ravel().tolist()
        else:
            n, centres, books = 0, [], []
        model = spark.createDataFrame([(n, words, centres, books, kind)], "cells int, words int, centres array<double>, books array<double>, kind string")
        if n:
            cls._add(rows, path, made)
        model.coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path)

    @staticmethod
    def _add(rows: DataFrame, path: str, codes: Codes) -> None:
        shared = rows.sparkSession.sparkContext.broadcast(codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, code = shared.value.encode(unit(_matrix(b.column("v"))))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], names=["id", "v", "code", "cell"])

        dealt = rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, v array<double>, code binary, cell int").hint("rebalance", "cell")
        dealt.sortWithinPartitions("cell", "id").write.mode("append").partitionBy("cell").option("parquet.block.size", 8 << 20).parquet(f"{path}/cells")

    def append(self, vectors: DataFrame) -> None:
        """More rows, by the model that is there."""
        if not self.cells:
            raise ValueError("an index that was built without rows has no model")
        rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).filter("id is not null and v is not null")
        self._add(rows, self.path, self.codes)

    @functools.cached_property
    def _schema(self) -> str:
        kind = self.spark.read.parquet(f"{self.path}/model").first().kind
        return f"id {kind}, v array<double>, code binary, cell int"

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """What is stored, of some cells only if they are given."""
        df = self.spark.read.schema(self._schema).parquet(f"{self.path}/cells")
        return df if cells is None else df.filter(F.col("cell").isin(cells))

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.codes.centres.T), axis=1, kind="stable")[:, :probes]

    def search(self, queries: DataFrame, k: int, probes: int = 8, shortlist: int | None = None) -> DataFrame:
        """Rankings of queries (qid, v), in blocks of QUERY_BLOCK."""
        kinds = dict(queries.dtypes)["qid"], self._schema.split()[1].rstrip(",")
        out = None
        if k > 0 and self.cells:
            for block in blocks_of(queries.select("qid", F.col("v").cast("array<double>").alias("v")).filter("v is not null"), QUERY_BLOCK):
                part = self._pass(block, kinds, k, min(probes, self.cells), max(k, 40 * k if shortlist is None else shortlist))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], ranking_schema(*kinds, rank=True)) if out is None else ranked_by_score(out, k)

    def _pass(self, block: list, kinds: tuple[str, str], k: int, probes: int, shortlist: int) -> DataFrame:
        qids, q = [r.qid for r in block], unit(np.array([r.v for r in block], np.float64))
        near = self.probed(q, probes)
        cells = [int(c) for c in np.unique(near)]
        schema = f"n int, id {kinds[1]}, score double"
        fields, final = arrow(schema), arrow(ranking_schema(*kinds))
        shared = self.spark.sparkContext.broadcast((self.codes, q, {c: np.flatnonzero((near == c).any(axis=1)) for c in cells}))

        def by_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, q, looks = shared.value
            tables, parts = codes.tables(q), np.arange(len(codes.books)) * codes.books.shape[1]
            best = Best(list(range(len(q))), shortlist)
            for b in batches:
                cell = b.column("cell").to_numpy(zero_copy_only=False)
                ids = b.column("id").to_pylist()
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1) + parts
                for c in np.unique(cell):
                    at, who = np.flatnonzero(cell == c), looks[int(c)]
                    base = q[who] @ codes.centres[c]
                    scores = np.stack([tables[i].ravel()[code[at]].sum(axis=1) for i in who], axis=1) + base
                    best.see([ids[j] for j in at], scores, who)
            rows = best.batch(pa.schema([("qid", pa.int32()), ("chunk_id", fields.field(1).type), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(rows.columns, schema=fields)

        near_rows = self.rows(cells).select("id", "code", "cell").mapInArrow(by_code, schema)
        short = ranked_by_score(near_rows.select(F.col("n").alias("qid"), F.col("id").alias("chunk_id"), "score"), shortlist)
        # at most QUERY_BLOCK x shortlist rows of two small columns
        short = F.broadcast(short.select(F.col("qid").alias("n"), F.col("chunk_id").alias("id")).distinct())

        def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, q, _ = shared.value
            for b in batches:
                if b.num_rows:
                    n = b.column("n").to_numpy()
                    score = (unit(_matrix(b.column("v"))) * q[n]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in n], final.field(0).type), b.column("id"), pa.array(score)], schema=final)

        return self.rows(cells).select("id", "v").join(short, "id").select("n", "id", "v").mapInArrow(exactly, ranking_schema(*kinds))

    def share_read(self, queries: DataFrame, probes: int) -> float:
        """The share of all rows that lies in the cells which the mean query probes."""
        sizes = {r.cell: r["count"] for r in self.rows().groupBy("cell").count().collect()}  # a row a cell
        total, n, read = sum(sizes.values()), 0, 0
        for block in blocks_of(queries.select("v"), QUERY_BLOCK):
            near = self.probed(unit(np.array([r.v for r in block], np.float64)), probes)
            read += sum(sizes.get(int(c), 0) for row in near for c in row)
            n += len(block)
        return read / max(1, total * n)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
