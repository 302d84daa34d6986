"""What the exhaustive top-k scans share: blocks of queries, the best rows so far, the final merge, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROUND = 9
#: Rows that are broadcast at most; more of them meet by a shuffle.
FEW = 100_000


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of a bounded number of bytes, whatever the length of the texts, where the session sets no bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "9223372036854775807", "9223372036854775807b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with so many bytes of text in a column, or of one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def few(rows: DataFrame) -> DataFrame:
    """Rows kept and counted, such as k a question: up to FEW go to the tables that they meet, and those stay where they are."""
    kept = rows.persist()
    return F.broadcast(kept) if kept.count() <= FEW else kept


def ranking_schema(qid: str, chunk_id: str, rank: bool = False) -> str:
    return f"qid {qid}, chunk_id {chunk_id}, " + ("rank long, " if rank else "") + "score double"


def arrow(schema: str) -> pa.Schema:
    """For use on the driver, where DDL can be read."""
    return to_arrow_schema(StructType.fromDDL(schema))


def blocks_of(queries: DataFrame, size: int) -> Iterator[list[Row]]:
    """Queries in lists of at most `size`; one partition is on the driver at a time."""
    block: list[Row] = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def passes_of(queries: DataFrame, size: int, blocks: int) -> Iterator[list[list[Row]]]:
    """Blocks of queries in lists of at most `blocks`: what one scan answers."""
    held: list[list[Row]] = []
    for block in blocks_of(queries, size):
        held.append(block)
        if len(held) == blocks:
            yield held
            held = []
    if held:
        yield held


class Best:
    """The k best rows of each query: by rounded score, then by id."""

    #: Rows at a time: a score (in units of 1e-9) and a row's place among the ids are compared as one number.
    ROWS = 1 << 14
    #: Scores of that size, in units of 1e-9, are no 64-bit integers.
    LARGEST = 9e9

    def __init__(self, qids: list, k: int):
        self.qids, self.k = qids, k
        self.ids: list[list] = [[] for _ in qids]
        self.scores: list[list[int]] = [[] for _ in qids]
        self.least = np.full(len(qids), np.iinfo(np.int64).min)

    def see(self, ids: list, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores: rows by queries, all of them or those at the given places."""
        queries = np.arange(len(self.qids)) if queries is None else queries
        for at in range(0, len(ids), self.ROWS):
            self._see(ids[at : at + self.ROWS], scores[at : at + self.ROWS], queries)

    def _see(self, ids: list, scores: np.ndarray, queries: np.ndarray) -> None:
        if max(scores.max(initial=0.0), -scores.min(initial=0.0)) >= self.LARGEST:
            raise OverflowError(f"scores from {self.LARGEST:.0f} on can't be told apart to {ROUND} places")
        # only queries whose best row here reaches their k-th so far
        some = np.flatnonzero(np.rint(np.fmax.reduce(scores, axis=0) * 10**ROUND).astype(np.int64) >= self.least[queries])
        if not len(some):
            return
        queries = queries[some]
        whole = np.rint(scores[:, some] * 10**ROUND).astype(np.int64)
        order = sorted(range(len(ids)), key=ids.__getitem__)
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        k = min(self.k, len(ids))
        if np.abs(whole).max(initial=0) < np.iinfo(np.int64).max // self.ROWS - 1:
            both = whole * self.ROWS + (self.ROWS - 1 - place)[:, None]  # the lowest id is best
            top = np.argpartition(both, len(ids) - k, axis=0)[len(ids) - k :]
        else:
            top = np.stack([np.lexsort((place, -whole[:, c]))[:k] for c in range(whole.shape[1])], axis=1)
        held = np.take_along_axis(whole, top, axis=0)
        for c in np.flatnonzero(held.max(axis=0) >= self.least[queries]):
            i = int(queries[c])
            rows = list(zip(self.scores[i], self.ids[i])) + [(int(v), ids[j]) for v, j in zip(held[:, c], top[:, c])]
            rows.sort(key=lambda r: (-r[0], r[1]))
            del rows[self.k :]
            self.scores[i], self.ids[i] = [v for v, _ in rows], [x for _, x in rows]
            if len(rows) == self.k:
                self.least[i] = rows[-1][0]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(q, c, v / 10**ROUND) for q, names, own in zip(self.qids, self.ids, self.scores) for c, v in zip(names, own)]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(("qid", "chunk_id", "score"), cols)}, schema=schema)


def ranked_by_score(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", ROUND).desc(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("qid", "chunk_id", "rank", "score")
