"""Ranked lexical search, exact, by the threshold algorithm over impact-sorted lists and a forward index.

A term of a document has an impact, which grows with its frequency and falls with the document's length; a score is a sum of
weight times impact over an item's terms, all in integers but the weights' logarithm.

1. Items are read in blocks of bounded bytes; a block's distinct terms are numbered and broadcast.
2. One pass over the documents writes the forward index of those terms: a row a document with its length and, for each term
   of the block that it holds, number and frequency. Document frequencies and lengths are aggregated from it.
3. Each task reads its part of the forward index in blocks of ENTRIES entries and sorts a list a term by impact. For each item
   it reads the lists of the item's terms in turn, STEP postings of each in the first turn and twice as many in each later
   one; every document met for the first time is looked up in the forward index and scored in full. The threshold is what a
   document still unmet could score: the weighted sum of the next impacts. Reading stops once it falls strictly below the k-th
   score so far, that of earlier blocks of the task included, or once the lists end. So ties are kept, to be told apart by id.
4. A task yields k rows an item at most; those are merged in two steps, MERGED tasks first.

No posting is shuffled, no list spans tasks, and a frequent term or a large group of equal documents is spread like all
others. Memory per task: one Arrow batch, one block of entries, the weights of one block of items. Any style was free here.

Defined results: null and empty texts have no term and are not counted; a null doc_id comes last among equal scores; repeated
rows are documents of their own; repeated item ids are ranked each; an item without terms, or an empty table on either
side, has no row; other columns are passed by.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, small_batches, table, written

K = 10
ITEM_BYTES, ENTRIES, STEP, MERGED = 4_000_000, 1_500_000, 32, 64
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

FORWARD = "doc_id long, n long, terms array<int>, tf array<int>"
FOUND = "item int, doc_id long, score long, part int"


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of digits, ASCII letters and anything beyond ASCII; only A-Z are lowered."""
    if not text:
        return []
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER))


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """Blocks of (id, terms and repeats) of so many bytes of text, or of one item: all items, one block at a time."""
    block, held = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = Counter(terms_of(row.t))
        if words:
            block.append((row.i, words))
            held += len(row.t.encode())
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Lists:
    """A block of the forward index and its lists by falling impact."""

    def __init__(self, ids: list, lens: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.terms, self.impact = ids, terms, impact
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        order = np.lexsort((-impact, terms))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Random access: full scores of documents by their rows of the forward index."""
        lens = self.ends[docs] - self.starts[docs]
        at = np.repeat(self.starts[docs] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        return np.add.reduceat(weights[self.terms[at]] * self.impact[at], np.concatenate([[0], np.cumsum(lens)[:-1]]))

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: list, k: int) -> None:
        """Sorted access in turns. wanted: the item's terms; weights: of all terms, zero for others; best: a heap of (score, -id
        or so, ...), the k best so far."""
        start, end = self.bounds[wanted], self.bounds[wanted + 1]
        some = (end > start) & (weights[wanted] > 0)
        start, end, each = start[some], end[some], weights[wanted][some]
        met = np.zeros(len(self.ids), bool)
        step = STEP
        while len(start):
            ahead = start[:, None] + np.arange(step)
            docs = np.unique(self.list_doc[ahead[ahead < end[:, None]]])
            docs = docs[~met[docs]]
            if len(docs):
                met[docs] = True
                got = self.scores(docs, weights)
                if len(best) == k:
                    near = got >= best[0][0]
                    docs, got = docs[near], got[near]
                if len(docs) > k:
                    least = np.partition(got, len(got) - k)[len(got) - k]
                    docs, got = docs[got >= least], got[got >= least]
                for d, s in zip(docs.tolist(), got.tolist()):
                    doc_id = self.ids[d]
                    entry = (s, doc_id is not None, -(doc_id or 0))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            start = start + step
            left = start < end
            start, end, each = start[left], end[left], each[left]
            threshold = int((each * self.list_impact[start]).sum())
            if len(best) == k and threshold < best[0][0]:
                break
            step *= 2


def search(docs: DataFrame, items: DataFrame, k: int = K, entries: int = ENTRIES, item_bytes: int = ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, by blocks of items."""
    if k < 1:
        raise ValueError("k must be positive")
    small_batches(docs.sparkSession)
    kind = dict(items.dtypes)[item_col]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in item_blocks(items, item_col, item_text_col, item_bytes):
        found = _search(plain, block, k, entries, kind)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _search(docs: DataFrame, block: list[tuple], k: int, entries: int, kind: str) -> DataFrame | None:
    spark = docs.sparkSession
    names = sorted(set().union(*(words for _, words in block)))
    number = {t: i for i, t in enumerate(names)}
    shared = spark.sparkContext.broadcast(number)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lens, ns, terms, tfs = [], [], [], []
            for text in batch.column(1):
                found = Counter(terms_of(text.as_py()))
                ns.append(found.total())
                some = [(known[t], c) for t, c in found.items() if t in known]
                lens.append(len(some))
                terms += [t for t, _ in some]
                tfs += [c for _, c in some]
            ends = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))],
                names=["doc_id", "n", "terms", "tf"],
            )

    index = written(docs.mapInArrow(forward, FORWARD).filter("n > 0"), "forward")
    shared.destroy()
    n_docs, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        dropped(index)
        return None
    df = {r.t: r.n for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # the block's terms at most
    weighed = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(names))], np.int64)
    asked = [(np.array([number[t] for t in words], np.int64), np.array(list(words.values()), np.int64)) for _, words in block]
    plan = spark.sparkContext.broadcast((weighed, asked))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed, asked = plan.value
        part = TaskContext.get().partitionId()
        best: list[list] = [[] for _ in asked]
        held, size = [], 0

        def go() -> None:
            ids = [i for b in held for i in b.column(0).to_pylist()]
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            lens = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held]).astype(np.int64)
            terms = np.concatenate([b.column(2).flatten().to_numpy() for b in held]).astype(np.int64)
            tf = np.concatenate([b.column(3).flatten().to_numpy() for b in held]).astype(np.int64)
            lists = Lists(ids, lens, terms, impacts(tf, np.repeat(n, lens), n_docs, total), len(weighed))
            of_item = np.zeros(len(weighed), np.int64)
            for (wanted, repeats), heap in zip(asked, best):
                of_item[wanted] = weighed[wanted] * repeats
                lists.search(wanted, of_item, heap, k)
                of_item[wanted] = 0

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= entries:
                go()
                held, size = [], 0
        if held:
            go()
        rows = [(i, -e[2] if e[1] else None, e[0], part) for i, heap in enumerate(best) for e in heap if e[0] > 0]
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["item", "doc_id", "score", "part"])

    order = F.desc("score"), F.asc_nulls_last("doc_id")
    found = index.mapInArrow(best_of, FOUND).withColumn("part", F.expr(f"part div {MERGED}"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")  # a block of items
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = "regexp_extract_all(translate(text, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS t FROM documents
), whole AS (
  SELECT count(*) AS n_docs, sum(len(t)) AS total FROM doc WHERE len(t) > 0
), item AS (
  SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL
), posting AS (
  SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, len(t) AS n, unnest(t) AS t FROM doc) WHERE t IN (SELECT t FROM item) GROUP BY ALL
), weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posting, whole GROUP BY t, n_docs
), scored AS (
  SELECT i, item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM posting JOIN item USING (t) JOIN weight USING (t), whole GROUP BY i, item_id, d, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {K}
"""
