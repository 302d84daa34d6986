"""Top-k retrieval: dense, lexical, fused, mapped to parents; several formulations of a question fused.

Rankings are tables (qid, chunk_id, rank from 1, score). Ties go to the lower chunk id, so results do not hang on
the order of rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import embedding, lexical
from marlstone.operators.streams import ROUND, Best, arrow, few, passes_of, ranked_by_score, ranking_schema, small_batches

RRF_K, SIDE_K, TOP_K = 60, 20, 5
QUERY_BLOCK, PASS = 1024, 16
#: Scores, or components of vectors, that a task works on at a time.
CELLS = 1 << 20


def rank_by(rows: DataFrame, k: int, *order, group: str = "qid") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Cosine top-k of queries (qid, v) over vectors (id, v), exact; or over texts (id, text), whose vectors `model` makes where
    they are scored.

    Queries go in blocks of bounded size to every task, each as one matrix; a task keeps k rows a query while it
    streams its vectors once for PASS blocks, CELLS scores at a time, and those partial answers are merged. Vectors are never
    shuffled."""
    spark = vectors.sparkSession
    small_batches(spark)
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    if k <= 0:
        return spark.createDataFrame([], ranking_schema(*kinds, rank=True))
    out, schema = None, ranking_schema(*kinds)
    fields = arrow(schema)
    for blocks in passes_of(queries.select("qid", "v"), QUERY_BLOCK, PASS):
        made = []
        for block in blocks:
            q = np.array([r.v for r in block], np.float64)
            made.append(([r.qid for r in block], q / np.where((n := np.sqrt((q * q).sum(axis=1))) == 0, 1.0, n)[:, None]))
        shared = spark.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = [Best(qids, k) for qids, _ in shared.value]
            step = max(1, CELLS // max(q.size // len(q) + len(q) for _, q in shared.value))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    ids = b.column(0).to_pylist()
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False) if model is None else model([t or "" for t in b.column(1).to_pylist()])
                    x = np.array(x, np.float64).reshape(b.num_rows, -1)
                    x /= np.where((n := np.sqrt((x * x).sum(axis=1))) == 0, 1.0, n)[:, None]
                    for own, (_, q) in zip(best, shared.value):
                        own.see(ids, x @ q.T)
            yield from (own.batch(fields) for own in best)

        part = vectors.select("id", "v" if model is None else "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return ranked_by_score(out, k) if out is not None else spark.createDataFrame([], ranking_schema(*kinds, rank=True))


def fuse(lists: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, list_no, chunk_id, rank): qid, chunk_id, score, first and last list."""
    return lists.groupBy("qid", "chunk_id").agg(
        F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"), F.max("list_no").alias("last")
    )


def _numbered(*rankings: DataFrame) -> DataFrame:
    out = None
    for i, r in enumerate(rankings):
        own = r.select("qid", F.lit(i).alias("list_no"), "chunk_id", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def hybrid(dense_rank: DataFrame, lexical_rank: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    fused = fuse(_numbered(dense_rank, lexical_rank), rrf_k)
    return rank_by(fused, k, F.round("score", ROUND).desc(), "first").select("qid", "chunk_id", "rank", "score")


def to_parents(ranking: DataFrame, children: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Parents of ranked children, in order of their first child, with that child's score; unresolved ones go.

    The ranking is k rows a question: it goes to the children, and what it names to the parents, where those lie."""
    rows = few(children.select("chunk_id", "parent_id").filter("parent_id <> ''").join(few(ranking), "chunk_id"))
    known = parents.select(F.col("chunk_id").alias("parent_id")).join(rows, "parent_id", "left_semi").distinct()
    rows = rows.join(known, "parent_id")
    per = rows.groupBy("qid", "parent_id").agg(F.min("rank").alias("best"), F.min_by("score", "rank").alias("score"))
    return rank_by(per, k, "best").select("qid", F.col("parent_id").alias("chunk_id"), "rank", "score")


def several(rankings: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fuses rankings (qid, list_no, chunk_id, rank) of several formulations; ties go by the last list that has the
    chunk, then by id."""
    return rank_by(fuse(rankings, rrf_k), k, F.round("score", ROUND).desc(), "last", "chunk_id").select("qid", "chunk_id", "rank", "score")


def with_hypothetical(base: DataFrame, extra: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fuses a ranking with that of a hypothetical answer; questions without one keep theirs, scores too."""
    has = extra.select("qid").distinct()
    alone = base.join(has, "qid", "left_anti").filter(F.col("rank") <= k).select("qid", "chunk_id", "rank", "score")
    both = _numbered(base.join(has, "qid", "left_semi"), extra)
    return alone.unionByName(several(both, k, rrf_k))


def citations(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, citations: array of (rank, chunk_id, score, doc_key, section_id) in order."""
    rows = chunks.select("chunk_id", "doc_key", "section_id").join(few(ranking), "chunk_id")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "doc_key", "section_id"))).alias("citations"))


STRATEGIES = ("dense", "bm25", "hybrid", "parent_doc", "hybrid_parent")


@dataclass
class Bundle:
    """What a strategy needs; parts are lazy, so nothing is built that isn't asked for."""

    chunks: DataFrame
    children: DataFrame | None = None
    dim: int = embedding.DIM
    model: object = None
    kept: dict = field(default_factory=dict)

    def vectors(self, of: str) -> DataFrame:
        key = "v", of
        if key not in self.kept:
            self.kept[key] = embedding.embed(self.chunks if of == "chunks" else self.children, "chunk_id", "text", self.dim, self.model)
        return self.kept[key]

    def terms(self, of: str) -> lexical.LexicalIndex:
        key = "t", of
        if key not in self.kept:
            self.kept[key] = lexical.build(self.chunks if of == "chunks" else self.children)
        return self.kept[key]


def retrieve(bundle: Bundle, questions: DataFrame, strategy: str = "dense", k: int = TOP_K, side_k: int = SIDE_K, rrf_k: int = RRF_K) -> DataFrame:
    """Rankings for questions (qid, question)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if strategy.endswith(("parent_doc", "parent")) and bundle.children is None:
        raise ValueError(f"{strategy} needs children")
    of = "children" if strategy in ("parent_doc", "hybrid_parent") else "chunks"

    def by_vector(n):
        q = embedding.embed(questions, "qid", "question", bundle.dim, bundle.model).withColumnRenamed("id", "qid")
        rows = (bundle.chunks if of == "chunks" else bundle.children).select(F.col("chunk_id").alias("id"), "text")
        return dense(rows, q, n, bundle.model or functools.partial(embedding.hashed_rows, dim=bundle.dim))

    if strategy == "dense":
        return by_vector(k)
    if strategy == "bm25":
        return lexical.topk(bundle.terms(of), questions, k)
    if strategy == "parent_doc":
        return to_parents(by_vector(side_k), bundle.children, bundle.chunks, k)
    if strategy == "hybrid":
        return hybrid(by_vector(side_k), lexical.topk(bundle.terms(of), questions, side_k), k, rrf_k)
    fused = hybrid(by_vector(side_k), lexical.topk(bundle.terms(of), questions, side_k), 2 * side_k, rrf_k)
    return to_parents(fused, bundle.children, bundle.chunks, k)


def retrieve_many(bundle: Bundle, formulations: DataFrame, strategy: str = "dense", k: int = TOP_K, **how) -> DataFrame:
    """Rankings for formulations (qid, list_no, question), 0 being the original, each retrieved in the same pass."""
    keyed = formulations.select(F.concat_ws("|", "qid", "list_no").alias("key"), "qid", "list_no", "question")
    found = retrieve(bundle, keyed.select(F.col("key").alias("qid"), "question"), strategy, k, **how)
    return several(found.withColumnRenamed("qid", "key").join(keyed.select("key", "qid", "list_no"), "key").select("qid", "list_no", "chunk_id", "rank"), k)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Top-1 agreement and mean overlap of two rankings: one row."""
    sets = lambda r, n: r.groupBy("qid").agg(F.collect_set("chunk_id").alias(n), F.min_by("chunk_id", "rank").alias(n + "1"))
    rows = sets(a, "a").join(sets(b, "b"), "qid")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("a1") == F.col("b1")).cast("double")).alias("top1"),
        F.avg(F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a"))).alias("overlap"),
    )


def approximate(vectors: DataFrame, queries: DataFrame, k: int, centres: int = 64, probes: int = 36, sample: int = 20_000, seed: int = 1) -> DataFrame:
    """Approximate cosine top-k by an inverted file, for vectors of length one: those nearest to one of the centres are a cell,
    and a query looks into the `probes` cells whose centres are nearest to it, each read by the query's own exact scan.

    The centres are fitted on `sample` vectors at most, chosen by a hash of the id; every vector is indexed. More centres,
    and probes in proportion, suit more vectors; `centres` equal to `probes` is exact."""
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    if k <= 0:
        return spark.createDataFrame([], ranking_schema(*kinds, rank=True))
    rows = vectors.select("v").orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).collect()
    if not rows:
        return spark.createDataFrame([], ranking_schema(*kinds, rank=True))
    x = np.array([r.v for r in rows], np.float64)
    near = x[np.random.default_rng(seed).permutation(len(x))[:centres]]
    for _ in range(10):  # k-means on the sphere
        own = (x @ near.T).argmax(axis=1)
        sums = np.zeros_like(near)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        near = np.where(length[:, None] > 0, sums / np.where(length == 0, 1.0, length)[:, None], near)
    shared, schema = spark.sparkContext.broadcast(near), ranking_schema(*kinds)
    fields, out = arrow(schema), None
    for blocks in passes_of(queries.select("qid", "v"), QUERY_BLOCK, PASS):
        made = []
        for block in blocks:
            q = np.array([r.v for r in block], np.float64)
            made.append(([r.qid for r in block], q, np.argsort(-(q @ near.T), axis=1, kind="stable")[:, :probes]))
        asked = spark.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            # for each block the queries of each cell: only they meet the cell's vectors
            best = [Best(qids, k) for qids, *_ in asked.value]
            looks = [[np.flatnonzero((cells == c).any(axis=1)) for c in range(len(shared.value))] for *_, cells in asked.value]
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_pylist()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                own = (x @ shared.value.T).argmax(axis=1)
                for c in np.unique(own):
                    at = np.flatnonzero(own == c)
                    names = [ids[j] for j in at]
                    for held, look, (_, q, _) in zip(best, looks, asked.value):
                        if len(look[c]):
                            held.see(names, x[at] @ q[look[c]].T, look[c])
            yield from (held.batch(fields) for held in best)

        part = vectors.select("id", "v").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return ranked_by_score(out, k) if out is not None else spark.createDataFrame([], ranking_schema(*kinds, rank=True))
