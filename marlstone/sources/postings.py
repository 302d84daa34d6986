"""A stored inverted index: postings by term in buckets on disk, with what bounds each segment's list beside it."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import lexical_tokens
from marlstone.operators.lexical import B, COMMON, EPSILON, K1, words_of
from marlstone.operators.streams import ROUND, Best, arrow, blocks_of, pieces, ranked_by_score, ranking_schema, small_batches

#: Chunks of a segment, buckets of terms, questions of one pass, segments that each question reads first.
SEGMENT, BUCKETS, QUERY_BLOCK, FIRST = 4096, 64, 256, 4


class PostingIndex:
    """build, append, topk over chunks (chunk_id, text) by BM25, with the scores of the exhaustive scan.

    Chunks are dealt into segments of at most SEGMENT. `lists` holds a row for each term of each segment: its chunks' places and
    frequencies as pairs of 32-bit integers (`body`), sorted by term in folders by the term's hash, so that a question reads the folders of its own terms,
    and of those files the row groups that can hold them. Beside each list stand its greatest frequency and its least
    length, which together bound what the list can add to a score, whatever the average length is by then.

    A question's bound on a segment is the sum of its terms' weights times those. Only these small columns are read at first;
    the FIRST segments of greatest bound are scored, which gives a k-th score, and of the others only those whose bound
    reaches it. A question with fewer than k positive scores is filled up with the lowest ids that have no term of it, at zero.

    The driver holds a number for each segment and question of a block; at very many segments, larger ones (SEGMENT) keep that
    small. Weights come from all segments, appended ones included; an append writes new segments and leaves the others alone. A null
    text has no term; repeated ids are chunks of their own, but for filling up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = [json.loads(r.value) for r in spark.read.text(f"{self.path}/facts").collect()]  # a line an append
        self.kind = facts[0]["kind"]
        self.n, self.total, self.segments = sum(f["n"] for f in facts), sum(f["total"] for f in facts), sum(f["segments"] for f in facts)
        self.avgdl = self.total / self.n if self.n else 0.0

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> "PostingIndex":
        cls._add(chunks, path.rstrip("/"), 0)
        return cls(chunks.sparkSession, path)

    def append(self, chunks: DataFrame) -> "PostingIndex":
        self._add(chunks, self.path, self.segments)
        return PostingIndex(self.spark, self.path)

    @staticmethod
    def _add(chunks: DataFrame, path: str, first: int) -> None:
        spark, kind = chunks.sparkSession, dict(chunks.dtypes)["chunk_id"]
        small_batches(spark)
        rows = chunks.select("chunk_id", "text").filter("chunk_id is not null")
        kinds = f"segment long, term string, n int, most int, least int, body binary, ids array<{kind}>, dl binary, total long"
        fields = arrow(kinds)

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n = _task() << 20, 0
            held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []  # ids, words, lengths

            def made() -> pa.RecordBatch:
                ids, lens = pa.concat_arrays([x for x, _, _ in held]), np.concatenate([x for _, _, x in held])
                words = pa.concat_arrays([x for _, x, _ in held]).dictionary_encode()
                names = words.dictionary
                key = np.repeat(np.arange(len(ids), dtype=np.int64), lens) + words.indices.to_numpy().astype(np.int64) * len(ids)
                pair, tf = np.unique(key, return_counts=True)
                term, place = pair // len(ids), pair % len(ids)
                ends = np.searchsorted(term, np.arange(len(names) + 1))
                starts = ends[:-1]
                most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(lens[place], starts)) if len(names) else (tf, tf)
                bodies = np.stack([place, tf], axis=1).astype("<i4")
                body = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(bodies)])
                head = {"ids": pa.array([ids.to_pylist()], fields.field("ids").type), "dl": pa.array([lens.astype("<i4").tobytes()], pa.binary()), "total": pa.array([int(lens.sum())])}
                own = {"term": names, "n": pa.array(np.diff(ends)), "most": pa.array(most), "least": pa.array(least), "body": body}
                cols = []
                for f in fields:
                    if f.name == "segment":
                        cols.append(pa.array(np.full(len(names) + 1, part + n)))
                    else:
                        at = head.get(f.name, pa.nulls(1, f.type)), own.get(f.name, pa.nulls(len(names), f.type))
                        cols.append(pa.concat_arrays([x.cast(f.type) for x in at]))
                return pa.RecordBatch.from_arrays(cols, schema=fields)

            for b in (piece for whole in batches for piece in pieces(whole, 1)):
                for at in range(0, b.num_rows, SEGMENT):
                    piece = b.slice(at, SEGMENT)
                    if held and sum(len(x) for x, _, _ in held) + piece.num_rows > SEGMENT:
                        yield made()
                        held, n = [], n + 1
                    words, ends = [], [0]
                    for text in piece.column(1):
                        words += words_of(text.as_py())
                        ends.append(len(words))
                    held.append((piece.column(0).take(pa.array(np.arange(piece.num_rows))), pa.array(words, pa.binary()).cast(pa.string()), np.diff(ends)))
            if held:
                yield made()

        staged = f"{path}/staged-{first}"
        rows.mapInArrow(segments, kinds).write.mode("overwrite").parquet(staged)
        made = spark.read.schema(kinds).parquet(staged)
        numbers = [r.segment for r in made.filter("total is not null").select("segment").orderBy("segment").collect()]  # a row a segment
        order = spark.createDataFrame([(s, first + i) for i, s in enumerate(numbers)], "segment long, own int")
        made = made.join(F.broadcast(order), "segment").drop("segment").withColumnRenamed("own", "segment")  # two numbers a segment
        heads = made.filter("total is not null").select("segment", "ids", "dl", "total")
        heads.write.mode("append").parquet(f"{path}/ids")
        lists = made.filter("term is not null").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
        lists = lists.select("bucket", "term", "segment", "n", "most", "least", "body").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "segment")
        lists.write.mode("append").partitionBy("bucket").option("parquet.block.size", 4 << 20).parquet(f"{path}/lists")
        n = heads.select(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        spark.createDataFrame([(json.dumps({"n": n.n, "total": n.total, "segments": len(numbers), "kind": kind}),)], "value string").coalesce(1).write.mode("append").text(f"{path}/facts")

    @functools.cached_property
    def _lists(self) -> DataFrame:
        return self.spark.read.schema("term string, segment int, n int, most int, least int, body binary, bucket int").parquet(f"{self.path}/lists")

    def lists(self, terms: list[str]) -> DataFrame:
        """The lists of some terms: only their buckets' folders are read, and there only row groups that can hold them."""
        buckets = {r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b")).collect()}
        return self._lists.filter(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(terms))

    @functools.cached_property
    def _mean(self) -> float:
        """The mean raw weight of all terms, from the lists' lengths."""
        df = self._lists.groupBy("term").agg(F.sum("n").alias("df"))
        return df.select(F.avg(F.log(self.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("m")).first().m or 0.0

    def topk(self, questions: DataFrame, k: int) -> DataFrame:
        """qid, chunk_id, rank, score of questions (qid, question)."""
        kinds = dict(questions.dtypes)["qid"], self.kind
        out = None
        if k > 0 and self.n:
            for block in blocks_of(questions.select("qid", lexical_tokens(F.col("question")).alias("w")), QUERY_BLOCK):
                part = self._pass(block, kinds, k)
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], ranking_schema(*kinds, rank=True)) if out is None else out

    def _pass(self, block: list, kinds: tuple[str, str], k: int) -> DataFrame:
        terms = sorted({t for r in block for t in r.w})
        lists = self.lists(terms) if terms else self._lists.limit(0)
        # small columns first: a row a term, then one a question and segment
        df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()} if terms else {}
        raw = {t: float(np.log(self.n - d + 0.5) - np.log(d + 0.5)) for t, d in df.items()}
        idf = {t: w if w >= 0 else EPSILON * self._mean for t, w in raw.items()}
        asked = [{t: idf[t] * r.w.count(t) for t in set(r.w) if t in idf} for r in block]
        bounds = self._bounds(lists, asked)
        order = np.argsort(-bounds, axis=1, kind="stable")
        first = [{int(s) for s in row[:FIRST] if bounds[i, s] > 0} for i, row in enumerate(order)]
        rows = self._scored(lists, block, asked, first, k)
        least = {}
        for i, own in enumerate(rows):
            least[i] = own[-1][1] if len(own) == k else 0.0
        slack = 10.0**-ROUND
        rest = [{int(s) for s in np.flatnonzero(bounds[i] > 0) if s not in first[i] and bounds[i, s] >= least[i] - slack} for i in range(len(block))]
        self.read = sum(map(len, first)) + sum(map(len, rest)), int((bounds > 0).sum())  # segments scored, of those with a term
        more = self._scored(lists, block, asked, rest, k) if any(rest) else [[] for _ in block]
        best = [sorted(a + b, key=lambda x: (-x[1], x[0]))[:k] for a, b in zip(rows, more)]
        short = [i for i, own in enumerate(best) if sum(s > 0 for _, s in own) < k]
        found = [(r.qid, c, s) for i, (r, own) in enumerate(zip(block, best)) if i not in set(short) for c, s in own]
        out = self.spark.createDataFrame(found, ranking_schema(*kinds))
        if short:
            out = out.unionByName(self._filled([block[i].qid for i in short], [asked[i] for i in short], lists, kinds, k))
        return ranked_by_score(out, k)

    def _bounds(self, lists: DataFrame, asked: list[dict]) -> np.ndarray:
        """What each segment can give to each question at most."""
        bounds = np.zeros((len(asked), self.segments))
        if not any(asked):
            return bounds
        shared, avgdl, segments = self.spark.sparkContext.broadcast(_askers(asked)), self.avgdl or 1.0, self.segments

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(asked), segments))
            for b in batches:
                segment, most, least = (b.column(i).to_numpy() for i in (1, 2, 3))
                bound = most * (K1 + 1) / (most + K1 * (1 - B + B * least / avgdl))
                for term, s, x in zip(b.column(0).to_pylist(), segment, bound):
                    who, weights = shared.value[term]
                    sums[who, s] += np.maximum(0.0, weights) * x
            q, s = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s), pa.array(sums[q, s])], names=["q", "s", "x"])

        rows = lists.select("term", "segment", "most", "least").mapInArrow(own, "q long, s long, x double").groupBy("q", "s").agg(F.sum("x").alias("x")).toArrow()
        bounds[rows["q"].to_numpy(), rows["s"].to_numpy()] = rows["x"].to_numpy()
        return bounds

    def _scored(self, lists: DataFrame, block: list, asked: list[dict], wanted: list[set], k: int) -> list[list[tuple]]:
        """The k best (chunk_id, score) of each question within its own segments. A segment's lists come together in one task:
        SEGMENT chunks and the block's terms at most."""
        by_segment: dict[int, list[int]] = {}
        for i, own in enumerate(wanted):
            for s in own:
                by_segment.setdefault(s, []).append(i)
        if not by_segment:
            return [[] for _ in block]
        shared = self.spark.sparkContext.broadcast((_askers(asked), len(asked), by_segment, self.avgdl or 1.0))
        fields = arrow(f"n int, chunk_id {self.kind}, score double")

        def score(key: tuple[pa.Scalar, ...], table: pa.Table, names: pa.Table) -> pa.Table:
            askers, m, by_segment, avgdl = shared.value
            ids, who = names["ids"].combine_chunks().flatten(), by_segment.get(key[0].as_py(), [])
            sums = _sums(table, names, askers, m, who, avgdl)
            rows = []
            for j, i in enumerate(who):
                some = np.flatnonzero(sums[j])
                if len(some) > k:  # those from the k-th score on, equal ones too
                    whole = np.rint(sums[j][some] * 10**ROUND)
                    some = some[whole >= np.partition(whole, len(whole) - k)[len(whole) - k]]
                if len(some):
                    own = Best([i], k)
                    own.see(ids.take(pa.array(some)).to_pylist(), sums[j][some][:, None])
                    rows += [(i, c, v / 10**ROUND) for c, v in zip(own.ids[0], own.scores[0])]
            cols = list(zip(*rows)) or [[], [], []]
            return pa.table([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

        segments = sorted(by_segment)
        own = lists.filter(F.col("segment").isin(segments)).select("segment", "term", "body")
        names = self._ids().filter(F.col("segment").isin(segments))
        rows = own.groupBy("segment").cogroup(names.groupBy("segment")).applyInArrow(score, f"n int, chunk_id {self.kind}, score double")
        top = rows.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("r") <= k)
        out: list[list[tuple]] = [[] for _ in block]
        for r in top.orderBy("n", "r").collect():  # k rows a question of the block
            out[r.n].append((r.chunk_id, r.score))
        return out

    def _ids(self) -> DataFrame:
        return self.spark.read.schema(f"segment int, ids array<{self.kind}>, dl binary").parquet(f"{self.path}/ids")

    def _filled(self, qids: list, asked: list[dict], lists: DataFrame, kinds: tuple[str, str], k: int) -> DataFrame:
        """Questions with few positive scores: every chunk is scored, zero for those without a term."""
        shared = self.spark.sparkContext.broadcast((_askers(asked), self.avgdl or 1.0))
        final = arrow(ranking_schema(*kinds))

        def score(_key: tuple[pa.Scalar, ...], table: pa.Table, names: pa.Table) -> pa.Table:
            askers, avgdl = shared.value
            best = Best(qids, k)
            best.see(names["ids"][0].as_py(), _sums(table, names, askers, len(qids), range(len(qids)), avgdl).T)
            return pa.Table.from_batches([best.batch(final)])

        own = lists.select("segment", "term", "body")
        return own.groupBy("segment").cogroup(self._ids().groupBy("segment")).applyInArrow(score, ranking_schema(*kinds))


def _askers(asked: list[dict]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each term's questions and its weights in them."""
    own: dict[str, tuple[list, list]] = {}
    for i, a in enumerate(asked):
        for t, w in a.items():
            who, weights = own.setdefault(t, ([], []))
            who.append(i)
            weights.append(w)
    return {t: (np.array(who), np.array(weights)) for t, (who, weights) in own.items()}


def _sums(table: pa.Table, names: pa.Table, askers: dict, m: int, who, avgdl: float) -> np.ndarray:
    """Scores of a segment's chunks for some of m questions, from its lists; terms that many ask for are multiplied as a matrix."""
    dl = np.frombuffer(names["dl"][0].as_py(), "<i4")
    damping, n = K1 * (1 - B + B * dl / avgdl), len(dl)
    sums, place = np.zeros((len(who), n)), np.full(m, -1)
    place[list(who)] = np.arange(len(who))
    often, held = [], []
    for term, body in zip(table["term"].to_pylist(), table["body"].to_pylist()):
        if term not in askers:
            continue
        own, weights = askers[term]
        own = place[own]
        weights, own = weights[own >= 0], own[own >= 0]
        if not len(own):
            continue
        at, tf = np.frombuffer(body, "<i4").reshape(-1, 2).T
        part = tf * (K1 + 1) / (tf + damping[at])
        if len(own) > COMMON:
            often.append(np.bincount(own, weights, len(who)))
            held.append(np.bincount(at, part, n))
            if len(often) == COMMON:
                sums += np.array(often).T @ np.array(held)
                often, held = [], []
        else:
            for j, w in zip(own, weights):
                sums[j, at] += w * part
    return sums + np.array(often).T @ np.array(held) if often else sums


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
