"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character 1- to 3-grams of the lower-cased text (what is not a letter counts as a space), hashed
into 2^17 buckets; term frequency is the share of the text's n-grams, times the bucket's IDF. Document
frequencies are counted over all documents that may be learned from, in one pass; partial counts are vectors
of fixed length, summed by the cluster.
Training: follow-the-regularised-leader with elastic-net (L1 and L2) penalties, per coordinate, on a sample of
`per_lang` documents of each language at most (chosen by a hash of the row's id and place), which is the model's documented
bound. One fifth of the sample is kept from training and sets the temperature that calibrates the scores.
Prediction: whole texts, in segments of bounded length, as one gather of weights for each n-gram.

Learned from: text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2. Inputs of a
prediction: the text alone.

Defined results: `und` with score 0 for a null text, one without a letter, or where nothing could be learned;
a null id counts as the empty string in the crc; repeated rows are repeated in the result; ties between
languages go to the first in sorted order; an empty table gives an empty result; other columns are passed by.
Style: free (mapInArrow and numpy).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, table, written

BITS = 17
N_MAX = 3
SCALE = 64.0
PER_LANG = 1000
FAN = 16
SEGMENT = 1 << 19
UND = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, owners, shared): code points of several texts back to back, a zero after each. A long text
    is cut into segments that share N_MAX - 1 characters; `shared` has the places of those at a segment's end,
    whose n-grams belong to the next one."""
    codes, starts, owners, shared, held = [], [], [], [], 0
    for k, text in enumerate(texts):
        own = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.where(_letters()[own], own, np.uint32(32))
        for at in range(0, max(1, len(own)), SEGMENT):
            part = own[at : at + SEGMENT + N_MAX - 1]
            shared.extend(range(held + SEGMENT, held + len(part)))
            starts.append(held)
            owners.append(k)
            codes += [part, np.zeros(1, np.uint32)]
            held += len(part) + 1
            if held >= SEGMENT:
                yield np.concatenate(codes), np.array(starts), np.array(owners), np.array(shared, int)
                codes, starts, owners, shared, held = [], [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.array(starts), np.array(owners), np.array(shared, int)


def _grams(codes: np.ndarray, shared: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram at each position; 1 << BITS where there is none that counts."""
    letter = codes > 32
    for n in range(1, N_MAX + 1):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        inside, some = np.ones(m, bool), np.zeros(m, bool)
        for k in range(n):
            h += codes[k : k + m] * _MULTIPLIERS[k]
            inside &= codes[k : k + m] > 0
            some |= letter[k : k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        out = (h >> np.uint32(32 - BITS)).astype(np.int32)
        inside[shared[shared < m]] = False
        out[~(inside & some)] = 1 << BITS
        yield out


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one text."""
    total = np.zeros((1 << BITS) + 1, np.int64)
    for codes, _, _, shared in _segments([text]):
        for g in _grams(codes, shared):
            total += np.bincount(g, minlength=len(total))
    idx = np.flatnonzero(total[:-1])
    return idx, total[idx]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2^BITS + 1, languages): IDF and scale folded in; the last row is zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the softmax and the number of n-grams, for each text."""
        out, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for codes, starts, owners, shared in _segments(texts):
            for g in _grams(codes, shared):
                at = np.minimum(starts, len(g) - 1)
                sums = np.add.reduceat(self.weights[g], at, axis=0)
                n = np.add.reduceat((g < 1 << BITS).astype(np.int64), at)
                if len(at) > 1 and at[-1] == at[-2]:  # texts too short for an n-gram of this length
                    sums[starts >= len(g)], n[starts >= len(g)] = 0, 0
                np.add.at(out, owners, sums)
                np.add.at(total, owners, n)
        return out / np.maximum(total, 1)[:, None] + self.bias, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        raw, total = self.logits(texts)
        p = softmax(raw / self.temperature)
        best = p.argmax(axis=1)
        none = total == 0
        return [UND if none[k] else self.langs[b] for k, b in enumerate(best)], np.where(none, 0.0, p[np.arange(len(texts)), best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
    """Weights (buckets + 1, languages); the last row is the bias. rows: (buckets, values, language)."""
    d = (1 << BITS) + 1
    z, n = np.zeros((d, n_langs)), np.zeros((d, n_langs))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            idx, x, y = rows[r]
            idx, x = np.append(idx, d - 1), np.append(x, 1.0)
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            after = ni + g * g
            z[idx] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
            n[idx] = after
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes the held rows likeliest, by a search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.mean(np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12))

    grid = np.linspace(-4, 4, 161)
    return float(np.exp(min(grid, key=loss)))


def held_out(id_col):
    """Whether crc32(id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def tree_sums(partial: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows (part, n, val: a vector as bytes), summed in steps of `fan` until that many rows are left at most: no task adds
    more than `fan` vectors, however many tasks counted."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            n += sum(b.column(b.schema.get_field_index("n")).to_pylist())
            for raw in b.column(b.schema.get_field_index("val")):
                total = total + np.frombuffer(raw.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "val"])

    high = partial.agg(F.max("part")).first()[0] or 0
    while high >= fan:
        high //= fan
        partial = partial.withColumn("g", F.expr(f"part div {fan}")).groupBy("g").applyInArrow(add, "part long, n long, val binary")
    return partial


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    small_batches(docs.sparkSession)
    learn = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = {r[0]: r[1] for r in learn.groupBy(lang_col).count().collect()}  # a row for each language
    langs = sorted(per)
    if not langs:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0))
    share = F.lit(0.0)
    for x in langs:
        share = F.when(F.col(lang_col) == x, F.lit(min(1.0, per_lang / per[x]))).otherwise(share)
    # by row, so that an id or a text with many rows is sampled as others are
    taken = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 40)) < share * float(1 << 40)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document frequencies of this task's rows, and the features of sampled rows."""
        part, df, rows, flag = TaskContext.get().partitionId(), np.zeros(1 << BITS, np.int64), 0, np.zeros((1 << BITS) + 1, bool)
        for b in batches:
            kept = []
            for text, lang, sampled in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text.as_py()
                rows += 1
                if sampled:
                    idx, c = counts_of(text)
                    df[idx] += 1
                    kept.append((lang, idx.astype("<u4").tobytes(), c.astype("<u4").tobytes()))
                    continue
                flag[:] = False
                for codes, _, _, shared in _segments([text]):
                    for g in _grams(codes, shared):
                        flag[g] = True
                df += flag[:-1]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(kept), pa.int64()), pa.array([0] * len(kept), pa.int64()), pa.array([k[0] for k in kept]), pa.array([k[1] for k in kept], pa.binary()), pa.array([k[2] for k in kept], pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([rows], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([df.astype("<i8").tobytes()], pa.binary())], names=names)

    names = ["part", "n", "lang", "idx", "val"]
    found = written(learn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), taken.alias("taken")).mapInArrow(count, "part long, n long, lang string, idx binary, val binary"), "langid-counts")

    sums = tree_sums(found.filter("lang is null").select("part", "n", "val")).collect()  # FAN vectors of fixed length at most
    n_docs = sum(r.n for r in sums)
    df = sum((np.frombuffer(bytes(r.val), "<i8") for r in sums), np.zeros(1 << BITS, np.int64))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    rows = []
    sample = found.filter("lang is not null").orderBy("lang", F.xxhash64("idx", "val")).collect()  # about per_lang rows a language
    for r in sample:
        idx, c = np.frombuffer(bytes(r.idx), "<u4").astype(np.int64), np.frombuffer(bytes(r.val), "<u4")
        if len(idx):
            rows.append((idx, SCALE * c / c.sum() * idf[idx], langs.index(r.lang)))
    fit = [r for k, r in enumerate(rows) if k % 5]
    hold = rows[::5]
    w = ftrl(fit, len(langs))
    raw = np.array([x @ w[idx] + w[-1] for idx, x, _ in hold]).reshape(-1, len(langs))
    table_ = np.zeros(((1 << BITS) + 1, len(langs)), np.float32)
    table_[:-1] = w[:-1] * idf[:, None] * SCALE
    return Model(langs, table_, w[-1], temperature(raw, np.array([y for _, _, y in hold], int)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a language: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose text has a language with that score at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != UND and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
