"""Hashed text vectors: a native sparse form and an Arrow form for batches, which agree."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import white_tokens
from marlstone.operators.streams import small_batches

DIM = 768


class Places(dict):
    """Places of tokens, kept for as many as a worker may hold."""

    MOST = 200_000

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[token] = place = int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % (2 * self.dim)
        return place


places_by = functools.lru_cache(maxsize=4)(Places)


def hashed(text: str | None, dim: int = DIM) -> np.ndarray:
    """Signed counts of hashed lower-cased tokens, log-damped, length one."""
    kept = places_by(dim)
    places = np.array([kept[t] for t in (text or "").lower().split()], np.int64)
    counts = np.bincount(places % dim, np.where(places < dim, 1.0, -1.0), dim) if len(places) else np.zeros(dim)
    v = np.sign(counts) * np.log1p(np.abs(counts))
    return v / (np.sqrt(v @ v) or 1.0)


def hashed_rows(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """hashed() of each text, as a matrix: all counts at once, logarithms of the few counts that aren't zero."""
    kept, flat, ends = places_by(dim), [], [0]
    for t in texts:
        flat += (t or "").lower().split()
        ends.append(len(flat))
    places = np.fromiter(map(kept.__getitem__, flat), np.int64, len(flat))
    at = np.repeat(np.arange(len(texts)), np.diff(ends)) * dim + places % dim
    v = np.bincount(at, np.where(places < dim, 1.0, -1.0), len(texts) * dim).astype(np.float64) if len(at) else np.zeros(len(texts) * dim)
    some = np.flatnonzero(v)
    v[some] = np.sign(v[some]) * np.log1p(np.abs(v[some]))
    v = v.reshape(len(texts), dim)
    v /= np.array([np.sqrt(row @ row) or 1.0 for row in v]).reshape(-1, 1)
    return v


def embed(texts: DataFrame, id_col: str, text_col: str = "text", dim: int = DIM, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """id, v (array<double>). `model` takes a list of texts; the default is the hashed embedder."""
    how = model or functools.partial(hashed_rows, dim=dim)
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(how([x or "" for x in b.column(1).to_pylist()]), np.float64).reshape(b.num_rows, -1)
            flat = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "v"])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, v array<double>")


def sparse(texts: DataFrame, id_col: str, text_col: str = "text", dim: int = DIM) -> DataFrame:
    """id, idx, w: the same vectors as rows, by expressions alone. The 128-bit hash modulo 2 * dim comes from its last digits,
    or, where that is no power of two, from eight digits at a time. A text's counts, `dim` at most, are gathered to take
    their length."""
    m = 2 * dim
    tok = texts.select(F.col(id_col).alias("id"), F.explode(white_tokens(F.lower(text_col))).alias("tok"))
    digest = F.md5(F.col("tok").cast("binary"))
    eight = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    if m & (m - 1):
        place = F.lit(0).cast("long")
        for at in (1, 9, 17, 25):
            place = (place * (2**32 % m) + eight(at)) % m
    else:
        place = eight(25) % m
    signed = tok.select("id", place.cast("int").alias("place")).select("id", (F.col("place") % dim).alias("idx"), F.when(F.col("place") < dim, 1).otherwise(-1).alias("s"))
    counts = signed.groupBy("id", "idx").agg(F.sum("s").alias("c")).filter("c <> 0")
    damped = counts.select("id", F.struct("idx", (F.signum("c") * F.log1p(F.abs("c"))).alias("w")).alias("x"))
    per = damped.groupBy("id").agg(F.collect_list("x").alias("xs"))
    length = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    return per.select("id", length.alias("n"), F.explode("xs").alias("x")).select("id", "x.idx", (F.col("x.w") / F.col("n")).alias("w"))
