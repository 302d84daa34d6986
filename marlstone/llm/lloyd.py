"""Exact k-means by Lloyd's rounds on integer vectors.

Components become integers (floor of 256 times the component), so sums, squared distances and centroids are exact and results
don't hang on the order of rows. The first centroids are the k vectors whose ids hash lowest. In each round the centroids
(k x dims integers, a fixed bound) are broadcast; mapInPandas subtracts each centroid from a batch of vectors in NumPy,
squares, sums, and argmin takes the lowest centroid of equal ones. A task emits one row of sums and a count a centroid; a
groupBy adds those of all tasks and the driver reads k rows. Vectors are never shuffled: each round is one pass over
the integers, which are written once. Memory per task: one Arrow batch and a block of ROWS x dims differences.

Integers of more than 27 bits are reckoned with as Python integers, so nothing wraps round; integers of over 52 bits, squared
distances and inertias that are no longs raise.

Defined results: vectors of another length, or with null, NaN or infinite components, are left out, as are null vectors; a
null id hashes as an empty one; equal hashes go by their vector's components; repeated rows count each; fewer vectors than
k give as many clusters; a centroid without vectors stays; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, small_batches, table, written

DIMS, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors of a block of differences; integers below this are safe in 64 bits for up to 2 ** 7 dimensions.
ROWS, SAFE, LARGEST = 1024, 1 << 27, 1 << 52

ASSIGNED = "vec_id long, cluster int, distance long"


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v: kept vectors as arrays of integers."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    finite = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    large = F.raise_error(F.lit("a component is too large for exact sums"))
    scaled = F.transform(x, lambda e: F.when(F.abs(e) * scale < LARGEST, F.floor(e * F.lit(float(scale)))).otherwise(large.cast("long")))
    return vectors.filter((F.size(vec_col) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest of the nearest centroids of each row, and the squared distance to it, in exact integers."""
    big = max(int(np.abs(a).max(initial=0)) for a in (rows, centroids)) >= SAFE
    if big:
        rows, centroids = rows.astype(object), centroids.astype(object)
    each = np.empty((len(centroids), len(rows)), rows.dtype)
    for c, centroid in enumerate(centroids):
        apart = rows - centroid
        each[c] = (apart * apart).sum(axis=1)
    which = each.argmin(axis=0)
    return which, each[which, np.arange(len(rows))]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for k in range(0, len(frame), ROWS):
            part = frame.iloc[k : k + ROWS]
            yield part["vec_id"], np.stack(part["v"].to_numpy()).astype(np.int64)


def _sums(shared, dims: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        sums, counts = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)

        def held() -> pd.DataFrame:
            some = np.flatnonzero(counts)
            return pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some], "s": pd.Series(sums[some].tolist(), dtype=object)})

        for _, rows in _blocks(frames):
            which, _ = nearest(rows, centroids)
            np.add.at(sums, which, rows)
            counts += np.bincount(which, minlength=len(centroids))
            # 64 bits hold 2 ** 36 safe rows, or one block of larger ones
            if counts.sum() >= 1 << 35 or int(np.abs(rows).max(initial=0)) >= SAFE:
                yield held()
                sums[:], counts[:] = 0, 0
        yield held()

    return run


def _assign(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, rows in _blocks(frames):
            which, far = nearest(rows, shared.value)
            if far.dtype == object and any(d > 2**63 - 1 for d in far):
                raise OverflowError("a squared distance is no long")
            yield pd.DataFrame({"vec_id": ids.astype("Int64"), "cluster": which.astype(np.int32), "distance": far.astype(np.int64)})

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, dims: int = DIMS, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each kept vector."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(integers(vectors, dims, scale, id_col, vec_col), "integers")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)
        parts = rows.mapInPandas(_sums(shared, dims), "cluster int, n long, s array<long>")
        total = [F.sum(F.get("s", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(dims)]
        shared.destroy()
    shared = spark.sparkContext.broadcast(centroids)
    if len(centroids):
        assigned = written(rows.mapInPandas(_assign(shared), ASSIGNED), "assigned")
    else:
        assigned = spark.createDataFrame([], ASSIGNED)
    shared.destroy()
    dropped(rows)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    known = [(c, d, sum(of.values()), names[c]) for c, d in of.items()]  # k rows at most
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every vector of 64 finite components in one of 40 clusters."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same in SQL: a step a round, each vector against k centroids."""
    apart = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT id, v, c, d FROM (SELECT v.id, v.v, c.c, {apart} AS d FROM kept v, c{r} c) "
            f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY k) AS v FROM (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n "
                f"FROM (SELECT c, unnest(v) AS x, unnest(range(1, {DIMS + 1})) AS k FROM a{r}) GROUP BY c, k) GROUP BY c), "
                f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c)"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {K})
), {", ".join(steps)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k ON a.id = k.id JOIN c{ROUNDS} c ON a.c = c.c
"""


ORACLE = _oracle()
