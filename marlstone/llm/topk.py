"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension (set where the value is above zero). Codes are cut into m segments
(as many as cost least: segment_count) and indexed by (segment, value). A query probes its segments' values in growing radius r.
Once radius r is done in all m segments and radius r + 1 in a of them, every code within m(r + 1) + a - 1 bits
has been met; a query ends when that covers its k-th verified distance, so the answer is exact, ties included.
In each round a query probes only as many segments as its present k-th distance asks for.

Equal codes: only the k + 1 smallest ids of a code can be in any answer, so a group of copies of any size is cut
to those before the index is made (not a cap: the rest can't win). Candidates are verified in the join itself,
so a bucket that many queries meet gives only those near enough. Rounds are written to the shared folder.
Style: free; DataFrame functions throughout.

Defined results: a query is not its own neighbour; ties go to the smaller id; null vectors and ids are not
indexed and get no answer; null or NaN elements give a zero bit; fewer than k others give as many rows as there
are; repeated ids count as one row; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import table, written

K = 10
EVERY = 50


def codes(vectors: DataFrame, dims: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, c0, c1, ...: 64 bits to a word."""
    words = []
    for w in range(0, dims, 64):
        word = F.lit(0).cast("long")
        for k in range(w, min(w + 64, dims)):
            x = F.get(F.col(vec_col), F.lit(k))
            word = word.bitwiseOR(F.when((x > 0) & ~F.isnan(x), F.shiftleft(F.lit(1).cast("long"), k - w)).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"c{w // 64}"))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), *words).distinct()


def segment_count(dims: int, n: int, k: int = K, a_probe: int = 4) -> int:
    """So many segments cost least for codes without structure, the hardest ones: a probe is a row made and dealt, which counts
    as much as `a_probe` codes met. The k-th distance is what is expected of n such codes; results don't hang on it."""
    far, met = 0, 1
    while far < dims and max(n, 2) * met < (k + 1) << dims:
        far += 1
        met += math.comb(dims, far)

    def cost(m: int) -> float:
        bits, radius = math.ceil(dims / m), far // m
        last = far - m * radius + 1  # segments that are probed to the last radius
        probes = m * sum(math.comb(bits, r) for r in range(radius)) + min(m, last) * math.comb(bits, radius)
        return probes * (a_probe + n / 2.0**bits)

    return min(range(1, dims + 1), key=cost)


def segments(dims: int, n: int, k: int = K) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of each segment, none across two words."""
    count, out = segment_count(dims, n, k), []
    for w in range(0, dims, 64):
        bits = min(64, dims - w)
        m = max(1, round(count * bits / dims))
        cuts = [bits * i // m for i in range(m + 1)]
        out += [(w // 64, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def _cut(word: int, shift: int, bits: int):
    x = F.shiftrightunsigned(f"c{word}", shift)
    return x if bits == 64 else x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def ring(probes: DataFrame, radius: int) -> DataFrame:
    """Rows with v (of so many bits): one for each value that differs from v in `radius` bits. Rows are made where they are:
    each step flips a bit above the one flipped before."""
    rows = probes.withColumn("from", F.lit(0))
    for left in range(radius, 0, -1):
        last = F.col("bits") - left  # as many bits must remain above
        rows = rows.withColumn("flip", F.explode(F.when(F.col("from") <= last, F.sequence("from", last))))
        rows = rows.withColumns({"v": F.col("v").bitwiseXOR(F.expr("shiftleft(1L, flip)")), "from": F.col("flip") + 1}).drop("flip")
    return rows.drop("from")


def search(vectors: DataFrame, queries: DataFrame, dims: int, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, distance: the k nearest others of each query by Hamming distance of the codes."""
    spark = vectors.sparkSession
    if k < 1:
        raise ValueError("k must be positive")
    names = [f"c{w}" for w in range((dims + 63) // 64)]
    rows = written(codes(vectors, dims, id_col, vec_col), "codes")
    n = rows.count()
    segs = segments(dims, n, k)
    m, widest = len(segs), max((b for _, _, b in segs), default=0)
    first = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    kept = rows.withColumn("r", first).filter(F.col("r") <= k + 1).drop("r")
    each = F.array(*[F.struct(F.lit(j).alias("j"), _cut(*s).alias("v")) for j, s in enumerate(segs)])
    index = written(kept.select("id", *names, F.explode(each).alias("x")).select("x.j", "x.v", "id", *names), "index")
    asked = written(codes(queries, dims, id_col, vec_col), "asked")
    # equal query codes share one search, for the k + 1 nearest ids, themselves included
    state = asked.select(*names).distinct().select(F.xxhash64(*names).alias("q"), *names, F.lit(None).cast("int").alias("far"))
    state = written(state, "state")
    best = None
    per = F.array(*[F.struct(F.lit(j).alias("j"), _cut(*s).alias("v"), F.lit(s[2]).alias("bits")) for j, s in enumerate(segs)])
    for r in range(widest + 1):
        # far < m * r: all within far bits were met in earlier rounds
        open_ = state.filter(F.col("far").isNull() | (F.col("far") >= m * r))
        need = F.coalesce(F.col("far") - m * r + 1, F.lit(m))
        probes = open_.select("q", "far", *names, F.explode(F.slice(per, F.lit(1), F.least(need, F.lit(m)))).alias("x"))
        probes = ring(probes.select("q", "far", *names, "x.j", "x.v", "x.bits"), r)
        probes = probes.select("q", "far", "j", "v", *[F.col(c).alias(f"q{c}") for c in names])
        distance = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in names), F.lit(0))
        near = (probes["j"] == index["j"]) & (probes["v"] == index["v"]) & (distance <= F.coalesce(F.col("far"), F.lit(dims)))
        # probes are made row by row, so the planner takes them for few: never let it broadcast them
        met = probes.join(index.hint("merge"), near).select("q", distance.alias("distance"), "id").distinct()
        if best is not None:
            met = met.unionByName(best).distinct()
        top = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
        best = written(met.withColumn("r", top).filter(F.col("r") <= k + 1).drop("r"), "best")
        done = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).filter(F.col("n") > k)
        state = written(state.drop("far").join(done.select("q", F.col("d").alias("far")), "q", "left"), "state")
        if state.filter(F.col("far").isNull() | (F.col("far") >= m * (r + 1))).isEmpty():
            break
    out = asked.select(F.col("id").alias("query_id"), F.xxhash64(*names).alias("q")).join(best, "q").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: for each vector whose id is divisible by 50, the 10 nearest others among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    dims = vectors.select(F.max(F.size("embedding"))).first()[0] or 1
    out = search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0), dims)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


ORACLE = """
WITH code AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
), pair AS (
  SELECT a.vec_id AS query_id, o.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.b, o.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM code a JOIN code o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id
)
SELECT query_id, rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pair) WHERE rank <= 10
"""
