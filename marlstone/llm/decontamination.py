"""Benchmark decontamination by a prefix-filtered set join.

Items become windows of `window` consecutive words (a shorter item is one window); each window is a sequence of
5-word shingles (all of its words, if it has fewer). One pass over the whole documents looks up every shingle
among the items' shingles and keeps the matches, written to the shared folder. How often each shingle was met
orders them by rarity. A window is wholly contained only if its rarest shingle is, so the necessary prefix is
that one token: it is joined with the matches, its place gives where the window would start, and the bounds of
position and length drop what would lie outside the document. Each candidate is verified exactly: the
shingles that cover all of the window's words (those at every fifth word, and the last) must stand at their places,
compared as text.

Native: DataFrame functions only. Words are turned into shingles by zipping shifted arrays, so nothing quadratic
is built; documents' rows stay one shingle wide. The items' side is broadcast only up to `broadcast_rows` rows;
beyond that the same joins shuffle.

Defined results: a null or wordless text has no words and no hit; a null or wordless item is never met; items
that repeat an id count once, whatever their texts; rows are told apart by id and text, and repeated rows get
the same values each; empty tables give no row, or no hit; other columns are passed by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import table, written

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and whatever is not ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN), "")


def shifted(w: str, n: int) -> Column:
    """Array of structs (w0 .. w{n-1}): each word and the n - 1 after it, null beyond the end."""
    return F.arrays_zip(*[(F.col(w) if k == 0 else F.slice(w, k + 1, 1 << 30)).alias(f"w{k}") for k in range(n)])


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, win (the window's words as an array) of each item with words."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda p: F.slice("w", p, window))).alias("win")).distinct()


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """(heads, found, wins). heads: k1, k2, doc_id, n_words of each document row; found: k1, k2, s, wlen, win of each
    distinct place where a window stands; wins: item_id, win. k1 and k2 tell rows apart."""
    wins = written(windows(items, window), "windows")
    n = F.size("parts")
    k = F.least(n, F.lit(shingle))
    tokens = wins.select(F.col("win").alias("parts")).distinct().select(
        F.array_join("parts", " ").alias("win"),
        n.alias("wlen"),
        k.alias("k"),
        F.posexplode(F.transform(F.sequence(F.lit(1), n - k + 1), lambda p: F.array_join(F.slice("parts", p, k), " "))).alias("o", "token"),
    )
    tokens = written(tokens, "tokens")
    lens = sorted((r.k for r in tokens.select("k").distinct().collect()), reverse=True) or [shingle]  # shingle values at most
    vocabulary = _small(tokens.select("k", "token").distinct(), broadcast_rows)

    nulls = F.col(id_col).isNull()
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(nulls, F.lit("")).otherwise(F.col(id_col).cast("string")).alias("k1"),
        F.xxhash64(nulls, F.col(text_col)).alias("k2"),
        words(F.col(text_col)).alias("w"),
    )
    at = base.select("doc_id", "k1", "k2", F.size("w").alias("n_words"), F.posexplode_outer(shifted("w", lens[0])).alias("pos", "x"))

    def token(n: int) -> Column:
        return F.when(F.col(f"x.w{n - 1}").isNotNull(), F.concat_ws(" ", *[f"x.w{i}" for i in range(n)]))

    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if len(lens) == 1:
        at = at.select("doc_id", "k1", "k2", "n_words", "pos", head.alias("head"), F.lit(lens[0]).alias("k"), token(lens[0]).alias("token"))
    else:
        each = F.array(*[F.struct(F.lit(n).alias("k"), token(n).alias("token"), F.lit(n == lens[0]).alias("first")) for n in lens])
        at = at.select("doc_id", "k1", "k2", "n_words", "pos", head.alias("head"), F.explode(each).alias("y"))
        at = at.select("doc_id", "k1", "k2", "n_words", "pos", (F.col("head") & F.col("y.first")).alias("head"), "y.k", "y.token")
    met = at.join(vocabulary.withColumn("met", F.lit(True)), ["k", "token"], "left").filter("met or head")
    met = written(met.select("doc_id", "k1", "k2", "n_words", "pos", "head", "k", F.when(F.col("met"), F.col("token")).alias("token")), "met")

    hits = met.filter("token is not null")
    rarity = hits.groupBy("k", "token").agg(F.count(F.lit(1)).alias("n"))
    ordered = tokens.join(rarity, ["k", "token"], "left").groupBy("win", "wlen", "k").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "o")).alias("rarest"),
        F.array_sort(F.collect_list(F.when((F.col("o") % F.col("k") == 0) | (F.col("o") == F.col("wlen") - F.col("k")), F.struct("o", "token")))).alias("cover"),
    )
    prefixes = ordered.filter("rarest.n > 0").select("win", "wlen", "k", F.col("rarest.token").alias("token"), F.col("rarest.o").alias("o"), "cover")
    cand = hits.join(_small(written(prefixes, "prefixes"), broadcast_rows), ["k", "token"]).withColumn("s", F.col("pos") - F.col("o"))
    cand = cand.filter((F.col("s") >= 0) & (F.col("s") + F.col("wlen") <= F.col("n_words")))
    found = cand.select("k1", "k2", "k", "win", "wlen", "s", "cover")
    for j in range(max(1, math.ceil(window / shingle))):  # the shingles that cover a window's words
        own = F.get("cover", F.least(F.lit(j), F.size("cover") - 1))
        place = hits.select("k1", "k2", "k", F.col("pos").alias("at"), F.col("token").alias("covers"))
        found = found.withColumns({"at": F.col("s") + own["o"], "covers": own["token"]}).join(place, ["k1", "k2", "k", "at", "covers"], "left_semi")
    found = found.select("k1", "k2", "s", "wlen", "win").distinct()
    heads = met.filter("head").select("doc_id", "k1", "k2", "n_words")
    return heads, written(found, "found"), wins.select("item_id", F.array_join("win", " ").alias("win"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated: a row for each row of docs."""
    heads, found, wins = occurrences(docs, items, window, SHINGLE, broadcast_rows, id_col, text_col)
    span = found.groupBy("k1", "k2", "s").agg(F.max(F.col("s") + F.col("wlen")).alias("e"))
    order = Window.partitionBy("k1", "k2").orderBy("s")
    reached = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = (
        span.withColumn("new", F.greatest(F.col("e") - F.greatest(F.col("s"), reached), F.lit(0)))
        .groupBy("k1", "k2")
        .agg(F.sum("new").cast("long").alias("n_hit"))
    )
    met = found.select("k1", "k2", "win").join(_small(wins, broadcast_rows), "win").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = heads.join(n_hit, ["k1", "k2"], "left").join(met, ["k1", "k2"], "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "k1",
        "k2",
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        items_.alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: benchmark windows in every document."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, spot.n, p, item_id FROM spot JOIN win ON spot.n = win.n AND spot.t = win.t
), places AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN met USING (doc_id)
"""
