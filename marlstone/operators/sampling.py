"""Stratified picks, quotas and checks for question sets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import NO_SPAN, comparable, span_in, strip
from marlstone.operators.numbering import numbered

#: Shares of question types, and sections in order of priority.
SHARES = {"lookup": 0.40, "section": 0.30, "synthesis": 0.20, "out_of_scope": 0.10}
#: Rows of a bucket that tasks keep in memory.
HEADS = 10_000
BUCKETS = ["item_1", "item_1a", "item_7", "item_7a", "item_8"]


def latest(rows: DataFrame, key: str, when: str, *columns: str, tie: str | None = None) -> DataFrame:
    """For each key the newest row; of each column its first value that isn't null, newest first."""
    order = F.struct(when, tie) if tie else F.col(when)
    return rows.groupBy(key).agg(F.max(when).alias(when), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def stratified(rows: DataFrame, bucket: str, order: list[str], target: int, buckets: list[str] = BUCKETS) -> DataFrame:
    """max(1, target / buckets) consecutive rows of each bucket, past the first where enough follow.

    Two rows more than a bucket's share tell whether enough follow. Up to HEADS rows a bucket, tasks keep the first ones alone, by
    one pass a bucket over its columns; beyond, a bucket is sorted as a whole, on disk where memory ends."""
    per = max(1, target // max(1, len(buckets)))
    own = Window.partitionBy(bucket)
    n = F.least(F.lit(per), F.col("all"))
    if per + 2 <= HEADS:
        heads = None
        for b in dict.fromkeys(buckets):
            head = rows.filter(F.col(bucket) == b).orderBy(*order).limit(per + 2)
            heads = head if heads is None else heads.unionByName(head)
        rows = rows.limit(0) if heads is None else heads
    rows = rows.filter(F.col(bucket).isin(buckets)).withColumn("all", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy(*order)) - 1)
    start = F.when(F.col("all") > n + 1, 1).otherwise(0)
    return rows.filter((F.col("i") >= start) & (F.col("i") < start + n)).drop("all", "i")


def quotas(total: Column, shares: dict[str, float] = SHARES) -> dict[str, Column]:
    """How many of each type: halves go to the even number; small types have one at least from five on."""
    out = {k: F.bround(total * F.lit(v)).cast("long") for k, v in shares.items()}
    for k in ("synthesis", "out_of_scope"):
        if k in out:
            out[k] = F.when(total >= 5, F.greatest(F.lit(1), out[k])).otherwise(F.lit(0)).cast("long")
    return out


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """A repeatable shuffle: by a hash of the key and the seed."""
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key)


def verified(spans: Column, texts: Column, qa_type: Column) -> Column:
    """Whether each span (parts of one string, cut at |) stands in the text of the same place; the shorter list counts.
    The sentinel is accepted."""
    parts = F.transform(F.split(spans, r"\|"), strip)
    n = F.least(F.size(parts), F.size(texts))
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), n).alias("s"), F.slice(texts, F.lit(1), n).alias("t"))
    ok = F.forall(pairs, lambda p: span_in(comparable(p["s"]), comparable(p["t"])))
    return F.when((strip(spans) == NO_SPAN) | (qa_type == "out_of_scope"), F.lit(True)).otherwise(F.coalesce(ok & (n > 0), F.lit(False)))


def record(question: Column, span: Column, difficulty: Column) -> dict[str, Column]:
    """Text fields of a new question record, stripped, with their defaults."""
    blank = F.lit("")
    return {
        "question": strip(F.coalesce(question, blank)),
        "source_span": strip(F.coalesce(span, blank)),
        "difficulty": F.coalesce(F.nullif(strip(F.coalesce(difficulty, blank)), blank), F.lit("medium")),
        "verified": F.lit(False),
        "verification_reason": blank,
    }


def template_question(text: str, kind: str) -> tuple[str, str] | None:
    words = (text or "").split()
    if len(words) < 6:
        return None
    return f"What is said about {words[0].strip('.,').lower()} ({kind})?", " ".join(words[:20])


def question_set(chunks: DataFrame, per_key: int, write: Callable[[str, str], tuple[str, str] | None] = template_question, seed: int = 0, key: str = "doc_key") -> DataFrame:
    """Generated records: for each key, quotas of types over a repeatable shuffle of its chunks; failures are dropped
    and ids run without gaps in the order of (key, pick)."""
    w = Window.partitionBy(key).orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id")
    picked = chunks.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= per_key)
    q = quotas(F.lit(per_key))
    a, b, c = q["lookup"], q["lookup"] + q["section"], q["lookup"] + q["section"] + q["synthesis"]
    kind = F.when(F.col("pick") <= a, "lookup").when(F.col("pick") <= b, "section").when(F.col("pick") <= c, "synthesis").otherwise("out_of_scope")

    @pandas_udf("struct<question:string,span:string>")
    def made(text: pd.Series, kind: pd.Series) -> pd.DataFrame:
        def one(t, k):
            try:
                return write(t, k) or (None, None)
            except Exception:
                return None, None

        return pd.DataFrame([one(t, k) for t, k in zip(text, kind)], columns=["question", "span"])

    rows = picked.withColumn("qa_type", kind).withColumn("made", made("text", "qa_type")).filter("made.question is not null")
    rows = rows.select(key, "chunk_id", "pick", "qa_type", F.col("made.question").alias("question"), F.when(F.col("qa_type") == "out_of_scope", F.lit(NO_SPAN)).otherwise(F.col("made.span")).alias("source_span"))
    rows = numbered(rows, "__n", [key, "pick"])
    return rows.select(F.format_string("q_%04d", "__n").alias("id"), key, "chunk_id", "qa_type", "question", "source_span")
