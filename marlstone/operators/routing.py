"""Routing evaluation over outcomes (qid, strategy, hit, cite)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(outcomes: DataFrame, types: DataFrame, strategies: list[str]) -> DataFrame:
    """Hit rate of each strategy by question type; a missing outcome is not a miss."""
    rows = outcomes.join(types.select("qid", "qa_type"), "qid")
    return rows.groupBy("qa_type").agg(
        F.count_distinct("qid").alias("n"),
        *[F.avg(F.when(F.col("strategy") == s, F.col("hit").cast("double"))).alias(f"{s}_rate") for s in strategies],
        *[F.count(F.when(F.col("strategy") == s, F.col("hit"))).alias(f"{s}_n") for s in strategies],
    )


def score(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rates of the chosen strategies (qid, strategy) and of the best choice in hindsight. An unknown question or strategy
    raises, as dropping it would flatter the router; so does an empty decision table."""
    per = outcomes.groupBy("qid").agg(F.max(F.col("hit").cast("int")).alias("any_hit"), F.max(F.col("cite").cast("int")).alias("any_cite"))
    rows = decisions.join(outcomes, ["qid", "strategy"], "left").join(per, "qid", "left")
    checked = F.when(F.col("hit").isNull(), F.raise_error(F.concat(F.lit("no outcome for "), F.col("qid").cast("string"), F.lit(" under "), F.col("strategy")))).otherwise(F.col("hit").cast("double"))
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(checked).alias("hit_rate"),
        F.avg(F.col("cite").cast("double")).alias("cite_rate"),
        F.avg("any_hit").alias("oracle_hit_rate"),
        F.avg("any_cite").alias("oracle_cite_rate"),
    )
    return out.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("no routing decisions to score"))).otherwise(F.col("n")))


def best_single(outcomes: DataFrame) -> DataFrame:
    """The strategy with the highest hit rate, by name among equals."""
    rates = outcomes.groupBy("strategy").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    return rates.orderBy(F.round("hit_rate", 9).desc(), "strategy").limit(1)


def covered(outcomes: DataFrame, n: int) -> DataFrame:
    """Questions that have an outcome under all n strategies."""
    return outcomes.groupBy("qid").agg(F.count_distinct("strategy").alias("k")).filter(F.col("k") == n).select("qid")
