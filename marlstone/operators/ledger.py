"""The experiment ledger: coercion, leaderboards, drift, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numbers import noise_floor, number

#: The ledger's columns; category, metric, whether the least wins; the metrics that drift compares.
COLUMNS = [
    "exp_name",
    "timestamp",
    "n_questions",
    "n_filings",
    "n_chunks",
    "context_recall",
    "faithfulness",
    "answer_relevancy",
    "hit_at_5",
    "citation_accuracy",
    "mean_latency_ms",
    "total_cost_usd",
    "hit_at_5_content",
    "citation_accuracy_content",
]
CATEGORIES = [
    ("chunking", "context_recall", False),
    ("chunking_content", "hit_at_5_content", False),
    ("vectordb", "p95_latency_ms", True),
    ("retrieval", "context_recall", False),
    ("reranker", "citation_accuracy", False),
    ("end_to_end", "faithfulness", False),
]
COMPARED = [
    "context_recall",
    "faithfulness",
    "answer_relevancy",
    "hit_at_5",
    "citation_accuracy",
    "hit_at_5_content",
    "citation_accuracy_content",
]
TOLERANCE, LATENCY_FACTOR, DEFAULT_N = 0.05, 2.0, 139


def coerced(raw: DataFrame, text: tuple[str, ...] = ("exp_name", "timestamp")) -> DataFrame:
    """A ledger of strings as numbers, but for its text columns; what isn't a number is null."""
    return raw.select(*[F.col(c) if c in text or c == "ord" else number(c).alias(c) for c in raw.columns])


def winners(ledger: DataFrame, categories: list[tuple[str, str, bool]] = CATEGORIES) -> DataFrame:
    """category, metric, winner, winner_value, runner_up: nulls don't compete, ties keep ledger order (ord), a
    category without values is null."""
    known = [c for c in categories if c[1] in ledger.columns]
    table = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric")) for c, m, _ in categories])
    every = ledger.sparkSession.range(1).select(F.explode(table).alias("c")).select("c.*")
    if not known:
        return every.select("category", "metric", *[F.lit(None).cast(t).alias(n) for n, t in (("winner", "string"), ("winner_value", "double"), ("runner_up", "string"))])
    long = ledger.select("exp_name", "ord", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(m).cast("double").alias("value"), F.lit(1.0 if least else -1.0).alias("sign")) for c, m, least in known])).alias("x"))
    long = long.select("exp_name", "ord", "x.*").filter("value is not null")
    w = Window.partitionBy("category").orderBy(F.col("sign") * F.col("value"), "ord")
    top = long.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("category").agg(
        F.max(F.when(F.col("r") == 1, F.col("exp_name"))).alias("winner"),
        F.max(F.when(F.col("r") == 1, F.col("value"))).alias("winner_value"),
        F.max(F.when(F.col("r") == 2, F.col("exp_name"))).alias("runner_up"),
    )
    return every.join(top, "category", "left").select("category", "metric", "winner", "winner_value", "runner_up")


def history(ledger: DataFrame) -> DataFrame:
    """Newest first, with the time of the last one."""
    return ledger.withColumn("last_updated", F.max("timestamp").over(Window.partitionBy())).orderBy(F.col("timestamp").desc())


def unique_maxima(rows: DataFrame, columns: list[str], name: str = "exp_name") -> DataFrame:
    """Cells as text, bold where a row alone leads its column; `leads` where it alone leads all of them."""
    tops = rows.agg(*[F.max(c).alias(f"top_{c}") for c in columns])  # one row
    ties = rows.join(F.broadcast(tops)).agg(*[F.count_if(F.col(c) == F.col(f"top_{c}")).alias(f"n_{c}") for c in columns], *[F.max(f"top_{c}").alias(f"top_{c}") for c in columns])
    both = rows.join(F.broadcast(ties))
    alone = {c: F.coalesce((F.col(c) == F.col(f"top_{c}")) & (F.col(f"n_{c}") == 1), F.lit(False)) for c in columns}
    every = F.lit(True)
    for c in columns:
        every = every & alone[c]
    cell = lambda c: F.when(F.col(c).isNull(), F.lit("—")).otherwise(F.when(alone[c], F.format_string("**%.4f**", c)).otherwise(F.format_string("%.4f", c)))
    return both.select(name, *[cell(c).alias(c) for c in columns], every.alias("leads"))


def drift(baseline: DataFrame, candidate: DataFrame, metrics: list[str] = COMPARED, tol: float = TOLERANCE, factor: float = LATENCY_FACTOR) -> DataFrame:
    """metric, baseline, candidate, delta, threshold, status of one-row ledgers; the last row is the latency's."""
    n = F.coalesce(F.floor("n_questions").cast("int"), F.lit(DEFAULT_N)) if "n_questions" in candidate.columns else F.lit(DEFAULT_N)
    every = [*metrics, "mean_latency_ms"]
    long = lambda v: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(v)) for m in every])).alias("x")
    b = baseline.select(long("baseline")).select("x.*")
    c = candidate.select(n.alias("n"), long("candidate")).select("n", "x.*")
    rows = b.join(c, "metric")
    latency = F.col("metric") == "mean_latency_ms"
    none = F.col("baseline").isNull() | F.col("candidate").isNull()
    delta = F.col("candidate") - F.col("baseline")
    threshold = F.greatest(F.lit(tol), noise_floor(F.col("baseline"), F.col("n")))
    slow = F.when(none | (F.col("baseline") <= 0), F.lit("skipped")).when(F.col("candidate") > factor * F.col("baseline"), F.lit("BREACH")).otherwise(F.lit("ok"))
    status = F.when(none, F.lit("skipped")).when(delta < -threshold, F.lit("BREACH")).when(delta > threshold, F.lit("improved")).otherwise(F.lit("ok"))
    return rows.select(
        "metric",
        "baseline",
        "candidate",
        F.when(~latency & ~none, F.round(delta, 4)).alias("delta"),
        F.when(~latency & ~none, F.round(threshold, 4)).alias("threshold"),
        F.when(latency, slow).otherwise(status).alias("status"),
    )


def verdict(rows: DataFrame) -> DataFrame:
    """One row: ok, breaches, improvements (metrics, sorted)."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("metric"))))
    return rows.agg((F.count_if(F.col("status") == "BREACH") == 0).alias("ok"), of("BREACH").alias("breaches"), of("improved").alias("improvements"))


def deltas(ledger: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """Each experiment's metrics against the baseline's, in percentage points."""
    base = ledger.filter(F.col("exp_name") == baseline).orderBy("ord").limit(1).select(*[F.col(m).alias(f"b_{m}") for m in metrics])
    return ledger.join(F.broadcast(base)).select("exp_name", *[F.round((F.col(m) - F.col(f"b_{m}")) * 100, 4).alias(m) for m in metrics])
