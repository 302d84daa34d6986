"""Second-stage ordering by a scorer, and where texts come from models: seams with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import lexical_tokens
from marlstone.operators.remote import Limits, Pool

CANDIDATES, LLM_CHARS, CROSS_CHARS, PARAPHRASES = 10, 4000, 2000, 3


def ordered(rows: DataFrame, k: int) -> DataFrame:
    """Rows (qid, chunk_id, rank, score, model_score): scored before unscored, model score, retrieval score, old rank.
    Scores that come out are those of retrieval."""
    w = Window.partitionBy("qid").orderBy(F.col("model_score").isNull(), F.col("model_score").desc(), F.col("score").desc(), "rank")
    out = rows.withColumn("new", F.row_number().over(w).cast("long")).filter(F.col("new") <= k)
    return out.select("qid", "chunk_id", F.col("new").alias("rank"), "score", "model_score")


def overlap_score(question, text):
    """Share of the question's distinct terms that the text has; null without terms."""
    q, t = F.array_distinct(lexical_tokens(question)), F.array_distinct(lexical_tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q))


def guarded(score: Callable[[str, str], float | None], chars: int = LLM_CHARS, tries: int = 3, low: float = 0.0, high: float = 10.0, limits: Limits | None = None):
    """A scorer (question, text) -> number as a column function: texts cut, scores clamped, null after `tries` failures. It is
    asked by a pool within `limits`, whose `tries` go before; refusals for quota wait and don't count."""
    limits = limits or Limits(tries=tries)

    @pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with Pool(limits) as pool:
            for question, text in parts:
                got = pool.each(lambda x: _number(score(*x)), [(q, (t or "")[:chars]) for q, t in zip(question, text)])
                yield pd.Series([None if a.value is None else min(high, max(low, a.value)) for a in got], dtype="float64")

    return run


def _number(x) -> float | None:
    return None if x is None else float(x)


def batched(score: Callable[[list[tuple[str, str]]], list[float]], chars: int = CROSS_CHARS, size: int | None = None, limits: Limits | None = None):
    """A batch scorer as a column function. A failing batch has no scores; with `size` it gets lists of up to that many, a pool
    asks within `limits`, and a failing list is halved until only the pairs that fail by themselves have none."""

    @pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with Pool(limits or Limits(concurrent=1, tries=1)) as pool:
            for question, text in parts:
                pairs = [(q, (t or "")[:chars]) for q, t in zip(question, text)]
                if size is not None:
                    yield pd.Series([a.value for a in pool.blocks(score, pairs, size)], dtype="float64")
                    continue
                got = pool.one(lambda x: pd.Series(score(x), index=range(len(x)), dtype="float64"), pairs)
                yield pd.Series([None] * len(pairs), dtype="float64") if got.value is None else got.value

    return run


def rerank(ranking: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, scorer=None) -> DataFrame:
    rows = ranking.join(questions.select("qid", "question"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    return ordered(rows.withColumn("model_score", (scorer or overlap_score)(F.col("question"), F.col("text"))), k)


def template_paraphrases(question: str, n: int) -> list[str]:
    return [f"{question} explained", f"details about {question}", f"what is said on {question}", f"{question} summary"][:n]


def expand(questions: DataFrame, generate: Callable[[str, int], list[str]] = template_paraphrases, n: int = PARAPHRASES) -> DataFrame:
    """qid, list_no, question: the original as 0 and up to n paraphrases; blank ones go, failures give none."""

    @pandas_udf("array<string>")
    def run(question: pd.Series) -> pd.Series:
        def one(q):
            try:
                return [x.strip() for x in generate(q, n) if x and x.strip()][:n]
            except Exception:
                return []

        return question.map(one)

    base = questions.select("qid", F.lit(0).alias("list_no"), "question")
    more = questions.select("qid", F.posexplode(run("question")).alias("i", "text")).select("qid", (F.col("i") + 1).alias("list_no"), F.col("text").alias("question"))
    return base.unionByName(more)


def template_answer(question: str) -> str:
    return f"The filing states that {question.strip().rstrip('?').lower()} as described in this section."


def hypothetical(questions: DataFrame, write: Callable[[str], str] = template_answer) -> DataFrame:
    """qid, question: a hypothetical answer's text, stripped; none where writing fails or gives nothing."""

    @pandas_udf("string")
    def run(question: pd.Series) -> pd.Series:
        def one(q):
            try:
                return (write(q) or "").strip()
            except Exception:
                return ""

        return question.map(one)

    return questions.select("qid", run("question").alias("question")).filter("question <> ''")
