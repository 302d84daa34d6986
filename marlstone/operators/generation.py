"""Answers and prompts from ranked contexts, as expressions; the remote model is a seam of the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.functions.text import strip, token_estimate
from marlstone.operators.remote import Limits, Pool

#: Fixed values.
SNIPPET = 240
REFUSAL = "I cannot find this in the provided filings.\n\nSources: (none retrieved)"


def contexts(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, ctx: array of (rank, chunk_id, score, text) in order of rank."""
    rows = ranking.join(chunks.select("chunk_id", "text"), "chunk_id")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "text"))).alias("ctx"))


def prompt(ctx):
    return F.array_join(F.transform(ctx, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("]\n"), c["text"])), "\n\n---\n\n")


def answer(ctx):
    """The stand-in generator: the top context's first characters, then every source."""
    top = strip(F.get(ctx, F.lit(0))["text"])
    snippet = F.concat(F.substring(F.replace(top, F.lit("\n"), F.lit(" ")), F.lit(1), F.lit(SNIPPET)), F.when(F.length(top) > SNIPPET, F.lit("...")).otherwise(F.lit("")))
    sources = F.array_join(F.transform(ctx, lambda c: F.format_string("- [%s] (score=%.3f)", c["chunk_id"], c["score"])), "\n")
    return F.when(F.coalesce(F.size(ctx), F.lit(0)) == 0, F.lit(REFUSAL)).otherwise(F.concat(F.lit("Based on the retrieved filings: "), snippet, F.lit("\n\nSources:\n"), sources))


def generate(questions: DataFrame, ranking: DataFrame, chunks: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """qid, answer, cited (ids in order), input_tokens, output_tokens for every question. A model is asked with the contexts
    and the question, and not at all where there is no context."""
    rows = questions.select("qid", "question").join(contexts(ranking, chunks), "qid", "left")
    if model is None:
        rows = rows.withColumn("answer", answer(F.col("ctx")))
    else:
        asked = F.concat(F.lit("Context:\n"), prompt(F.col("ctx")), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\n\nAnswer:"))
        some = F.coalesce(F.size("ctx"), F.lit(0)) > 0
        ran = rows.filter(some).withColumn("answer", spoken(model)(asked))
        rows = ran.unionByName(rows.filter(~some).withColumn("answer", F.lit(REFUSAL)))
    text = F.concat(F.col("question"), F.coalesce(F.array_join(F.transform("ctx", lambda c: c["text"]), ""), F.lit("")))
    return rows.select(
        "qid",
        "answer",
        F.coalesce(F.transform("ctx", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("cited"),
        token_estimate(text).alias("input_tokens"),
        token_estimate(F.col("answer")).alias("output_tokens"),
    )


def structured(call: Callable[[str], str], tries: int = 3, limits: Limits | None = None):
    """A model that answers in JSON as a column function of prompts: the object as JSON text, null if no try gives one. A pool
    asks within `limits`, whose `tries` go before."""

    def parsed(prompt: str) -> str:
        found = json.loads(call(prompt))
        if not isinstance(found, dict):
            raise ValueError("no object")
        return json.dumps(found)

    return _asked(parsed, limits or Limits(tries=tries), None)


def spoken(call: Callable[[str], str | list[str]], limits: Limits | None = None):
    """A remote text model as a column function of prompts; parts of an answer are joined, failures give an empty one."""

    def whole(prompt: str) -> str:
        said = call(prompt)
        return said if isinstance(said, str) else "".join(said)

    return _asked(whole, limits or Limits(tries=1), "")


def _asked(call: Callable[[str], str], limits: Limits, missing: str | None):
    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with Pool(limits) as pool:
            for prompts in parts:
                yield pd.Series([missing if a.error else a.value for a in pool.each(call, list(prompts))], dtype="object")

    return run
