"""Scores for each question, and their aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import PROBE, comparable, normal_span, span_in
from marlstone.operators.streams import small_batches

REFUSES = "I cannot"
#: Bytes of spans that make one automaton, and automata that one pass over the texts uses.
SPAN_BYTES, AUTOMATA = 1 << 20, 16


def same_form(text: str | None) -> str:
    """comparable() of a value: white space collapsed, lower case."""
    return " ".join((text or "").split()).lower()


def probes_of(span: str) -> set[str]:
    """What a text must hold one of: the span, or the first or last 100 characters of a longer one."""
    return {span, span[:PROBE], span[-PROBE:]} if len(span) > PROBE else {span}


def span_blocks(spans: DataFrame, most: int = SPAN_BYTES) -> Iterator[list[tuple[str, object]]]:
    """(probe, qid) in blocks of so many bytes, or of one span; one block is on the driver at a time."""
    block, held = [], 0
    for row in spans.select("qid", "span").toLocalIterator():
        span = same_form(row.span)
        for probe in sorted(probes_of(span)) if span else ():
            block.append((probe, row.qid))
            held += len(probe.encode())
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


class Automata:
    """Aho-Corasick automata of blocks of probes, built once in each worker process that uses them."""

    kept: tuple[object, list] = (None, [])

    @classmethod
    def of(cls, key: object, blocks: list[list[tuple[str, object]]]) -> list:
        if cls.kept[0] != key:
            import ahocorasick

            made = []
            for block in blocks:
                asked: dict[str, list] = {}
                for probe, qid in block:
                    asked.setdefault(probe, []).append(qid)
                automaton = ahocorasick.Automaton()
                for probe, qids in asked.items():
                    automaton.add_word(probe, qids)
                automaton.make_automaton()
                made.append(automaton)
            cls.kept = key, made
        return cls.kept[1]


def span_matches(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, text_id) where a span (qid, span) stands in a text (text_id, text).

    Spans go in blocks of bounded bytes to every task, each as one automaton that finds all of its probes at once; a task
    reads each of its texts once for AUTOMATA blocks. Texts are neither shuffled nor exploded, and short spans are no special
    case."""
    spark = texts.sparkSession
    small_batches(spark)
    rows = texts.select("text_id", "text")
    kinds = dict(spans.dtypes)["qid"], rows.dtypes[0][1]
    qid_type = spark.createDataFrame([], f"qid {kinds[0]}").toArrow().schema.field(0).type
    out, held = None, []

    def one_pass(blocks: list) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(blocks), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = Automata.of(key, shared.value)
            for b in batches:
                place, qids = [], []
                for i, text in enumerate(b.column(1)):
                    text, found = same_form(text.as_py()), set()
                    if text:
                        for automaton in automata:
                            for _, own in automaton.iter(text):
                                found.update(own)
                    place += [i] * len(found)
                    qids += found
                yield pa.RecordBatch.from_arrays([pa.array(qids, qid_type), b.column(0).take(pa.array(place, pa.int64()))], names=["qid", "text_id"])

        return rows.mapInArrow(run, f"qid {kinds[0]}, text_id {kinds[1]}")

    for block in span_blocks(spans):
        held.append(block)
        if len(held) == AUTOMATA:
            out, held = one_pass(held) if out is None else out.unionByName(one_pass(held)), []
    if held:
        out = one_pass(held) if out is None else out.unionByName(one_pass(held))
    return out.distinct() if out is not None else spark.createDataFrame([], f"qid {kinds[0]}, text_id {kinds[1]}")


def hits(rows: DataFrame) -> DataFrame:
    """Adds hit, hit_content, cite, cite_content.

    rows: qid, qa_type, source_id, span, retrieved (ids), retrieved_texts, cited (ids), cited_texts, answer."""
    oos = F.col("qa_type") == "out_of_scope"
    span = F.when(oos, F.lit("")).otherwise(comparable(normal_span(F.col("span"))))
    some = lambda texts: F.coalesce(F.exists(F.col(texts), lambda t: span_in(span, comparable(t))), F.lit(False))
    has = lambda ids: F.coalesce(F.array_contains(F.col(ids), F.col("source_id")), F.lit(False))
    refuses = F.contains(F.coalesce("answer", F.lit("")), F.lit(REFUSES))
    return rows.withColumns(
        {
            "hit": F.when(oos, ~has("retrieved")).otherwise(has("retrieved")),
            "hit_content": F.when(oos, span == "").otherwise(some("retrieved_texts")),
            "cite": F.when(oos, (F.size("cited") == 0) & refuses).otherwise(has("cited")),
            "cite_content": F.when(oos, refuses).otherwise(some("cited_texts")),
        }
    )


def rate(c: str) -> Column:
    return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))


def summary(rows: DataFrame, *group: str) -> DataFrame:
    """One experiment row (or one for each group): counts, four rates over all questions, latency, cost, filings."""
    out = rows.groupBy(*group) if group else rows
    return out.agg(
        F.count(F.lit(1)).alias("n_questions"),
        rate("hit").alias("hit_at_5"),
        rate("cite").alias("citation_accuracy"),
        rate("hit_content").alias("hit_at_5_content"),
        rate("cite_content").alias("citation_accuracy_content"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency_ms"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.count_distinct("filing").alias("n_filings"),
    )


def mean_of_numbers(c: str) -> Column:
    """The mean without nulls and NaN; null if nothing is left."""
    x = F.col(c).cast("double")
    return F.avg(F.when(~F.isnan(x), x))


def gain_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two runs (qid, hit) over the same questions: how many b gained and lost against a."""
    rows = a.select("qid", F.col("hit").alias("x")).join(b.select("qid", F.col("hit").alias("y")), "qid")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("x") & F.col("y")).alias("gained"),
        F.count_if(F.col("x") & ~F.col("y")).alias("lost"),
        (F.count_if(~F.col("x") & F.col("y")) - F.count_if(F.col("x") & ~F.col("y"))).alias("net"),
    )


def run_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two runs (qid, hit): answered by both, by one alone, and by either as a share of all questions."""
    rows = a.select("qid", F.col("hit").alias("x")).join(b.select("qid", F.col("hit").alias("y")), "qid", "full").select(F.coalesce("x", F.lit(False)).alias("x"), F.coalesce("y", F.lit(False)).alias("y"))
    return rows.agg(
        F.count_if(F.col("x") & F.col("y")).alias("shared"),
        F.count_if(F.col("x") & ~F.col("y")).alias("only_a"),
        F.count_if(~F.col("x") & F.col("y")).alias("only_b"),
        F.avg((F.col("x") | F.col("y")).cast("double")).alias("union_rate"),
    )
