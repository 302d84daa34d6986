"""Weighted draws, and question sets whose types are drawn by what is left of each quota."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import NO_SPAN, PROBE
from marlstone.operators.numbering import numbered
from marlstone.operators.sampling import BUCKETS, SHARES, template_question

#: Up to this many rows a group Spark drops the others before the shuffle; cells of a key an octave beyond.
LIMIT, CELLS = 1000, 4096
SINGLE = ("lookup", "section", "out_of_scope")


def uniform(seed: int, *columns: str) -> Column:
    """A repeatable number strictly between 0 and 1: 52 bits of an MD5 of the seed and the columns, of which nulls count as
    empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def weighted(rows: DataFrame, weight: str, k: int, by: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """k rows of each group (all, if fewer) without replacement: at each draw a row's chance is its share of the weight that is
    left. `draw` counts them from 1. No `by`: one group of all rows.

    Each row gets an exponential key, -ln(u) / weight, with u made from `key`; the smallest keys are the draw. For k up to
    LIMIT each task keeps its own k rows a group and only those are shuffled. Beyond, rows are counted by cells of their key's
    logarithm; only rows of cells that begin within the first k are ranked, and each cell by itself, so that no task sees a group.

    Weights that are null, NaN, infinite, zero or less are never drawn. Rows that are equal in `key` and weight have equal
    keys; which of them comes first is open, and nothing else. An empty table gives an empty one."""
    if k < 0:
        raise ValueError("k is less than 0")
    w = F.col(weight).cast("double")
    sound = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))
    keyed = rows.filter(sound).withColumn("__key", -F.ln(uniform(seed, *key)) / w)
    near = list(by)
    if k > LIMIT:
        keyed, near = _begun(keyed, k, by), [*by, "__cell"]
    elif not by:
        keyed = keyed.orderBy("__key", *key).limit(k)
    place = F.row_number().over(Window.partitionBy(*(near or [F.lit(0)])).orderBy("__key", *key))
    before = F.col("__before") if k > LIMIT else F.lit(0)
    return keyed.withColumn("draw", before + place).filter(F.col("draw") <= k).drop("__key", "__cell", "__before")


def _begun(keyed: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Rows of the cells that begin within the first k of their group, with their cell and the rows before it."""
    cell = F.floor(F.log2("__key") * CELLS)
    upto = F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))  # one row a cell
    counts = keyed.groupBy(*by, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(upto, F.lit(0))).filter(F.col("__before") < k)
    keyed = keyed.withColumn("__cell", cell)
    near = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by] + [F.col("r.__cell") == F.col("c.__cell")]
    return keyed.alias("r").join(counts.alias("c"), near).select("r.*", "c.__before")


def section_picks(chunks: DataFrame, per_key: int, key: str, section: str, order: list[str], buckets: list[str] = BUCKETS) -> DataFrame:
    """max(1, per_key / buckets) consecutive chunks of each section of a key, past the first where enough follow. Each task keeps
    that many and two more a section, and only those are shuffled."""
    n = max(1, per_key // max(1, len(buckets)))
    own = Window.partitionBy(key, section)
    few = chunks.filter(F.col(section).isin(buckets)).withColumn("__i", F.row_number().over(own.orderBy(*order))).filter(F.col("__i") <= n + 2)
    start = F.when(F.count(F.lit(1)).over(own) > n + 1, 1).otherwise(0)
    return few.withColumn("__start", start).filter((F.col("__i") > F.col("__start")) & (F.col("__i") <= F.col("__start") + n)).drop("__i", "__start")


def holds(text: str, span: str) -> bool:
    """Whether a text holds a span, white space and case aside; of a long span its first or last characters will do."""
    text, span = (" ".join((x or "").split()).lower() for x in (text, span))
    return bool(span) and (span in text or (len(span) > PROBE and (span[:PROBE] in text or span[-PROBE:] in text)))


def next_type(left: dict[str, int], u: float) -> str | None:
    """The type of the next question about one chunk: drawn with u by what is left of each quota; without lookups left, sections go
    before what is out of scope; where neither that nor synthesis is asked for, lookups go first. None when all are full."""
    open_ = [t for t in SINGLE if left[t] > 0]
    if not open_:
        return None
    if "lookup" not in open_ or not (left["synthesis"] or left["out_of_scope"]):
        return open_[0]
    at = u * sum(left[t] for t in open_)
    for t in open_:
        at -= left[t]
        if at < 0:
            return t
    return open_[-1]


def allotted(total: int, shares: dict[str, float] = SHARES) -> dict[str, int]:
    """Questions of each type: halves go to the even number; of synthesis and out of scope one at least from five on, none below."""
    out = {t: round(total * s) for t, s in shares.items()}
    return {t: (max(1, n) if total >= 5 else 0) if t in ("synthesis", "out_of_scope") else n for t, n in out.items()}


def template_synthesis(texts: list[str]) -> tuple[str, str] | None:
    firsts = [(t or "").split()[:8] for t in texts]
    if any(len(w) < 4 for w in firsts):
        return None
    return f"How do {' and '.join(w[0].strip('.,').lower() for w in firsts)} relate?", " | ".join(" ".join(w) for w in firsts)


def _agreed(question: str, span: str) -> bool:
    return True


def question_set_by_quota(
    chunks: DataFrame,
    per_key: int,
    write: Callable[[str, str], tuple[str, str] | None] = template_question,
    combine: Callable[[list[str]], tuple[str, str] | None] = template_synthesis,
    verify: Callable[[str, str], bool] = _agreed,
    seed: int = 0,
    key: str = "doc_key",
    section: str = "section_id",
    order: tuple[str, ...] = ("chunk_id",),
    buckets: list[str] = BUCKETS,
    shares: dict[str, float] = SHARES,
) -> DataFrame:
    """id, key, section, chunk_id, qa_type, question, source_span, verification_reason.

    Picks of a key's sections are asked about in a repeatable random order. A question's type is drawn by what is left of each
    quota at that moment; only a question that is kept uses up its quota: its span stands in the chunk and `verify` agrees, or
    it is out of scope. What can't be written is passed by. Then one synthesis question over the first picks of two or three
    sections is kept if each part of its span stands in its chunk. Ids run without gaps in the order of key and question.

    A key's draws depend on one another, so they run in one call; it has at most max(per_key, number of sections) chunks, however
    many the key has. A null key is a key like any other; a section that is null or in no bucket is never asked about; null
    texts are empty ones; an empty table gives an empty set."""
    quota = allotted(per_key, shares)
    schema = f"{key} string, ord int, {section} string, chunk_id string, qa_type string, question string, source_span string, verification_reason string"
    names = [c.split()[0] for c in schema.split(", ")]

    def tried(f, *args):
        try:
            return f(*args)
        except Exception:
            return None

    def singles(picks: pd.DataFrame) -> Iterator[tuple]:
        left, kept = dict(quota), 0
        for p in picks.itertuples(index=False):
            kind = next_type(left, p.u) if kept < sum(quota.values()) else None
            if kind is None:
                return
            made = tried(write, p.text, kind)
            if made is None:
                continue
            question, span = (x.strip() for x in made)
            if kind == "out_of_scope":
                span, reason = NO_SPAN, "out of scope by design"
            elif holds(p.text, span) and tried(verify, question, span):
                reason = "supported"
            else:
                continue
            left[kind] -= 1
            kept += 1
            yield p.section, p.chunk_id, kind, question, span, reason

    def synthesis(picks: pd.DataFrame) -> Iterator[tuple]:
        firsts = picks.drop_duplicates("section").sort_values(["v", "section"]).head(3)
        if quota["synthesis"] <= 0 or len(firsts) < 2:
            return
        made = tried(combine, list(firsts["text"]))
        if made is None:
            return
        question, span = (x.strip() for x in made)
        if all(holds(t, s) for s, t in zip(span.split("|"), firsts["text"])):
            yield ",".join(firsts["section"].iloc[:2]), firsts["chunk_id"].iloc[0], "synthesis", question, span, "all parts found"

    def of_key(picks: pd.DataFrame) -> pd.DataFrame:
        picks = picks.sort_values(["at", "chunk_id"])
        rows = [*singles(picks), *synthesis(picks)]
        return pd.DataFrame([(picks["key"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=names)

    picks = section_picks(chunks, per_key, key, section, list(order), buckets).select(
        F.col(key).cast("string").alias("key"),
        F.col(section).alias("section"),
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        uniform(seed, key, "chunk_id").alias("at"),
        uniform(seed + 1, key, "chunk_id").alias("u"),
        uniform(seed, key, section).alias("v"),
    )
    rows = numbered(picks.groupBy("key").applyInPandas(of_key, schema), "__n", [key, "ord"])
    return rows.select(F.format_string("q_%04d", "__n").alias("id"), *[c for c in names if c != "ord"])
