"""Weighted draws, numbers without gaps, and question sets by quota."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import NO_SPAN
from marlstone.operators import draws, numbering


def key_of(seed, *parts):
    import hashlib

    return (int(hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_chances_follow_the_weights(spark):
    weights = [1.0, 2.0, 3.0, 4.0]
    rows = spark.range(12_000).select(F.col("id").alias("g"), F.posexplode(F.array(*map(F.lit, weights))).alias("i", "w"))
    got = draws.weighted(rows, "w", 2, ["g"], ["g", "i"], 1).groupBy("g").agg(F.min_by("i", "draw").alias("a"), F.max_by("i", "draw").alias("b")).groupBy("a", "b").count().collect()
    off = 0.0
    for r in got:
        expected = 12_000 * weights[r.a] / 10 * weights[r.b] / (10 - weights[r.a])
        off += (r["count"] - expected) ** 2 / expected
    assert len(got) == 12 and off < 31.3  # 0.1 % point for eleven degrees of freedom


@pytest.mark.parametrize("k", [0, 7, 1500])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_equals_sorting_by_the_key(spark, k, by):
    data = [(None if i % 11 == 0 else i % 3, i, [1.5, 0.0, -1.0, None, math.nan, math.inf, 1e-300, 1e300][i % 8 if i % 5 == 0 else 0]) for i in range(6000)]
    rows = spark.createDataFrame(data, "g int, i int, w double").repartition(5)
    want = {}
    for g, i, w in data:
        if w is not None and 0 < w < math.inf:
            want.setdefault(g if by else 0, []).append((-math.log(key_of(2, i)) / w, i))
    want = {(g, d, i) for g, x in want.items() for d, (_, i) in enumerate(sorted(x)[:k], 1)}
    got = draws.weighted(rows, "w", k, by, ["i"], 2).collect()
    assert {(r.g if by else 0, r.draw, r.i) for r in got} == want and len(got) == len(want)


def test_a_small_draw_is_limited_before_the_shuffle_and_clashing_names(spark):
    rows = spark.range(100).select(F.col("id").alias("draw"), F.lit(1).alias("w"), (F.col("id") % 2).alias("g"))
    plan = draws.weighted(rows.withColumnRenamed("draw", "i"), "w", 5, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan
    with pytest.raises(ValueError):
        draws.weighted(rows, "w", -1, ["g"], ["draw"])
    assert draws.weighted(rows.limit(0), "w", 3, ["g"], ["draw"]).count() == 0


def test_numbers_without_gaps(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 2 else str(i % 5), i) for i in range(3000)], "k string, i int").repartition(9)
    got = sorted(numbering.numbered(rows, "n", ["k", "i"]).collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, 3001))
    assert [(r.k or "", r.i) for r in got] == sorted((r.k or "", r.i) for r in got)
    assert numbering.numbered(rows.limit(0), "n", ["k"]).count() == 0


def test_types_are_drawn_by_what_is_left():
    r = random.Random(0)
    full = {"lookup": 4, "section": 3, "synthesis": 2, "out_of_scope": 1}
    n = [draws.next_type(full, r.random()) for _ in range(16_000)]
    assert sum((n.count(t) - e) ** 2 / e for t, e in (("lookup", 8000), ("section", 6000), ("out_of_scope", 2000))) < 13.8
    assert draws.next_type({**full, "lookup": 0}, 0.99) == "section"
    assert draws.next_type({**full, "lookup": 0, "section": 0}, 0.0) == "out_of_scope"
    assert draws.next_type({"lookup": 1, "section": 9, "synthesis": 0, "out_of_scope": 0}, 0.99) == "lookup"
    assert draws.next_type({"lookup": 0, "section": 0, "synthesis": 2, "out_of_scope": 0}, 0.5) is None
    assert draws.allotted(10) == full and draws.allotted(3) == {"lookup": 1, "section": 1, "synthesis": 0, "out_of_scope": 0}


def rows_of(spark, n=400):
    texts = [f"Alpha{i} beta gamma delta epsilon zeta eta number {i} of the lines here" for i in range(n)]
    data = [(None if i % 4 == 0 else "A" if i % 4 < 3 else "B", ["item_1", "item_1a", "item_7", "item_7a", "item_8", "other", None][i % 7], f"c{i:04d}", t, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, ("C", "item_1", "c9", None, 1), ("C", "item_7", "c8", "", 1)], "doc_key string, section_id string, chunk_id string, text string, ord int")


def test_quotas_are_filled_and_failures_use_none_up(spark):
    asked = []

    def write(text, kind):
        if text.endswith("7 of the lines here"):
            raise RuntimeError("down")
        words = text.split()
        return (f"{kind}?", "not there") if "3" in words[0] else (f" {kind}? ", "  " + " ".join(words[:5]).upper())

    got = draws.question_set_by_quota(rows_of(spark), 20, write, seed=5).collect()
    assert sorted(r.id for r in got) == [f"q_{i:04d}" for i in range(1, len(got) + 1)] and not asked
    for key in (None, "A", "B"):
        own = sorted((r for r in got if r.doc_key == key), key=lambda r: r.id)
        kinds = [r.qa_type for r in own]
        assert kinds.count("lookup") <= 8 and kinds.count("section") <= 6 and kinds.count("out_of_scope") <= 2
        assert kinds[-1] == "synthesis" and kinds.count("synthesis") == 1 and len(own) > 8
        first = own[-1].section_id.split(",")
        assert len(set(first)) == 2 and own[-1].source_span.count("|") == 2
        assert all(r.source_span == NO_SPAN for r in own if r.qa_type == "out_of_scope")
        assert all("3" not in r.source_span.split()[0] for r in own if r.qa_type in ("lookup", "section"))
        assert {r.section_id for r in own[:-1]} <= {"item_1", "item_1a", "item_7", "item_7a", "item_8"}
    assert not [r for r in got if r.doc_key == "C"]
    again = draws.question_set_by_quota(rows_of(spark).repartition(7), 20, write, seed=5).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_empty_set_and_no_synthesis_with_one_section(spark):
    rows = rows_of(spark)
    assert draws.question_set_by_quota(rows.limit(0), 10).count() == 0
    one = draws.question_set_by_quota(rows.filter("section_id = 'item_1' and doc_key = 'A'"), 10).collect()
    assert one and all(r.qa_type != "synthesis" for r in one)
