"""The page scanner, the header matcher and the span automaton against hand-written cases and brute force."""

import random
import re
import time

import pytest

from marlstone.functions.markup import page_text, unescape
from marlstone.functions.text import WHITE
from marlstone.operators import metrics, parsing

PAGES = [
    (None, ""),
    ("", ""),
    ("a<b>c</b>d", "a\nc\nd"),
    ('<a title="x > y" href=\'>\'>z</a>', "z"),
    ("<p>one</p>\n\n\n<p>two</p>", "one\n\ntwo"),
    ("x<!-- a > b <p> -->y<!-->z-->w", "x\ny\nw"),
    ("x<script>if (a < b) { t('</p>') }</script >y<STYLE>p > q</STYLE>z", "x\ny\nz"),
    ("x<script src='a>b'>never closed <p>y</p>", "x"),
    ("x<!-- never closed <p>y</p>", "x"),
    ("x<![CDATA[a < b &amp; c]]>y", "x\na < b &amp; c\ny"),
    ("1 < 2 and 3 <4 a<", "1 < 2 and 3 <4 a<"),
    ("<?xml version='1.0'?><!DOCTYPE html><p>t", "t"),
    ('<a href="x>y</a> z <b>w</b>', "y\n z \nw"),
    ("a <b no end", "a <b no end"),
    ("a\x01b<p>\x00c", "a\x01b\n\x00c"),
    ("<scripty>kept</scripty>", "kept"),
    ("&lt;p&gt; &amp;amp; &#65;&#x42; &notanentity; &ampx &nbsp;", "<p> &amp; AB &notanentity; &x"),
    ("&#128; &#0; &#xD800; &#99999999999; &#x110000;", "€ � � � �"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert page_text(page) == want


def test_scanner_is_linear_and_runs_in_a_plan(spark):
    for hard in ("<" * 400_000, '<a "' * 100_000 + ">", "<!--" * 100_000, "<script>" * 60_000, "&" * 400_000, "<a '" * 100_001 + "x>", "<a href=\"" * 50_001 + ">" * 50_000, "<![CDATA[" * 50_000):
        began = time.time()
        page_text(hard)
        assert time.time() - began < 3, hard[:10]
    df = spark.createDataFrame([(p,) for p, _ in PAGES], "html string")
    assert [r.t for r in df.select(parsing.html_text(df["html"]).alias("t")).collect()] == [w for _, w in PAGES]
    assert unescape("a&lt") == "a<"


def every_match(text, headers):
    out = []
    for k, (_, p) in enumerate(headers):
        out += [(m.start(), m.end(), k) for m in re.finditer(p.replace(r"\s", f"[{WHITE}]"), text, re.I | re.A)]
    return sorted(out)


def test_headers_in_one_pass():
    r = random.Random(3)
    headers = [("ab", "ab"), ("ba", "ba+"), ("aba", "aba"), ("s", r"b\sb"), ("w", r"\bb")]
    known = parsing.Headers(headers)
    for _ in range(3000):
        text = "".join(r.choice("abAB  \xa0é") for _ in range(r.randrange(40)))
        assert sorted(known.matches(text)) == every_match(text, headers), text
    assert parsing.Headers([]).matches("abc") == []
    assert len(parsing.Headers(parsing.HEADERS).matches("Item 1. Business" * 50_000)) == 50_000


def test_sections_need_one_scan(spark, tmp_path):
    spark.createDataFrame([(f"d{i}", "<p>Item 1. Business</p>" + "word " * 200) for i in range(9)], "doc_key string, html string").write.parquet(f"{tmp_path}/pages")
    from marlstone.plans.service import sections_of

    out = sections_of(spark.read.parquet(f"{tmp_path}/pages"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert {(r.doc_key, r.section_id) for r in out.collect()} == {(f"d{i}", "item_1") for i in range(9)}


def test_spans_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = ["aa", "Ab", "b", "ba", "é", "ccc"]
    say = lambda n: "".join(r.choice(words) + r.choice(" \n\xa0") for _ in range(n))
    texts = [(i, say(r.randrange(120))) for i in range(60)] + [(97, None), (98, ""), (5, "ab b")]
    spans = [(f"q{i}", say(r.randrange(1, 5))) for i in range(40)] + [("long", texts[7][1][:140] + " zzz"), ("tail", "zzz " + texts[8][1][-150:]), ("none", None), ("blank", " "), ("q1", "b b")]
    same = metrics.same_form
    want = {(q, i) for q, s in spans if same(s) for i, t in texts if any(p in same(t) for p in metrics.probes_of(same(s)))}
    s, t = spark.createDataFrame(spans, "qid string, span string"), spark.createDataFrame(texts, "text_id long, text string").repartition(3)
    for most in (metrics.SPAN_BYTES, 30):
        monkeypatch.setattr(metrics.span_blocks, "__defaults__", (most,))
        got = [tuple(x) for x in metrics.span_matches(s, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = metrics.span_matches(s, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and metrics.span_matches(s.limit(0), t).count() == 0
