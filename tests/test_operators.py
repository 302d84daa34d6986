import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import chats, chunking, embedding, ledger, lexical, metrics, parsing, rerank, retrieval, routing, sampling


def sections(spark, *texts, section="item_1"):
    return spark.createDataFrame([(f"d{i}", section, t) for i, t in enumerate(texts)], "doc_key string, section_id string, text string")


def reference_windows(words, size, overlap):
    out, at = [], 0
    while at < len(words):
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
        at += size - overlap
    return out


def test_naive_edges(spark):
    for n in (0, 1, 5, 6, 8, 9, 10, 23):
        words = [f"w{i}" for i in range(n)]
        got = [r.text for r in chunking.naive(sections(spark, " ".join(words)), 5, 2).orderBy("chunk_index").collect()]
        assert got == reference_windows(words, 5, 2)
    with pytest.raises(ValueError):
        chunking.naive(sections(spark, "a"), 5, 5)
    with pytest.raises(ValueError):
        chunking.chunk(sections(spark, "a"), "late")


def test_chunk_ids(spark):
    got = chunking.naive(sections(spark, "a b c d e f g"), 4, 1).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in got] == ["d0_item_1::0000", "d0_item_1::0001"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 60))
def test_recursive_properties(t, size):
    pieces = chunking.split_recursive(t, size, size // 4)
    assert all(0 < len(p) <= size and p.strip() for p in pieces)
    assert set("".join(t.split())) <= set("".join("".join(pieces).split())) | set(".")


def test_recursive_prefers_paragraphs():
    assert chunking.split_recursive("aaaa bbbb\n\ncccc dddd", 12, 2) == ["aaaa bbbb", "cccc dddd"]
    assert chunking.split_recursive("x" * 10, 4, 1) == ["xxxx", "xxxx", "xxxx", "x"]


def test_semantic_splits_where_the_topic_turns():
    def embed(said):
        return np.array([[1.0, 0.0] if "cat" in s else [0.0, 1.0] for s in said])

    got = chunking.split_semantic("cat one. cat two. dog one. dog two.", embed, str.split, 50, 5)
    assert got[0] == "cat one. cat two." and got[1].startswith("cat two. dog one.")
    assert chunking.split_semantic("only one", embed, str.split, 50, 5) == ["only one"]
    assert chunking.split_semantic("", embed, str.split) == []
    assert len(chunking.split_semantic("a " * 30, embed, str.split, 10, 2)) == 4


def test_structural_budgets(spark):
    body = "one two three. " * 200
    small = chunking.structural(sections(spark, body, section="item_1a"))
    large = chunking.structural(sections(spark, body, section="item_7"))
    assert small.count() > large.count()
    assert chunking.budgets(sections(spark, "x", section="item_9")).first().section_budget == 2000


def test_parents_and_children(spark):
    parents, children = chunking.parent_child(sections(spark, " ".join(map(str, range(50)))), 20, 5, 8, 2)
    naive = chunking.naive(sections(spark, " ".join(map(str, range(50)))), 20, 5)
    assert {r.text for r in parents.collect()} == {r.text for r in naive.collect()}
    assert {r.parent_id for r in children.collect()} == {r.chunk_id for r in parents.collect()}
    assert children.filter("chunk_id like '%::0000:c00'").count() == 1


def test_parsing_keeps_the_longest(spark):
    long, other = "alpha " * 120, "beta " * 130
    page = f"<html><style>p</style><p>Item 1. Business</p>short<p>Item 1A. Risk Factors</p><h2>Item 1. Business</h2><p>{long}</p><h2>item 1a. risk factors</h2><p>{other}</p><script>Item 2. Properties</script></html>"
    docs = spark.createDataFrame([("f", page)], "doc_key string, html string").select("doc_key", parsing.html_text(F.col("html")).alias("text"))
    got = {r.section_id: r for r in parsing.parse(docs).collect()}
    assert set(got) == {"item_1", "item_1a"}
    assert got["item_1"].text == long.strip() and got["item_1a"].title == "item 1a. risk factors"
    rate = parsing.parse_rate(docs, parsing.parse(docs)).first()
    assert rate.found == 2 and rate.parse_rate == pytest.approx(2 / 9) and "item_8" in rate.missing


def test_sparse_and_dense_vectors_agree(spark):
    texts = ["The cat sat", "déjà vu Déjà", "", "a a a b", "naïve the the the end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = np.zeros((len(texts), 32))
    for r in embedding.sparse(df, "id", "text", 32).collect():
        got[r.id, r.idx] = r.w
    assert np.allclose(got, np.array([embedding.hashed(t, 32) for t in texts]))


def corpus(spark):
    return spark.createDataFrame([("c1", "net revenue rose in 2023"), ("c2", "risk of supply and revenue"), ("c3", "the the the")], "chunk_id string, text string")


def ask(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "qid long, question string")


def test_bm25(spark):
    index = lexical.build(corpus(spark))
    got = lexical.topk(index, ask(spark, "supply risk", "nothing here"), 3).orderBy("qid", "rank").collect()
    assert [r.chunk_id for r in got if r.qid == 0][0] == "c2"
    assert [(r.chunk_id, r.score) for r in got if r.qid == 1] == [("c1", 0.0), ("c2", 0.0), ("c3", 0.0)]
    assert lexical.topk(index, ask(spark, "x"), 0).count() == 0
    # by hand: the document holds each once, a repeated question term counts twice
    one = {r.chunk_id: r.score for r in lexical.scores(index, ask(spark, "supply")).collect()}
    two = {r.chunk_id: r.score for r in lexical.scores(index, ask(spark, "supply supply")).collect()}
    assert two["c2"] == pytest.approx(2 * one["c2"])


def test_negative_weights_are_a_share_of_the_mean(spark):
    df = spark.createDataFrame([(f"c{i}", "common" + (" rare" if i == 0 else "")) for i in range(4)], "chunk_id string, text string")
    idf = {r.term: r.idf for r in lexical.build(df).terms.collect()}
    raw = {"common": math.log(0.5) - math.log(4.5), "rare": math.log(3.5) - math.log(1.5)}
    assert idf["common"] == pytest.approx(0.25 * sum(raw.values()) / 2)


def test_dense_in_blocks_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    x[7] = 0
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(5)
    q = v.filter("id < 9").withColumnRenamed("id", "qid")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    got = {}
    for row in retrieval.dense(v, q, 6).orderBy("qid", "rank").collect():
        got.setdefault(row.qid, []).append(row.chunk_id)
    n = np.where((l := np.linalg.norm(x, axis=1)) == 0, 1, l)
    s = np.round((x @ x.T) / np.outer(n, n), 9)
    for i in range(9):
        assert got[i] == sorted(range(60), key=lambda j: (-s[i, j], j))[:6]


def lists(spark, *rows):
    return spark.createDataFrame(list(rows), "qid long, list_no int, chunk_id string, rank long")


def test_fusion(spark):
    a = lists(spark, (0, 0, "x", 1), (0, 0, "y", 2)).drop("list_no")
    b = lists(spark, (0, 1, "z", 1), (0, 1, "x", 2)).drop("list_no")
    got = retrieval.hybrid(a, b, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "z", "y"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)
    tied = retrieval.several(lists(spark, (0, 0, "b", 1), (0, 1, "a", 1)), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in tied] == ["b", "a"]


def test_hypothetical_leaves_questions_without_one(spark):
    base = lists(spark, (0, 0, "x", 1), (1, 0, "y", 1)).withColumn("score", F.lit(3.0)).drop("list_no")
    extra = lists(spark, (0, 0, "z", 1)).drop("list_no")
    got = retrieval.with_hypothetical(base, extra, 5)
    assert {(r.qid, r.chunk_id) for r in got.collect()} == {(0, "x"), (0, "z"), (1, "y")}
    assert got.filter("qid = 1").first().score == 3.0


def test_parents_in_order_of_their_first_child(spark):
    ranking = spark.createDataFrame([(0, "a:c1", 1, 0.9), (0, "b:c0", 2, 0.8), (0, "a:c0", 3, 0.7), (0, "lost", 4, 0.6)], "qid long, chunk_id string, rank long, score double")
    children = spark.createDataFrame([("a:c0", "a"), ("a:c1", "a"), ("b:c0", "b"), ("lost", "")], "chunk_id string, parent_id string")
    parents = spark.createDataFrame([("a", ""), ("b", "")], "chunk_id string, text string")
    got = retrieval.to_parents(ranking, children, parents, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("a", 0.9), ("b", 0.8)]


def test_strategies(spark):
    b = retrieval.Bundle(corpus(spark), None, 64)
    for s in ("dense", "bm25", "hybrid"):
        assert retrieval.retrieve(b, ask(spark, "supply risk"), s, 2).orderBy("rank").first().chunk_id == "c2"
    with pytest.raises(ValueError):
        retrieval.retrieve(b, ask(spark, "x"), "graph")
    with pytest.raises(ValueError):
        retrieval.retrieve(b, ask(spark, "x"), "parent_doc")


def test_rerank_order(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0.9, None), (0, "b", 2, 0.8, 5.0), (0, "c", 3, 0.7, 5.0), (0, "d", 4, 0.6, 9.0)], "qid long, chunk_id string, rank long, score double, model_score double")
    got = rerank.ordered(rows, 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["d", "b", "c", "a"] and got[0].score == 0.6


def test_model_seams_survive_failures(spark):
    def _fails(*_):
        raise RuntimeError("no model")

    q = ask(spark, "what is it")
    assert rerank.expand(q, _fails).count() == 1
    assert rerank.hypothetical(q, _fails).count() == 0
    top = spark.createDataFrame([(0, "c1", 1, 0.9), (0, "c2", 2, 0.8)], "qid long, chunk_id string, rank long, score double")
    for scorer in (rerank.guarded(_fails), rerank.batched(_fails)):
        got = rerank.rerank(top, q, corpus(spark), 5, scorer).orderBy("rank").collect()
        assert [r.chunk_id for r in got] == ["c1", "c2"] and got[0].model_score is None
    got = rerank.rerank(top, q, corpus(spark), 5, rerank.guarded(lambda q, t: 99)).first()
    assert got.model_score == 10.0


def test_spans(spark):
    full = "x" * 60 + " mid " + "y" * 60
    cases = [
        ("Hello  World", "say hello world now", True),
        (full, full[:100], True),
        (full, "..." + full[-100:], True),
        (full[:100], full[:99], False),
        ("", "abc", False),
        ("abc", "", False),
        ("ell", "hello", True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i long, s string, t string")
    got = [r[0] for r in df.orderBy("i").select(text.span_in(text.comparable(F.col("s")), text.comparable(F.col("t")))).collect()]
    assert got == [c for *_, c in cases]
    spans = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(cases)], "qid long, span string")
    texts = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(cases)], "text_id long, text string")
    pairs = {(r.qid, r.text_id) for r in metrics.span_matches(spans, texts).collect()}
    assert {i for i, (*_, c) in enumerate(cases) if c} == {i for i, j in pairs if i == j}
    normal = spark.createDataFrame([("  <no relevant span> ",), ("<no relevant span>.",), (None,), (" a ",)], "s string").select(text.normal_span(F.col("s")))
    assert [r[0] for r in normal.collect()] == ["", "<no relevant span>.", "", "a"]


def test_scores_out_of_scope(spark):
    rows = spark.createDataFrame(
        [(0, "out_of_scope", "s", "x", ["a"], ["t"], [], [], "I cannot find it"), (1, "lookup", "s", "Hit me", ["s"], ["well, hit  me!"], ["s"], ["no"], ""), (2, "lookup", "s", "", ["b"], ["t"], ["b"], ["t"], "")],
        "qid long, qa_type string, source_id string, span string, retrieved array<string>, retrieved_texts array<string>, cited array<string>, cited_texts array<string>, answer string",
    )
    got = {r.qid: (r.hit, r.hit_content, r.cite, r.cite_content) for r in metrics.hits(rows).collect()}
    assert got == {0: (True, True, True, True), 1: (True, True, True, False), 2: (False, False, False, False)}


def ledger_small(spark):
    rows = [("a", "2024-01-01", 0, "0.5", "None"), ("b", "2024-01-03", 1, " 0.7", ""), ("c", "2024-01-02", 2, "0.7", "n/a"), ("d", "2024-01-04", 3, None, "0.2")]
    return ledger.coerced(spark.createDataFrame(rows, "exp_name string, timestamp string, ord long, context_recall string, faithfulness string"))


def test_leaderboard(spark):
    got = {r.category: r for r in ledger.winners(ledger_small(spark)).collect()}
    assert (got["chunking"].winner, got["chunking"].runner_up) == ("b", "c")
    assert (got["end_to_end"].winner, got["end_to_end"].runner_up) == ("d", None)
    assert got["vectordb"].winner is None
    assert [r.exp_name for r in ledger.history(ledger_small(spark)).collect()] == ["d", "b", "c", "a"]


def test_unique_maxima(spark):
    df = spark.createDataFrame([("a", 0.5, 0.9), ("b", 0.5, 0.1), ("c", None, 0.2)], "exp_name string, x double, y double")
    got = {r.exp_name: r for r in ledger.unique_maxima(df, ["x", "y"]).collect()}
    assert got["a"].x == "0.5000" and got["a"].y == "**0.9000**" and got["c"].x == "—" and not got["a"].leads


def test_drift(spark):
    row = lambda **kw: spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} double" for k in kw))
    base = row(n_questions=139.0, hit_at_5=0.8, faithfulness=0.5, mean_latency_ms=100.0)
    bad = row(n_questions=139.0, hit_at_5=0.6, faithfulness=0.7, mean_latency_ms=201.0)
    small = row(n_questions=10.0, hit_at_5=0.6, faithfulness=0.5, mean_latency_ms=100.0)
    names = ["hit_at_5", "faithfulness"]
    got = ledger.verdict(ledger.drift(base, bad, names)).first()
    assert not got.ok and got.breaches == ["hit_at_5", "mean_latency_ms"] and got.improvements == ["faithfulness"]
    assert ledger.verdict(ledger.drift(base, small, names)).first().ok


def test_routing(spark):
    df = spark.createDataFrame([("What does Item 7A say on rates and hedges overall?",), ("net revenue 2023?",), ("How did the company change its view of supply risk?",)], "q string")
    assert [r[0] for r in df.select(text.route(F.col("q"))).collect()] == ["bm25", "bm25", "hybrid"]
    outcomes = spark.createDataFrame([(0, "a", True, True), (0, "b", False, False), (1, "a", False, False), (1, "b", True, False)], "qid long, strategy string, hit boolean, cite boolean")
    pick = lambda *rows: spark.createDataFrame(list(rows), "qid long, strategy string")
    got = routing.score(outcomes, pick((0, "b"), (1, "b"))).first()
    assert (got.n, got.hit_rate, got.oracle_hit_rate) == (2, 0.5, 1.0)
    with pytest.raises(Exception, match="no outcome"):
        routing.score(outcomes, pick((9, "a"))).collect()
    with pytest.raises(Exception, match="no routing"):
        routing.score(outcomes, pick((0, "a")).limit(0)).collect()
    assert routing.best_single(outcomes).first().strategy == "a"


def test_chats(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hello   there\nfriend"), (1, 1, "assistant", "hi"), (2, 0, "system", "x")], "conv_id long, turn long, role string, text string")
    got = chats.summaries(turns).collect()
    assert [(r.conv_id, r.title) for r in got] == [(2, "New chat"), (1, "Hello there friend")]
    assert [r.conv_id for r in chats.search(turns, " HI ").collect()] == [1]
    assert chats.search(turns, " ").count() == 2
    assert chats.appended(turns, 1, "user", "more").filter("turn = 2").count() == 1
    with pytest.raises(ValueError):
        chats.appended(turns, 1, "system", "x")
    with pytest.raises(ValueError):
        chats.renamed("  ")
    assert chats.renamed("a " * 60).endswith("a") and len(chats.renamed("a " * 60)) <= 80


def test_sampling(spark):
    rows = spark.createDataFrame([("k", "2024-01-02", None, "b"), ("k", "2024-01-01", "x", "a")], "key string, day string, v string, w string")
    got = sampling.latest(rows, "key", "day", "v", "w").first()
    assert (got.v, got.w) == ("x", "b")
    five = spark.range(1).select(*[c.alias(k) for k, c in sampling.quotas(F.lit(5)).items()]).first()
    assert (five.lookup, five.section, five.synthesis, five.out_of_scope) == (2, 2, 1, 1)
    a = [r.id for r in sampling.shuffled(spark.range(20), 3, "id").collect()]
    assert a == [r.id for r in sampling.shuffled(spark.range(20).repartition(3), 3, "id").collect()] and a != sorted(a)
    made = sampling.question_set(corpus(spark).withColumn("doc_key", F.lit("d")).withColumn("text", F.concat_ws(" ", "text", "text", "text")), 10)
    assert [r.id for r in made.orderBy("id").collect()] == ["q_0001", "q_0002", "q_0003"]


# ---- filings as they are written


@pytest.mark.parametrize("gap", [" ", "&#160;", "&nbsp;", "&#xA0;", " ", "&#x2003;", "\n"])
def test_headers_with_any_space(spark, gap):
    body = "It makes instruments &amp; sells them. " * 30
    page = f"<html><body><p>Item{gap}1.{gap}Business</p><p>{body}</p></body></html>"
    docs = spark.createDataFrame([("f", page)], "doc_key string, html string").select("doc_key", parsing.html_text(F.col("html")).alias("text"))
    rows = parsing.parse(docs).collect()
    assert [(r.section_id, r.char_count) for r in rows] == [("item_1", 30 * len("It makes instruments & sells them. ") - 1)]


def test_character_references(spark):
    cases = {
        "a &lt;b&gt; &amp;amp; &amp;#160;x": "a <b> &amp; &#160;x",
        "&#8217;s &#x2019; &rsquo; &eacute;t&eacute &#146; &#x80;": "’s ’ ’ été ’ €",
        "&unknown; & &; &#; AT&T &#0; &#x110000; &#xD800; &#99999999999999999999;": "&unknown; & &; &#; AT&T � � � �",
        "&notin; &sect;1 &frac12 &#128512; &#x1F600;": "∉ §1 ½ \U0001f600 \U0001f600",
        "plain": "plain",
        "": "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    for r in df.select("t", "want", text.unescaped(F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_text_nodes(spark):
    page = "<html><head><title>T</title></head><body><table><tr><td>a</td><td>b</td></tr></table>x<b>y</b><!-- no --><script>var z='</p>'</script>w</body></html>"
    got = spark.createDataFrame([(page,), ("<td></td>" * 20000 + "q",)], "html string").select(parsing.html_text(F.col("html")).alias("t")).collect()
    assert [r.t for r in got] == ["T\na\nb\nx\ny\nw", "q"]


def test_python_white_space(spark):
    t = "one two three\x1cfour 　five​six"
    row = spark.createDataFrame([(f" {t} ",)], "t string").select(text.white_tokens(F.col("t")).alias("w"), text.strip(F.col("t")).alias("s"), text.collapse(F.col("t")).alias("c")).first()
    assert row.w == t.split() and row.s == t and row.c == " ".join(t.split())


# ---- chunkers on places


def by_levels(text, size, overlap):
    """All at once, a separator at a time: a list of pieces, each too long one replaced by its packed parts."""
    held = [text]
    for sep in ["\n\n", "\n", ". ", " "]:
        new = []
        for piece in held:
            if len(piece) <= size or sep not in piece:
                new.append(piece)
                continue
            line = None
            for part in piece.split(sep):
                if line is not None and line != "" and len(line) + len(sep) + len(part) <= size:
                    line += sep + part
                else:
                    new += [line] if line else []
                    line = part
            new += [line] if line else []
        held = new
    out = []
    for piece in held:
        out += [piece] if len(piece) <= size else [piece[k : k + size] for k in range(0, len(piece), size - overlap)]
    return [x for x in out if x.strip()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb ", "ccc. ", "\n", "\n\n", " ", "dddddddddd", ". "]), max_size=60), st.integers(3, 25))
def test_recursive_equals_levels(parts, size):
    t = "".join(parts)
    assert chunking.split_recursive(t, size, size // 3) == by_levels(t, size, size // 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=25), st.sets(st.integers(1, 24)), st.integers(2, 12))
def test_semantic_runs_step_by_step(sizes, opening, budget):
    """What each chunk holds, sentence by sentence."""
    opening = {k for k in opening if k < len(sizes)}
    want, held = [], []
    for k, n in enumerate(sizes):
        if n > budget:
            want += [held] * bool(held) + [[k]]
            held = []
            continue
        for cut in (k in opening, None):
            if held and (cut if cut is not None else sum(sizes[i] for i in held) + n > budget):
                want.append(held)
                held = held[-1:]
        held = [*held, k]
    want += [held] * bool(held)
    got = chunking.semantic_runs(np.array(sizes, np.int64), np.array(sorted(opening), np.int64), budget)
    assert [list(range(a, z + 1)) for a, z in got] == want
