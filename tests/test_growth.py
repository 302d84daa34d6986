"""Work and memory that grow no faster than the tables: what once grew faster, by query."""

import time

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import chunking, embedding, lexical, remote, retrieval, sampling
from marlstone.plans import fixtures as fx
from marlstone.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_a_long_text_are_cut_in_proportion(spark):
    """parent_doc_topk, hybrid_parent_topk: each window used to copy its whole text's tokens."""
    n = 400_000
    rows = spark.range(1).select(F.lit("d").alias("doc_key"), F.lit("s").alias("section_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ").alias("text"))
    t = time.time()
    parents, children = chunking.parent_child(rows, 128, 16, 48, 8)
    got = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.max("child_index").alias("last")).agg(F.count(F.lit(1)), F.sum("n"), F.max("last")).first()
    assert time.time() - t < 10
    want = -(-(n - 16) // 112)
    assert got[0] == want and got[2] == 2
    assert parents.count() == want
    last = parents.orderBy(F.desc("chunk_index")).first().text.split()
    assert last[-1] == str(n) and last[0] == str(112 * (want - 1) + 1)


def test_children_stay_where_they_are(spark):
    """parent_doc_topk, hybrid_parent_topk: all children and parents used to be shuffled to meet a few ranked ones."""
    parents = spark.range(50).select(F.format_string("p%d", "id").alias("chunk_id"))
    children = spark.range(200).select(F.format_string("c%d", "id").alias("chunk_id"), F.when(F.col("id") == 7, "").when(F.col("id") == 8, "gone").otherwise(F.format_string("p%d", F.floor(F.col("id") / 4))).alias("parent_id"))
    ranking = spark.createDataFrame([(1, "c7", 1, 0.9), (1, "c8", 2, 0.8), (1, "c9", 3, 0.7), (1, "c41", 4, 0.6), (1, "c11", 5, 0.5), (2, "c0", 1, 0.4)], "qid long, chunk_id string, rank long, score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = retrieval.to_parents(ranking, children, parents, 5)
        assert [tuple(r) for r in out.orderBy("qid", "rank").collect()] == [(1, "p2", 1, 0.7), (1, "p10", 2, 0.6), (2, "p0", 1, 0.4)]
        assert "SortMergeJoin" not in plan(out) and "hashpartitioning(chunk_id" not in plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def texts(spark, n=300):
    rng = np.random.default_rng(3)
    said = [(f"c{i:04d}", " ".join(f"w{j}" for j in np.minimum(rng.zipf(1.3, 20), 400))) for i in range(n)]
    return said, spark.createDataFrame([*said, ("c9999", None)], "chunk_id string, text string").repartition(3)


def brute(said, question, n):
    """BM25 of every chunk that shares a term."""
    words = {c: t.split() for c, t in said}
    avg = sum(map(len, words.values())) / n
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    return {c: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in question.split() if t in w) for c, w in words.items() if set(w) & set(question.split())}


def test_tokens_are_not_kept_and_scores_are_not_shuffled(spark):
    """bm25_topk, bm25_idf, bm25_scores: tokens used to be cached, a whole file's split in one block, and every posting shuffled."""
    said, chunks = texts(spark)
    asked = [(i, " ".join(f"w{j}" for j in (1, 2, 2, 3 + i % 5, 17 + i, 400))) for i in range(40)]
    questions = spark.createDataFrame(asked, "qid long, question string")
    index = lexical.build(chunks)
    assert not index.tokens.is_cached and "InMemoryTableScan" not in plan(index.tokens)
    out = lexical.scores(index, questions)
    assert "hashpartitioning(" not in plan(out)
    got = {(r.qid, r.chunk_id): r.score for r in out.collect()}
    want = {(i, c): x for i, q in asked for c, x in brute(said, q, 301).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    top = lexical.topk(index, questions, 4).collect()
    for i, _ in asked:
        own = sorted(((round(x, 9), c) for (q, c), x in want.items() if q == i), key=lambda r: (-r[0], r[1]))[:4]
        assert [r.chunk_id for r in sorted((r for r in top if r.qid == i), key=lambda r: r.rank)] == [c for _, c in own]
    index.close()


def test_stratified_rows_are_picked_where_they_lie(spark):
    """stratified_slice: a bucket used to come together in one task, to be counted and sorted."""
    rows = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"), F.when(F.col("id") < 1500, "a").when(F.col("id") < 1504, "b").when(F.col("id") < 1505, "c").otherwise("x").alias("g")).repartition(5)
    out = sampling.stratified(rows, "g", ["k"], 12, ["a", "b", "c", "none"])
    keys = {g: sorted(r.k for r in rows.filter(F.col("g") == g).collect()) for g in "abc"}
    want = [("a", k) for k in keys["a"][1:4]] + [("b", k) for k in keys["b"][:3]] + [("c", k) for k in keys["c"][:1]]
    assert sorted((r.g, r.k) for r in out.collect()) == sorted(want)
    assert plan(out).count("TakeOrderedAndProject") >= 4
    large = sampling.stratified(rows, "g", ["k"], 40_000, ["a", "b"])
    assert sorted((r.g, r.k) for r in large.collect()) == sorted(("a", k) for k in keys["a"]) + [("b", k) for k in keys["b"]]


def test_a_service_keeps_no_prompts(spark):
    """remote_calls: the stand-in used to keep every prompt that it was ever asked, and batches had no bound of bytes."""
    service = registry._FlakyService()
    with remote.Pool(remote.Limits(concurrent=4, base=0.0001)) as pool:
        got = list(pool.each(service, [("w " * (i % 20) + "x" * 100 + str(i),) for i in range(500)]))
    assert all(a.calls == 2 for a in got if not a.error) and all(a.error == "ValueError: no answer" and a.calls == 4 for a in got if a.error)
    assert list(vars(service)) == ["own"]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    remote.called(spark.range(1).select(F.lit("a").alias("p")), ["p"], "said", str)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16m"


def test_runs_share_questions_and_ranked_chunks(spark, data, monkeypatch):
    """run_overlap, route_table_pivot, best_single: three runs used to look for the questions' sources and chunk all texts again."""
    asked = []
    monkeypatch.setattr(fx, "qa", lambda *a, own=fx.qa: asked.append("qa") or own(*a))
    monkeypatch.setattr(fx, "chunks", lambda *a, own=fx.chunks: asked.append("chunks") or own(*a))
    assert registry.QUERIES["route_table_pivot"](spark, data).count() > 0
    assert sorted(asked) == ["chunks", "chunks", "qa"]  # to rank, and to pick what is ranked


def test_vectors_of_a_long_text_are_held_in_parts():
    """chunk_semantic, semantic_breakpoints: all sentences of a text used to be vectors at once."""
    seen = []
    said = [f"w{i * i % 97} w{i % 13} end" for i in range(3000)]
    d = chunking.sentence_vectors_distances(said, lambda own: seen.append(len(own)) or embedding.hashed_rows(own, 64))
    whole = np.array([embedding.hashed(x, 64) for x in said])
    assert max(seen) <= chunking.SENTENCES + 1
    assert np.array_equal(d, chunking.neighbour_distances(whole))
    assert np.array_equal(embedding.hashed_rows([*said, "", None], 64), np.array([embedding.hashed(x, 64) for x in [*said, "", None]]))


def test_dense_scans_have_bounded_batches(spark):
    """dense_topk, rrf_fuse: batches had no bound of bytes, and texts went to Spark as vectors and back."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(f"c{i:03d}", f"alpha w{i % 7} w{i % 11} w{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = retrieval.retrieve(retrieval.Bundle(df, None, 64), spark.createDataFrame([(1, "alpha w3 w5"), (2, "w199")], "qid long, question string"), "dense", 4)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16m"
    assert plan(got).count("MapInArrow") == 1
    v = np.array([embedding.hashed(t, 64) for _, t in rows])
    for qid, q in ((1, "alpha w3 w5"), (2, "w199")):
        best = sorted((-round(float(s), 9), c) for s, (c, _) in zip(v @ embedding.hashed(q, 64), rows))[:4]
        assert [r.chunk_id for r in got.filter(F.col("qid") == qid).orderBy("rank").collect()] == [c for _, c in best]
