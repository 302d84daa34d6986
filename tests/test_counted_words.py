"""Words that are made where they are counted, and places of tokens."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.functions.text import lexical_tokens
from marlstone.operators import embedding, lexical


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_made_where_they_are_counted(spark, monkeypatch):
    """bm25_scores, bm25_topk, bm25_idf and all that rank by BM25: arrays of tokens used to be made in Spark and sent to Python, and
    every chunk's terms were rows of an aggregate."""
    index = lexical.build(spark.createDataFrame([("a", "w1 w2 w3"), ("b", "w2")], "chunk_id string, text string"))
    top = lexical.topk(index, spark.createDataFrame([(1, "w1 w2")], "qid long, question string"), 3)
    assert "regexp_extract_all" not in plan(top) and "Generate" not in plan(index.counts)
    index.close()
    # all characters, each as a word of its own and between two letters; null and empty
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(f"{x}q{x}z " for x in signs[at : at + 4096])) for i, at in enumerate(range(0, len(signs), 4096))] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "chunk_id long, text string").repartition(2)
    want = {r.chunk_id: r.w for r in df.select("chunk_id", lexical_tokens(F.col("text")).alias("w")).collect()}
    assert all([t.decode() for t in lexical.words_of(x)] == want[i] for i, x in rows)
    # counts that are handed on in parts
    batch = pa.RecordBatch.from_pydict({"text": [None, "a b a", "b c", "d", "a"]})
    monkeypatch.setattr(lexical, "TERMS", 3)
    parts = list(lexical._counted(iter([batch])))
    assert len(parts) == 2
    sums = {}
    for term, df_, dl in (row.values() for p in parts for row in p.to_pylist()):
        a, b = sums.get(term, (0, 0))
        sums[term] = a + df_, b + (dl or 0)
    assert sums == {"a": (2, 0), "b": (2, 0), "c": (1, 0), "d": (1, 0), None: (5, 7)}


def test_places_of_tokens_are_kept_in_bounds(monkeypatch):
    """parent_doc_topk, rrf_fuse: each token's place went through a cache of calls."""
    monkeypatch.setattr(embedding.Places, "MOST", 50)
    said = [" ".join(f"t{i * j % 211}" for j in range(40)) for i in range(60)]
    got = embedding.hashed_rows(said, 96)
    assert 0 < len(embedding.places_by(96)) <= 50
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest(), 16) % 192
    for row, text in zip(got, said):
        counts = np.zeros(96)
        for t in text.split():
            counts[place(t) % 96] += 1 if place(t) < 96 else -1
        v = np.sign(counts) * np.log1p(np.abs(counts))
        assert np.array_equal(row, v / (np.sqrt(v @ v) or 1.0))
