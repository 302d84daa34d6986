"""The stored inverted index against the exhaustive scan, and what it reads."""

import random

import pytest

from marlstone.operators import lexical
from marlstone.sources import postings
from marlstone.sources.postings import PostingIndex


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    say = lambda n: " ".join(words[min(199, int(r.paretovariate(0.7)) - 1)] for _ in range(n))
    return [(f"c{i:04d}", say(r.randrange(3, 60))) for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = corpus(600) + [("c0003", None), ("c9999", ""), ("c9998", "only Here, only")]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3).cache()


QUESTIONS = [(1, "w1 w5 w70"), (2, "only"), (3, "w199 w150 w150"), (4, None), (5, "nothing known"), (6, "W2!w3 w120")]


def ranks(df):
    return sorted((r.qid, r.rank, r.chunk_id, round(r.score, 8)) for r in df.collect())


def test_same_as_the_scan(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 32)
    q = spark.createDataFrame(QUESTIONS, "qid long, question string")
    want = ranks(lexical.topk(lexical.build(chunks), q, 5))
    index = PostingIndex.build(chunks, f"file://{tmp_path}/p")
    assert index.n == 603 and index.segments >= 19
    assert ranks(index.topk(q, 5)) == want
    # in two parts, read again from disk
    cut = chunks.filter("chunk_id < 'c0400'")
    PostingIndex.build(cut, f"file://{tmp_path}/q").append(chunks.filter("chunk_id >= 'c0400'"))
    assert ranks(PostingIndex(spark, f"file://{tmp_path}/q").topk(q, 5)) == want
    assert index.topk(q, 0).count() == 0 and index.topk(q.limit(0), 5).count() == 0
    assert PostingIndex.build(chunks.limit(0), f"file://{tmp_path}/r").topk(q, 5).count() == 0


def test_only_asked_terms_and_promising_segments_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 16)
    rows = [(f"c{i:04d}", "rare rare rare" if 100 <= i < 108 else f"rare {'filler ' * 40}" if i % 16 == 0 else f"other x{i}") for i in range(480)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1)
    index = PostingIndex.build(chunks, f"file://{tmp_path}/p")
    q = spark.createDataFrame([(1, "rare")], "qid long, question string")
    assert [r.chunk_id for r in index.topk(q, 5).orderBy("rank").collect()] == [f"c{i:04d}" for i in range(100, 105)]
    scored, held = index.read
    assert scored <= 6 and held >= 25
    bucket = {int(f.parent.name[7:]) for f in tmp_path.glob("p/lists/bucket=*/*.parquet")}
    own = {r.bucket for r in index.lists(["rare"]).select("bucket").distinct().collect()}
    assert len(own) == 1 and len(bucket) > 20
    for f in tmp_path.glob("p/lists/bucket=*/*.parquet"):
        if int(f.parent.name[7:]) not in own:
            f.write_bytes(b"broken")
    assert PostingIndex(spark, f"file://{tmp_path}/p").topk(q, 5).count() == 5
