"""Lists of a stored inverted index as bytes, scored for many questions at once."""

import random

from marlstone.operators import lexical
from marlstone.sources import postings
from marlstone.sources.postings import PostingIndex


def corpus(n, seed):
    r = random.Random(seed)
    return [(f"c{i:04d}", " ".join(f"w{min(199, int(r.paretovariate(0.7)))}" for _ in range(r.randrange(3, 60)))) for i in range(n)]


def ranks(df):
    return sorted((r.qid, r.rank, r.chunk_id, round(r.score, 8)) for r in df.collect())


def test_lists_are_bytes_and_common_terms_a_matrix(spark, tmp_path, monkeypatch):
    """bm25_stored_topk: lists used to be three arrays of numbers, taken apart one by one, and every scored chunk was sorted by id
    for every question; terms that many questions ask for, and more ties than k in a segment."""
    monkeypatch.setattr(postings, "SEGMENT", 64)
    rows = corpus(300, 4) + [(f"t{i:03d}", "tie w1 tie") for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    asked = [(i, f"w1 w2 w2 w{3 + i} {'tie' if i % 3 else ''}") for i in range(40)] + [(40, "tie"), (41, "nothing")]
    q = spark.createDataFrame(asked, "qid long, question string")
    index = PostingIndex.build(chunks, f"file://{tmp_path}/p")
    kinds = dict(index._lists.dtypes)
    assert kinds["body"] == "binary" and "array<int>" not in kinds.values()
    for k in (1, 5, 120):
        assert ranks(index.topk(q, k)) == ranks(lexical.topk(lexical.build(chunks), q, k))
    bounds = index._bounds(index.lists(["tie"]), [{"tie": 2.0}, {}])
    assert bounds.shape == (2, index.segments) and bounds[0].max() > 0 and not bounds[1].any()
