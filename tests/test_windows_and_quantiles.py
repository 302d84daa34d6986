"""Windows over a vocabulary's ids, exact percentiles, weighted draws and question quotas."""

import random

import numpy as np
import pytest

from marlstone.functions.bpe import Vocabulary, _encoding
from marlstone.operators import chunking, quantiles

TEXTS = [("a", "one two three four five six seven"), ("b", "ñandú 中文字符 \U0001f469‍\U0001f680 " * 9), ("c", "  \n "), ("d", None), ("e", "x" * 3000 + " <|endoftext|> y")]


def brute(known, text, size, overlap):
    ids = known.encode_ordinary(text)
    out = []
    for start in range(0, len(ids), size - overlap):
        out.append(known.decode(ids[start : start + size]))
        if start + size >= len(ids):
            break
    return out


def test_id_windows(spark):
    v = Vocabulary.public()
    known = _encoding(v.ranks, v.pattern)
    rows = spark.createDataFrame([(k, "s", t) for k, t in TEXTS], "doc_key string, section_id string, text string")
    for size, overlap in ((7, 2), (5, 0), (1, 0), (4000, 10)):
        got = {}
        for r in chunking.naive(rows, size, overlap, vocabulary=v).orderBy("chunk_id").collect():
            got.setdefault(r.doc_key, []).append((r.chunk_index, r.text))
            text = dict(TEXTS)[r.doc_key].encode()
            assert text[r.start_byte : r.end_byte].decode(errors="replace") == r.text
        want = {k: list(enumerate(brute(known, t, size, overlap))) for k, t in TEXTS if t and t.strip()}
        assert {k: sorted(x) for k, x in got.items()} == want
    parents, children = chunking.parent_child(rows, 12, 3, 5, 1, vocabulary=v)
    inner = {}
    for r in children.collect():
        inner.setdefault(r.parent_id, {})[r.child_index] = r.text
    for r in parents.collect():
        assert [inner[r.chunk_id][i] for i in range(len(inner[r.chunk_id]))] == brute(known, r.text, 5, 1)
    with pytest.raises(ValueError):
        chunking.naive(rows, 5, 5, vocabulary=v)


def test_semantic_chunks_by_ids(spark):
    v = Vocabulary.public()
    text = "Short one. " + "unbrokenlongword" * 40 + ". The end is near. So it goes."
    rows = spark.createDataFrame([("k", "s", text)], "doc_key string, section_id string, text string")
    got = [r.text for r in chunking.semantic(rows, None, 20, 4, vocabulary=v).orderBy("chunk_index").collect()]
    long = "unbrokenlongword" * 40 + "."
    assert [w for w, _, _ in v.windows(long, 20, 4)] == [c for c in got if c in long and "unbroken" in c or c in long and len(c) > 20][: len(v.windows(long, 20, 4))]
    assert all(v.count(c) <= 21 for c in got)
    assert len(v.windows(" " * 1_200_000 + "a", 1000, 0)) > 0  # too much for the matcher


def test_percentiles_are_exact(spark):
    r = random.Random(2)
    groups = {
        "even": [r.random() for _ in range(300)],
        "heavy": [r.paretovariate(0.3) for _ in range(300)],
        "ties": [float(r.randrange(3)) for _ in range(300)],
        "one": [7.5] * 200,
        "signs": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(200)],
        "ends": [float("-inf")] * 10 + [r.gauss(0, 1) for _ in range(200)] + [float("inf")] * 10,
        "few": [3.0, 1.0, 2.0],
        None: [r.gauss(5, 2) for _ in range(150)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("heavy", float("nan")), ("void", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    ps = [0.0, 0.5, 0.95, 1.0]
    for small, bins in ((40, 64), (10_000, 1024)):
        got = {x.g: x.p for x in quantiles.percentiles(df, "x", ps, ["g"], small, bins).collect()}
        assert set(got) == {*groups, "void"} and got["void"] == [None] * 4
        for g, xs in groups.items():
            xs = sorted(xs)
            for p, x in zip(ps, got[g]):
                at = p * (len(xs) - 1)
                a, b = xs[int(np.floor(at))], xs[int(np.ceil(at))]
                assert x == pytest.approx(a if a == b else a + (b - a) * (at - np.floor(at)), rel=1e-12, abs=1e-12), (g, p)
    assert quantiles.percentiles(df.limit(0), "x", ps, ["g"]).count() == 0
    whole = quantiles.percentiles(df.filter("g = 'even'"), "x", [0.5], [], 50, 64).first().p[0]
    assert whole == pytest.approx(np.median(groups["even"]))
