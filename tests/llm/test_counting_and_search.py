"""Token counts, ranked search and clusters against the library, brute force and SQL."""

import hashlib
import math
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

from marlstone.llm import lloyd, ranking, tokencounts

DOC = "doc_id long, text string, block long, idx int, word string, pieces int, item int, score long, part int, n long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencounts.default_tokenizer())


def doc_frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, "w", 3, 4, 5, 6, 7) for i, t in rows], DOC).repartition(parts)


TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello hello HELLO, it's we'll They'RE 'S!",
    "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endof text|> x<|endoftext|>y",
    "a b c\x1cd\x85e\x0bf\x0cg",
    "J̌ K İ ΣΑΣ straße é ́x 가",
    "12345 a1b2 ٣٤ ½ 中文字 \U0001f600\U0001f468‍\U0001f469",
    "x" * 5000 + " " + "é" * 3000,
    "one_two--three...four's 'tis",
    "\u0000\u0001 � ",
]


def test_tokens_of_odd_texts(spark, library):
    rows = [(None if i == 3 else i, t) for i, t in enumerate([*TEXTS, TEXTS[3], TEXTS[3]])]
    got = tokencounts.token_counts(doc_frame(spark, rows), pairs=7).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > tokencounts.LIMIT) for r in got) and any(r.over_limit for r in got)
    assert tokencounts.token_counts(doc_frame(spark, rows).limit(0)).count() == 0


def test_tokens_of_all_characters(library):
    cutter = tokencounts.PreTokens(tokencounts.default_tokenizer())
    assert cutter.by_word
    known = {}
    for k in range(0, sys.maxunicode, 256):
        c = [chr(x) for x in range(k, k + 256) if not 0xD800 <= x < 0xE000]
        text = "".join(f"{x}aB{x}{x} " for x in c)
        found = cutter.frequencies(text)
        for w in found:
            if w is not None and w not in known:
                known[w] = cutter.pieces(w)
        assert sum(n * (1 if w is None else known[w]) for w, n in found.items()) == len(library.encode(text, add_special_tokens=False).ids), k


def test_tokens_of_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokencounts.query(spark, data).collect()} == want
    assert {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs.repartition(5), pairs=2000).collect()} == want


def test_tokens_by_another_kind_of_tokenizer(spark, data):
    """A tokenizer whose pre-tokens begin with a blank is cut by the library, text by text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, docs = Tokenizer.from_file(path), doc_frame(spark, list(enumerate(TEXTS)))
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs, path).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError):
        tokencounts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def brute_ranks(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("entries", [1, 40, 10**6])
def test_ranks_against_brute_force(spark, entries):
    r = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in range(60)] + ["É", "ü9", "A_b"]
    prose = lambda n: " ".join(words[min(int(x), 62)] for x in r.zipf(1.3, n) - 1)
    docs = [(int(i), prose(int(r.integers(1, 60)))) for i in range(150)]
    docs += [(None, docs[0][1]), (None, None), (7, ""), (8, " !?"), (200, prose(3000))] + [(300 + i, docs[3][1]) for i in range(40)] + [docs[5], docs[5]]
    items = [(i, prose(20)) for i in range(6)] + [(50, "w1"), (51, None), (52, "nothing"), (3, docs[3][1]), (None, "W2 w2 w3"), (60, "É ü9 É"), (61, "é")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, doc_id long")
    got = ranking.search(doc_frame(spark, docs, 4), asked, entries=entries, item_bytes=150 if entries == 40 else ranking.ITEM_BYTES)
    assert Counter(map(tuple, got.collect())) == brute_ranks(docs, items)
    if entries == 1:
        assert ranking.search(doc_frame(spark, docs).limit(0), asked).count() == 0
        assert ranking.search(doc_frame(spark, docs), asked.limit(0)).count() == 0


def test_reading_stops_at_the_threshold():
    """The last postings of long lists are never read once the threshold is below the k-th score."""
    n = 50_000
    ids, lens = list(range(n)), np.full(n, 2)
    terms = np.tile([0, 1], n)
    impact = np.repeat(np.arange(n, 0, -1), 2)
    lists, best = ranking.Lists(ids, lens, terms, impact, 2), []
    read = []
    scores = lists.scores
    lists.scores = lambda docs, weights: (read.append(len(docs)), scores(docs, weights))[1]
    lists.search(np.array([0, 1]), np.array([3, 5]), best, 10)
    assert sorted(-e[2] for e in best) == list(range(10)) and sum(read) <= 200


def brute_clusters(rows, k=lloyd.K, rounds=lloyd.ROUNDS):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, o)), j) for j, o in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(kept, of) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    of = Counter()
    for _, d, j in last:
        of[j] += d
    return Counter((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last)


VEC = "vec_id long, embedding array<float>, cluster int, distance long, v long, n long, s long"


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], VEC).repartition(3)


def test_clusters_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=64) * (1 if i % 3 else 0.01)]) for i in range(130)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (900, rows[9][1][:63]), (901, [None] + rows[9][1][1:]), (902, [float("nan")] * 64), (903, [float("inf")] * 64), (904, None), (905, [])]
    got = lloyd.cluster(vec_frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows)
    few = rows[:7] + [rows[2]] * 5
    assert Counter(map(tuple, lloyd.cluster(vec_frame(spark, few)).collect())) == brute_clusters(few)
    assert lloyd.cluster(vec_frame(spark, rows).limit(0)).count() == 0
    assert lloyd.cluster(vec_frame(spark, rows[-5:])).count() == 0


def test_large_integers_are_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=64) * 2.0**10]) for i in range(60)]
    rows += [(100 + i, [2.0**21 + i, *rows[i][1][1:]]) for i in range(9)]
    assert Counter(map(tuple, lloyd.cluster(vec_frame(spark, rows)).collect())) == brute_clusters(rows)
    with pytest.raises(Exception, match="too large"):
        lloyd.cluster(vec_frame(spark, [(1, [2.0**50] * 64)])).count()


@pytest.mark.parametrize("module,query", [(ranking, ranking.query), (lloyd, lloyd.query)])
def test_against_sql(spark, data, module, query):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(module.ORACLE).df()
    got = query(spark, data).toPandas()[list(want.columns)]
    assert len(got) > 0 and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
