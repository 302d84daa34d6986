"""A line that many documents have brings them together under a key; large groups of near copies part below the bound."""

import numpy as np
import pytest

from marlstone.llm import simhash


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute_force(docs, similarity=0.8):
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return {i: docs[k][0] for (i, _), k in zip(docs, root)}


def lined(n, copied, seed=1):
    """Texts of several sizes, each with one or more of three common lines; some again with a word less."""
    r, docs = np.random.default_rng(seed), []
    lines = [" ".join(f"line{k}_{i}" for i in range(12)) for k in range(3)]
    for k in range(n):
        words = [f"w{k}_{i}" for i in range(int(r.integers(8, 70)))]
        held = " ".join(lines[: int(r.integers(1, 4))])
        docs.append((len(docs), held + " " + " ".join(words)))
        if k < copied:
            docs.append((len(docs), held + " " + " ".join(words[:-1])))
    return docs


def test_texts_with_a_common_line_are_not_compared_with_all(spark, monkeypatch):
    docs, tables, old = lined(500, 60), [], simhash.written

    def seen(df, name):
        out = old(df, name)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash, "written", seen)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunk=40).collect()}
    assert got == brute_force(docs)
    assert sum(i != c for i, c in got.items()) >= 50
    # nodes that all others of their key would have to be compared with
    assert sum(n for name, n in tables if name == "rest") < len(docs) / 4


def test_texts_read_again(spark, monkeypatch):
    """Texts of which too few rare shingles are kept are read again, and meet by the same order."""
    docs, calls, old = lined(240, 60, 2), [], simhash.by_rarity
    monkeypatch.setattr(simhash, "KEPT", 1)
    monkeypatch.setattr(simhash, "by_rarity", lambda *a: calls.append(a[-1]) or old(*a))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunk=16).collect()}
    assert got == brute_force(docs)
    assert len(calls) == 1 and len(calls[0])


@pytest.mark.parametrize("n", [3, 40, 150])
def test_near_copies_are_compared_at_once(monkeypatch, n):
    r, calls, old = np.random.default_rng(3), [], simhash.alike
    base = [f"w{i}" for i in range(200)]
    docs = []
    for k in range(n):
        words = list(base)
        for e, at in enumerate(r.integers(0, 200, int(r.integers(0, 16)))):
            words[at] = f"x{k}_{e}"
        docs.append((k, " ".join(words)))
    sets = [simhash.set_hashes(t, 5) for _, t in docs]
    both = simhash.shared(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for j in range(n) for i in range(j))
    monkeypatch.setattr(simhash, "alike", lambda *a: calls.append(1) or old(*a))
    root = simhash.verified(sets, 0.8)
    assert dict(enumerate(root.tolist())) == brute_force(docs)
    assert len(calls) <= n
