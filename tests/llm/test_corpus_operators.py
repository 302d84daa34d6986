"""Brute force, round trips, and edge cases of every corpus operator."""

import hashlib
import os
import re
import struct
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import common, decontamination, graph, htmltext, langid, licences, packing, secrets, sharding, simhash, substrings, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 long, fp long, row long, block long, size long, shard int, score double, token string, licence string, digest string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{r.integers(50)}" for i in r.integers(0, len(WORDS), n))


def frame(spark, rows):
    """rows: (doc_id, text). The other columns clash with names that the operators use."""
    full = [(i, t, "en", "s", 1, "x", 2, 3, 4, 5, 6, 7, 0.5, "t", "l", "d") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def edge_rows():
    base = prose(1, 120)
    return [
        (1, base),
        (2, None),
        (3, ""),
        (4, base),
        (5, base.replace("alpha", "Alpha") + " tail"),
        (None, base),
        (None, None),
        (6, "one"),
        (6, "one"),
        (7, "Ünï cødé " * 9),
        (8, " \n\t "),
        (9, base[:300] + prose(2, 3000) + base[100:400]),
        (9, "another text under an id that is taken " + base[:200]),
    ]


@pytest.fixture(scope="module")
def edge(spark, edge_rows):
    return frame(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, edge):
    return edge.limit(0)


def tables(spark, tmp, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{tmp}/{name}.parquet")
    return str(tmp)


# ---- packing


def pieces_hold(got, docs, window=2048):
    at = {}
    for r in got.collect():
        at.setdefault(r.sequence_id, []).append(r)
    for rows in at.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= window
    e = packing.Encoder(*packing.default_tokenizer())
    want = sorted((str(i), n := len(ids := e.whole(t or "") + struct.pack("<I", 1)) // 4, zlib.crc32(ids) if n <= 1 else 0) for i, t in docs)
    per = {}
    for rows in at.values():
        for r in rows:
            per.setdefault((r.doc_id, r.doc_tokens), 0)
            per[r.doc_id, r.doc_tokens] += r.length
    have = {}
    for i, n, _ in want:
        have[i, n] = have.get((i, n), 0) + n
    assert {(str(i), n): v for (i, n), v in per.items()} == have


def test_packing(spark, edge, edge_rows, empty):
    got = packing.pack(edge, n_open=2, window=256, group=1)
    pieces_hold(got, edge_rows, 256)
    assert packing.pack(empty).count() == 0


def test_packing_ids(spark):
    docs = [(i, prose(i, 40 + 37 * i)) for i in range(40)]
    e = packing.Encoder(*packing.default_tokenizer())
    ids = {i: e.whole(t) + struct.pack("<I", 1) for i, t in docs}
    rows = packing.pack(frame(spark, docs).repartition(3)).collect()
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    tokens = sum(len(v) // 4 for v in ids.values())
    assert sum(r.length for r in rows) == tokens
    assert 1 - tokens / 2048 / len({r.sequence_id for r in rows}) < 0.05


def test_fast_and_slow_ids_agree():
    e = packing.Encoder(*packing.default_tokenizer())
    for t in ("", "a  b", "x\n\n y\t z  ", "don't  we'll", " nb", "l'été 12 34.5", "\x1c a", "é 日本語 🙂", "<|endoftext|> hi"):
        assert e.encode(t) == e.whole(t)


# ---- repeated substrings


def removed(docs, depth=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            if i is not None:
                first.setdefault(b[p : p + depth], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            f = first.get(b[p : p + depth])
            if f is not None and (i is None or f < i):
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block,hot,fan", [(1 << 20, 4096, 1024), (1500, 4096, 1024), (1500, 1, 1024), (700, 4096, 4), (700, 2, 2)])
def test_substrings(spark, edge, edge_rows, block, hot, fan):
    got = [repr(tuple(r)) for r in substrings.remove_repeats(edge, block, hot, fan).collect()]
    assert sorted(got) == removed(edge_rows)


@pytest.mark.parametrize("fan", [1024, 4, 2])
def test_substrings_of_many_blocks(spark, fan):
    """Passages that all, some or two documents share, periodic texts, small alphabets, zero bytes."""
    r = np.random.default_rng(6)
    passage, docs = prose(20, 30), []
    for i in range(90):
        parts = [prose(500 + i, int(r.integers(1, 60)))]
        if i % 2:
            parts.append(passage[int(r.integers(0, 40)) :])
        if i % 5 == 0:
            parts.append("ab" * int(r.integers(10, 80)) + "\0" * int(r.integers(0, 120)))
        if i % 7 == 0:
            parts.append("".join("xy"[k] for k in r.integers(0, 2, 400)))
        if i % 3 == 0:
            parts.append(docs[int(r.integers(len(docs)))][1][-200:] if docs else "")
        docs.append((int(r.integers(0, 80)), " ".join(parts)))
    got = [repr(tuple(x)) for x in substrings.remove_repeats(frame(spark, docs).repartition(5), 900, 8, fan).collect()]
    assert sorted(got) == removed(docs)


def test_corpus_order():
    """Windows in order of their 50 bytes, equal ones in one run, from the dictionary's and the parse's suffix arrays."""
    r = np.random.default_rng(3)
    raw = np.frombuffer("".join("ab c"[k] for k in r.integers(0, 4, 300)).encode() + bytes(120) + b"ab" * 60 + bytes(r.integers(0, 3, 400).astype(np.uint8)), np.uint8)
    raw = np.concatenate((raw, raw[100:500], raw[300:700]))
    h, ap, lo, n = substrings.phrases(raw, np.array([len(raw)]))
    order = np.argsort(h, kind="stable")
    _, group = np.unique(h[order], return_inverse=True)
    owner, inside, run = substrings.corpus_order(group, raw, lo[order], (ap - lo)[order], n[order])
    windows = [(int(group[k]), bytes(raw[lo[order[k]] + i : lo[order[k]] + i + 50])) for k, i in zip(owner, inside)]
    assert len(windows) == len(raw) - 49 == int(n.sum())
    for k in range(1, len(windows)):
        assert (windows[k] == windows[k - 1]) == (run[k] == run[k - 1])
    assert len({w for _, w in windows}) == run[-1] + 1


def test_substrings_borders(spark, empty):
    a = prose(3, 60)
    docs = [(1, a), (2, a[100:149]), (3, a[100:150]), (4, "é" * 24 + "ab"), (5, "x" + "é" * 24 + "ab"), (6, "y" * 500), (7, "z" + "y" * 51), (0, "y" * 50)]
    got = [repr(tuple(r)) for r in substrings.remove_repeats(frame(spark, docs), 400).collect()]
    assert sorted(got) == removed(docs)
    assert substrings.remove_repeats(empty).count() == 0


# ---- SimHash


def fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near(codes, radius):
    root = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_fingerprints(spark, edge, edge_rows, empty):
    got = sorted(repr((r.doc_id, r.fp & (1 << 64) - 1)) for r in simhash.fingerprints(edge).collect())
    assert got == sorted(repr((i, fingerprint(t))) for i, t in edge_rows)
    assert simhash.clusters(simhash.fingerprints(empty)).count() == 0
    rows = {(r.doc_id, r.component_id) for r in simhash.clusters(simhash.fingerprints(edge)).collect()}
    assert {(1, 1), (4, 1), (None, None), (2, 2), (3, 2), (8, 2)} <= rows


@pytest.mark.parametrize("hot", [2048, 2])
def test_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (hot,))
    r = np.random.default_rng(5)
    codes = [int(x) for x in r.integers(0, 1 << 63, 20)]
    for _ in range(160):
        c = codes[r.integers(len(codes))]
        for b in r.choice(64, r.integers(1, 4), replace=False):
            c ^= 1 << int(b)
        codes.append(c)
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    got = {x.doc_id: x.component_id for x in simhash.clusters(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == dict(enumerate(near(codes, 2)))


def test_bit_sliced_counters():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 62, (150, 3)).astype(np.uint64)
    codes[1::2] = codes[::2] ^ (np.uint64(1) << r.integers(0, 60, (75, 3)).astype(np.uint64))
    for radius in (0, 2, 3, 80, 95):
        got = simhash.linked(codes, np.zeros(150, int), radius)
        whole = [int.from_bytes(c.tobytes(), "little") for c in codes]
        assert list(got) == near(whole, radius)


def test_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, edge, empty):
    docs, base = [], {}
    for k in range(40):
        words = prose(100 + k, 300).split()
        base[k] = words
        docs.append((10 * k, " ".join(words)))
        for j in range(1, 3):
            w = list(words)
            w[50 * j] = "changed"
            docs.append((10 * k + j, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: i - i % 10 for i, _ in docs}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, docs), chunk=2).collect()} == got
    kept = simhash.deduplicated(edge)
    assert kept.columns == edge.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "7", "9", "9"]
    assert simhash.deduplicated(empty).count() == 0
    a, b = prose(7, 80), prose(8, 80)
    few = frame(spark, [(1, a), (5, a), (5, b), (7, b), (None, b), (None, "alone " + a[:90]), (None, "alone " + a[:90])])
    assert sorted(repr((r.doc_id, r.text)) for r in simhash.deduplicated(few).collect()) == sorted(map(repr, [(1, a), (5, b), (None, "alone " + a[:90])]))


@pytest.mark.parametrize("chunk", [2, 6, 2048])
def test_frequent_keys_lose_no_link(spark, chunk):
    """Families with the same words at the start (so that keys are frequent), of 8 to 28 words: all that are 0.8 alike meet."""
    r, docs = np.random.default_rng(4), []
    for k in range(24):
        words = ["same", "first", "words", "in", "all", "texts"] + [f"f{k}_{i}" for i in range(r.integers(2, 22))]
        for j in range(r.integers(1, 9)):
            docs.append((len(docs), " ".join(words[: len(words) - int(r.integers(0, 3))] + [f"end{j}"] * int(r.integers(0, 2)))))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in docs)]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame(spark, docs), chunk=chunk).collect()}
    assert got == dict(enumerate(root))


# ---- decontamination


def hit_words(docs, items, window=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for item, x in items:
            v = words(x)
            for p in range(max(1, len(v) - window + 1) if v else 0):
                part = v[p : p + window]
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit |= set(range(s, s + len(part)))
                        met.add(str(item))
        out.append((i, len(w), len(hit), len(met), sorted(met), bool(hit)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_decontamination(spark, edge, edge_rows, empty, limit):
    base = edge_rows[0][1]
    items = [(1, base[40:260]), (2, "one"), (3, None), (4, " !! "), (5, "Tail"), (6, "ünï CØDÉ ünï"), (7, base[40:260]), (8, "not there at all ever and ever again so it is no hit")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(edge, bench, broadcast_rows=limit)
    rows = sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in got.collect())
    assert rows == hit_words(edge_rows, items)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(edge, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("window", [3, 7, 13, 20])
def test_windows_of_other_sizes(spark, window):
    item = [f"w{k:02d}" for k in range(20)]
    docs = [(1, " ".join(item)), (2, " ".join([*item[:9], "other", *item[10:]])), (3, " ".join(item[5:15])), (4, " ".join(item[3:] + item)), (5, " ".join(item[:2]))]
    items = [(1, " ".join(item)), (2, " ".join(item[4:9])), (3, "w19")]
    got = decontamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window)
    rows = sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in got.collect())
    assert rows == hit_words(docs, items, window)


# ---- sharding


def test_sharding(spark, edge, edge_rows, empty):
    docs = frame(spark, [(i, "x" * (i * 37 % 900)) for i in range(3000)])
    rows = sharding.shard(docs).collect()
    sums, places = {}, {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(sums) == set(range(24)) and max(sums.values()) - min(sums.values()) <= 0.001 * max(sums.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    got = sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in sharding.shard(edge, 3, 16).collect())
    assert got == sorted(repr((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in edge_rows)
    assert sharding.shard(empty).count() == 0
    # one id, or one text without an id, in a third of all rows
    hot = [(7 if i % 3 == 0 else i, "t" * (i % 500)) for i in range(3000)] + [(None, "same text")] * 900
    rows = sharding.shard(frame(spark, hot)).collect()
    sums, places = {}, {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(sums.values()) - min(sums.values()) <= 0.02 * max(sums.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_stored_map_is_edited(spark):
    docs = frame(spark, [(i, "x" * (i * 37 % 900)) for i in range(2000)])
    path = sharding.store(spark, [])
    first = {r.doc_id: r.shard for r in sharding.shard(docs, 8, 512, path=path).collect()}
    old = sharding.load(spark, path)
    more = docs.unionByName(frame(spark, [(i, "y" * 400) for i in range(2000, 2200)]))
    second = {r.doc_id: r.shard for r in sharding.shard(more, 8, 512, path=path).collect()}
    new = sharding.load(spark, path)
    assert new.version == old.version + 1
    moved = {s for s in range(512) if new.shards[s] != old.shards[s]}
    assert 0 < len(moved) < 256 and all(first[i] == second[i] for i in first if {r.vslot for r in sharding.slotted(docs.filter(f"doc_id = {i}"), n_slots=512).collect()}.isdisjoint(moved) and i < 20)


def test_slot_maps(spark):
    m = sharding.SlotMap.even(64, 4)
    g = m.grown()
    assert g.version == 1 and all(b == 4 or b == a for a, b in zip(m.shards, g.shards)) and g.shards.count(4) == 64 // 5
    r = m.rebalanced({s: s * s for s in range(64)})
    load = [sum(s * s for s in range(64) if r.shards[s] == k) for k in range(4)]
    assert max(load) - min(load) <= 4 and set(r.moved) == {s for s in range(64) if r.shards[s] != m.shards[s]}
    path = sharding.store(spark, [m])
    assert sharding.load(spark, path) == m
    sharding.store(spark, [r], path)
    again = sharding.load(spark, path)
    assert (again.version, again.shards, again.n_shards) == (1, r.shards, 4) and sharding.load(spark, path, 0).shards == m.shards
    with pytest.raises(ValueError):
        sharding.SlotMap.even(2, 3)


# ---- top-k


def test_topk(spark):
    r = np.random.default_rng(3)
    for dims, n in ((64, 400), (16, 300), (100, 150)):
        x = r.normal(size=(n, dims))
        x[n // 2 :] = np.where(r.random((n - n // 2, dims)) < 0.1, -1, 1) * x[: n - n // 2]
        x[:25] = x[0]
        bits = x > 0
        df = spark.createDataFrame([(i, [float(v) for v in row], "x") for i, row in enumerate(x)], "vec_id long, embedding array<float>, id string")
        got = {}
        for row in topk.search(df, df.filter("vec_id % 50 = 0"), dims, 7).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append((row.distance, row.id))
        for q in range(0, n, 50):
            want = sorted((int((bits[q] != bits[j]).sum()), j) for j in range(n) if j != q)[:7]
            assert got[q] == want
    odd = spark.createDataFrame([(0, [1.0, float("nan")]), (1, None), (None, [1.0, 1.0]), (2, [1.0, None]), (2, [1.0, None])], "vec_id long, embedding array<float>")
    rows = topk.search(odd, odd, 2, 5).collect()
    assert {(x.query_id, x.id, x.distance) for x in rows} == {(0, 2, 0), (2, 0, 0)}
    assert topk.search(odd.limit(0), odd.limit(0), 2, 5).count() == 0


# ---- licences


def test_licences(spark, edge, empty):
    mit = dict(reversed(licences.TEXTS))["MIT"]
    body = next(t for k, t in licences.TEXTS if t.startswith("Permission is hereby granted") and "above copyright" in t)
    docs = frame(
        spark,
        [
            (1, "Copyright (c) 2019 Someone\n\n" + body.replace("Software", "SOFTWARE").replace(", ", " ,\n")),
            (2, body.replace("sublicense", "sublicence")),
            (3, body + " and more"),
            (4, "words\n  RELEASED under the MIT Licence!!\nother"),
            (5, None),
        ],
    )
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[1].licence == got[2].licence == "MIT" and got[3].licence is None
    assert got[4].licence is None and got[4].notices == ["MIT"] and got[4].n_notices == 1
    assert got[5].digest == hashlib.sha256(b"").hexdigest() and mit
    assert licences.scan(edge).count() == edge.count() and licences.scan(empty).count() == 0


# ---- secrets


def test_secrets(spark, edge, empty):
    model, pairs = secrets.train(secrets.labelled(spark))
    held = secrets.judged(secrets.labelled(spark, secrets.N_LABELLED + 1500).filter(f"id >= {secrets.N_LABELLED}"), model, pairs)
    assert held.filter(F.col("is_secret") == (F.col("label") > 0)).count() / held.count() > 0.97
    key = hashlib.sha1(b"x").hexdigest()
    docs = frame(spark, [(1, f'é token = "{key}" and commit {key[::-1]} here'), (2, f'token = "{key}"'), (2, f'token = "{key}"'), (3, 'password: "your_password_here1" x'), (4, None), (5, "")])
    got = secrets.scan(docs).collect()
    assert {(r.doc_id, r.start, r.cand, r.is_secret) for r in got} == {(1, 11, key, True), (1, 64, key[::-1], False), (2, 9, key, True), (3, 11, "your_password_here1", False)}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] == f'é token = "{secrets.MASK}" and commit {key[::-1]} here' and texts[2] == f'token = "{secrets.MASK}"'
    assert texts[4] is None and texts[3].count("your_password_here1") == 1
    assert secrets.redact(empty).count() == 0 and secrets.redact(edge).count() == edge.count()


# ---- language


def test_language(spark, data, edge, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id")))
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95
    assert got.filter("score < 0 or score > 1").count() == 0
    model = langid.train(edge)
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(edge, model).collect()}
    assert {(2, "und"), (3, "und"), (8, "und")} <= rows
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(edge, none).collect()} == {"und"}
    assert langid.identify(empty, none).count() == 0
    kept = langid.keep_identified(edge, model, 0.5)
    assert kept.columns == edge.columns and kept.filter("text is null").count() == 0


def test_tree_sums(spark):
    rows = [(k, k, np.arange(5, dtype="<i8").tobytes()) for k in range(70)]
    got = langid.tree_sums(spark.createDataFrame(rows, "part long, n long, val binary"), 4).collect()
    assert len(got) <= 4 and sum(r.n for r in got) == sum(range(70))
    assert sum(np.frombuffer(bytes(r.val), "<i8") for r in got).tolist() == [0, 70, 140, 210, 280]


def plain_grams(text):
    """Counts of hashed 1- to 3-grams, gram by gram, in whole numbers of 32 bits."""
    codes, out, low = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()], {}, (1 << 32) - 1
    for n in (1, 2, 3):
        for at in range(len(codes) - n + 1):
            gram = codes[at : at + n]
            if all(c == 32 for c in gram):
                continue
            h = n * 0x27D4EB2F & low
            for c, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = h + c * m & low
            h = (h ^ h >> 15) * 0x2C1B3C6D & low
            h = (h ^ h >> 12) * 0x297A2D39 & low
            out[h >> 32 - langid.BITS] = out.get(h >> 32 - langid.BITS, 0) + 1
    return out


def plain_ftrl(rows, langs, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    z, n = {}, {}

    def weight(k):
        zi = z.get(k, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((beta + n.get(k, 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x = {**rows[r][0], "bias": 1.0}
            w = {(i, c): weight((i, c)) for i in x for c in range(langs)}
            e = [np.exp(sum(v * w[i, c] for i, v in x.items())) for c in range(langs)]
            for i, v in x.items():
                for c in range(langs):
                    g = v * (e[c] / sum(e) - (c == rows[r][1]))
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[i, c]
                    n[i, c] = old + g * g
    return {k: weight(k) for k in z}


def test_grams_and_training_by_hand():
    texts = ["Ünder the ol' 3 trees!", "les arbres d'été", "die Bäume, alt", "x", "trees and trees", "l'été des arbres"]
    for t in [*texts, "", " ,. "]:
        idx, n = langid.counts_of(t)
        assert dict(zip(idx.tolist(), n.tolist())) == plain_grams(t)
    rows = [({k: v / 10 for k, v in plain_grams(t).items()}, y) for t, y in zip(texts, (0, 1, 2, 0, 0, 1))]
    want = plain_ftrl(rows, 3)
    got = langid.ftrl([(np.array(sorted(x)), np.array([x[k] for k in sorted(x)]), y) for x, y in rows], 3)
    for (i, c), w in want.items():
        assert abs(got[-1 if i == "bias" else i, c] - w) < 1e-9
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values())


def test_segments_don_t_change_features(monkeypatch):
    t = prose(9, 400)
    whole = langid.counts_of(t)
    monkeypatch.setattr(langid, "SEGMENT", 37)
    parts = langid.counts_of(t)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    m = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=((1 << langid.BITS) + 1, 2)).astype(np.float32), np.zeros(2))
    m.weights[-1] = 0
    texts = [t, "", "ab", None, "x"]
    few, n = m.logits(texts)
    monkeypatch.setattr(langid, "SEGMENT", 1 << 19)
    many, k = m.logits(texts)
    assert np.allclose(few, many, atol=1e-5) and (n == k).all()


# ---- pages


def test_blocks():
    page = "<!DOCTYPE html><head><title>T</title></head><body><!-- <p>no --><script>var a='</p>'</script><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One<b>two</b>\n three<br>four<p>five<div class='ad x'>buy</div></article><p>tail"
    got = [(t, p[-1] if p else "") for t, p, _ in htmltext.blocks(page)]
    assert [t for t, _ in got] == ["Menu", "A & B", "Onetwo three four", "five", "buy", "tail"]
    assert any("c.ad" in p for t, p, _ in htmltext.blocks(page) if t == "buy")
    for odd in ("", "<", "a < b", "<p", "<p class='x", "<!--", "<script>x", "</p></p>", "<p/>x", "&amp", "<textarea><p>x</textarea>y"):
        htmltext.blocks(odd)
    assert [t for t, *_ in htmltext.blocks("a < b <p")] == ["a < b"]


def test_gradients():
    maker = htmltext.PageMaker(3)
    page, y = next((p, y) for p, y in iter(maker.labelled, None) if 2 < len(p) < 12)
    net, f = htmltext.Labeller(1), htmltext.features(page)
    held = {}

    def loss():
        *_, z = net.forward([f])
        p = 1 / (1 + np.exp(-z[:, 0]))
        return -np.mean(np.where(y, np.log(p), np.log(1 - p)))

    before = {k: v.copy() for k, v in net.w.items()}
    net.step([f], [y], held, 0.0)
    for name in ("xf", "hb", "out", "path"):
        g = held[name][0] / 0.1
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.w = {k: v.copy() for k, v in before.items()}
        net.w[name][at] += 1e-5
        up = loss()
        net.w[name][at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3)


def test_extraction(spark):
    net = htmltext.trained()
    maker = htmltext.PageMaker(77)
    made = [m for m in (maker.labelled() for _ in range(150)) if m[0]]
    right = [(a == y).mean() for a, (_, y) in zip(net.keep([htmltext.features(p) for p, _ in made]), made)]
    assert np.mean(right) > 0.95
    html = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>Title</h1><p>It is a long day &lt;today&gt; in the\n town.</p></article><section class='comments'><p>Nice post</p></section><footer>&copy; me</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", html, "x"), (None, None, None, "x"), (2, "v", "", "x"), (1, "u", html, "x")], "page_id long, url string, html string, text string")
    got = htmltext.extract(rows, net).collect()
    assert len(got) == 4
    for r in got:
        want = "Title It is a long day <today> in the town." if r.page_id == 1 else ""
        assert (r.text, r.n_chars) == (want, len(want))
    assert htmltext.extract(rows.limit(0), net).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


FOLDER = "/usr/share/common-licenses"
INSTALLED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no installed licence texts")
def test_whole_licences_by_digest(spark):
    texts = {k: open(f"{FOLDER}/{f}", encoding="utf-8").read() for f, k in INSTALLED.items()}
    assert set(licences.digests_of(spark, list(texts.items()))) <= set(licences.DIGESTS)
    docs, want = [], []
    for k, t in texts.items():
        wrapped = "\n\n".join(p if "Copyright" in p else textwrap.fill(" ".join(p.split()), 60) for p in t.split("\n\n"))
        head = t.partition(licences.END)[0]
        for one in (t, "Copyright (c) 2024 Someone\n\n" + wrapped.upper(), re.sub(r"\bLicense\b", "Licence", t), head):
            docs.append((len(docs), one))
            want.append(k)
    docs.append((len(docs), texts["GPL-3.0"].replace("freedom", "liberty")))
    got = {r.doc_id: r.licence for r in licences.scan(frame(spark, docs)).collect()}
    assert [got[i] for i in range(len(want))] == want and got[len(want)] is None
