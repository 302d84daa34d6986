"""The pipeline's stages, each against a brute-force version on its own input."""

import re
import zlib

import pytest

import corpus_pipeline
from marlstone.llm import packing, secrets


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data).cache()
        after.count()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "secrets", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns


def test_language_keeps_all_that_can_be_read(stages):
    before, after = stages["language"]
    gone = ids(before) - ids(after)
    assert len(gone) <= 0.01 * before.count()


def test_near_duplicates(stages):
    """Documents are linked from a similarity of 0.8 on, and of what links hold together just the smallest id stays."""
    before, after = stages["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                top[high] = low
    assert ids(after) == {i for i in sets if root(i) == i} != set(sets)


def test_benchmark(spark, data, stages):
    before, after = stages["benchmark"]
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    assert ids(after) == {r.doc_id for r in before.collect() if not hit(r.text)}


def test_secrets(stages):
    before, after = stages["secrets"]
    was = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        want = re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', rf"\g<1>{secrets.MASK}\g<2>", was[r.doc_id])
        assert r.text == want and r.n_chars == len(want)
    assert ids(after) == set(was)


def test_packing(stages):
    before, after = stages["packing"]
    e, per = packing.Encoder(*packing.default_tokenizer()), {}
    ids_ = {r.doc_id: e.whole(r.text or "") + b"\1\0\0\0" for r in before.collect()}
    for r in after.collect():
        assert zlib.crc32(ids_[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert per == {i: len(v) // 4 for i, v in ids_.items()}


def test_empty(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
