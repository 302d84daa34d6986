"""Each registered query's columns and types, and very long texts through every operator."""

import pytest

import corpus_pipeline
from marlstone.llm import decontamination, langid, licences, packing, secrets, sharding, simhash, substrings
from marlstone.llm.registry import QUERIES

CONTRACTS = {
    "op1_": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "is_secret": "boolean", "score": "double"},
    "op4_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_": {"doc_id": "bigint", "digest": "string", "licence": "string"},
    "op6_": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_": {"query_id": "bigint", "rank": "bigint", "vec_id": "bigint", "distance": "bigint"},
    "op10_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op13_": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
}
ROWS = {"op2_": "documents", "op4_": "documents", "op5_": "documents", "op6_": "pages", "op7_": "documents", "op8_": "documents", "op10_": "documents", "op12_": "documents", "op13_": "embeddings"}


def test_every_operator_is_registered():
    assert len(QUERIES) == 13 and all(sum(n.startswith(p) for n in QUERIES) == 1 for p in CONTRACTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, data, name):
    prefix = name[: name.index("_") + 1]
    out = QUERIES[name](spark, data)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACTS[prefix]} == CONTRACTS[prefix]
    rows = out.count()
    assert rows > 0
    if prefix in ROWS:
        assert rows == spark.read.parquet(f"{data}/{ROWS[prefix]}.parquet").count()


def test_pipeline_s_rows(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {c: dict(out.dtypes)[c] for c in CONTRACTS["op1_"]} == CONTRACTS["op1_"] and out.count() > 0


LONG = " ".join(f"word{i * i % 9973} and{i % 31}" for i in range(90_000))
DOCS = [(1, LONG), (2, LONG), (3, "a short one"), (4, "x" * 2_000_000), (5, "ab " * 400_000), (6, None), (7, "\n" * 300_000), (8, "key=" + "q" * 500_000 + "1")]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "en" if i < 5 else "de", "s", len(t or "")) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_very_long_texts(spark, long):
    n = len(DOCS)
    raw = {i: (t or "").encode() for i, t in DOCS}
    gone = {r.doc_id: r for r in substrings.remove_repeats(long).collect()}
    assert {i: r.n_bytes for i, r in gone.items()} == {i: len(b) for i, b in raw.items()}
    assert gone[2].n_removed == len(raw[2]) and gone[1].n_removed == 0 and gone[4].n_removed == 0
    assert {r.doc_id: r.component_id for r in simhash.clusters(simhash.fingerprints(long)).collect()}[2] == 1
    kept = {r.doc_id for r in simhash.deduplicated(long).collect()}
    assert 1 in kept and 2 not in kept and 4 in kept
    assert licences.scan(long).count() == n
    item = spark.createDataFrame([(1, LONG[5000:5200])], "item_id long, text string")
    assert {r.doc_id for r in decontamination.decontaminate(long, item).filter("contaminated").collect()} == {1, 2}
    found = secrets.scan(long).collect()
    assert {(r.doc_id, len(r.cand)) for r in found if r.doc_id == 8} <= {(8, 500_001), (8, 500_005)} and any(r.doc_id == 8 for r in found)
    assert secrets.redact(long).count() == n
    assert {r.doc_id: r.size for r in sharding.shard(long, 2, 16).collect()} == {i: len(b) + 8 for i, b in raw.items()}
    model = langid.train(long)
    assert {r.doc_id: r.lang_pred for r in langid.identify(long, model).collect()}[7] == "und"
    per = {}
    for r in packing.pack(long).collect():
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert set(per) == set(raw)
