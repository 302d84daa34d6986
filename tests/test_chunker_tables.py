"""Chunkers as table functions of SQL against the library's own."""

import random

import pytest

from marlstone.functions import tables
from marlstone.operators import chunking

random.seed(4)
TEXTS = ["", "  \n ", None, "one", "x" * 500, "a. b. c\n\n" * 60, *[" ".join(random.choice(["alpha", "Beta.", "γ", "\n\n", "delta\n", "!"]) for _ in range(n)) for n in (3, 40, 400)]]


@pytest.fixture
def sections(spark):
    tables.register(spark)
    return spark.createDataFrame([(f"k{i}", "s", t, 7) for i, t in enumerate(TEXTS)], "doc_key string, section_id string, text string, chunk_index int")


@pytest.mark.parametrize("call, own", [
    ("chunk_naive(s.text, 16, 4)", lambda s: chunking.naive(s, 16, 4)),
    ("chunk_naive(s.text, 2, 1)", lambda s: chunking.naive(s, 2, 1)),
    ("chunk_recursive(s.text, 50, 10)", lambda s: chunking.recursive(s, 50, 10)),
    ("chunk_semantic(s.text, 16, 4, 90)", lambda s: chunking.semantic(s, None, 16, 4, 90)),
])
def test_equal_to_the_library(spark, sections, call, own):
    got = spark.sql(f"SELECT s.doc_key, c.chunk_index, c.text FROM {{s}} s, LATERAL {call} c", s=sections)
    want = own(sections.drop("chunk_index")).select("doc_key", "chunk_index", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_slices_and_errors(spark, sections):
    got = spark.sql("SELECT s.doc_key, c.text FROM {s} s, LATERAL chunk_slices(s.text, 7, 2) c", s=sections).collect()
    assert sorted(map(tuple, got)) == sorted((f"k{i}", t[at : at + 7]) for i, t in enumerate(TEXTS) if t for at in range(0, len(t), 5))
    for bad in ("4, 4", "0, 0", "CAST(NULL AS INT), 1"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT c.* FROM {{s}} s, LATERAL chunk_naive(s.text, {bad}) c", s=sections).collect()
