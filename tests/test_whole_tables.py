"""Queries take every row of their tables: brute force over documents of any length and language."""

import pytest

from marlstone.plans.registry import QUERIES


def line(k, n):
    return f"{k} " + "x" * (n - len(str(k)) - 1)


DOCS = [
    (1, "\n".join(line(k, 20 + 37 * k % 400) for k in range(80)), "en"),  # 15 000 characters
    (2, "\n".join(["a" * 700, "", "b" * 299, "c" * 300, "d", "e" * 5000]), None),
    (3, "short", "de"),
    (4, "", "fr"),
    (5, None, "en"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{out}/documents.parquet")
    return str(out)


def test_pack_greedy_takes_long_texts(spark, folder):
    want = set()
    for i, t, _ in DOCS:
        packed = []
        for x in [] if t is None else t.split("\n"):
            if packed and len("\n".join([*packed[-1], x])) <= 600:
                packed[-1].append(x)
            else:
                packed.append([x])
        want |= {(i, k, len(p), len("\n".join(p))) for k, p in enumerate(packed)}
    got = [tuple(r) for r in QUERIES["pack_greedy"](spark, folder).select("doc_id", "chunk", "n_lines", "n_chars").collect()]
    assert len(got) == len(want) and set(got) == want


FILINGS = [(i, f"head of the of {i} " + "body " * 40 + "and the rest " + "tail " * 30, lang) for i, lang in enumerate(["en", "de", "fr", None])]


def test_sections_of_every_language(spark, tmp_path):
    spark.createDataFrame(FILINGS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("section_markers", "parse_sections_longest", "parse_rate")}
    want = {(i, sid, t.index(h) + 1, h) for i, t, _ in FILINGS for sid, h in (("the", "the of"), ("and", "and the"))}
    assert {(r.doc_key, r.sid, r.pos, r.header) for r in found["section_markers"]} == want
    assert {(r.doc_key, r.section_id, r.char_count) for r in found["parse_sections_longest"]} == {(i, sid, n) for i, _, _ in FILINGS for sid, n in (("the", len(f"{i} " + "body " * 40) - 1), ("and", len("rest " + "tail " * 30) - 1))}
    assert {(r.doc_key, r.found, r.missing) for r in found["parse_rate"]} == {(i, 2, "in") for i, _, _ in FILINGS}
