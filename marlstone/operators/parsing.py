"""From HTML filings to named sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.markup import html_text  # noqa: F401  part of this module's face
from marlstone.functions.text import WHITE

#: Section id and the pattern of its header, in canonical order.
HEADERS = [
    ("item_1", r"Item\s*1\.\s*Business"),
    ("item_1a", r"Item\s*1A\.\s*Risk\s*Factors"),
    ("item_1b", r"Item\s*1B\.\s*Unresolved\s*Staff\s*Comments"),
    ("item_1c", r"Item\s*1C\.\s*Cybersecurity"),
    ("item_2", r"Item\s*2\.\s*Properties"),
    ("item_3", r"Item\s*3\.\s*Legal\s*Proceedings"),
    ("item_7", r"Item\s*7\.\s*Management"),
    ("item_7a", r"Item\s*7A\.\s*Quantitative\s*and\s*Qualitative"),
    ("item_8", r"Item\s*8\.\s*Financial\s*Statements"),
]
MIN_CHARS = 500


class Headers:
    """Patterns of headers, matched in one pass: positions where any of them begins are found by their alternation, and each is
    tried there alone. Matches of one pattern don't overlap, those of different ones may."""

    def __init__(self, headers: list[tuple[str, str]]):
        plain = [p.replace(r"\s", f"[{WHITE}]") for _, p in headers]
        self.names = [sid for sid, _ in headers]
        self.each = [re.compile(p, re.I | re.A) for p in plain]
        self.any = re.compile("|".join(f"(?:{p})" for p in plain), re.I | re.A)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, which) of every match, by place; empty ones don't count."""
        out, free = [], [0] * len(self.each)
        m = self.any.search(text) if self.each else None
        while m:
            at = m.start()
            for k, pattern in enumerate(self.each):
                if at >= free[k] and (own := pattern.match(text, at)) and own.end() > at:
                    out.append((at, own.end(), k))
                    free[k] = own.end()
            m = self.any.search(text, at + 1)
        return out

    def sections(self, text: str, min_chars: int) -> list[tuple[int, str, str]]:
        """(which, header, body) of what parse() keeps of a text."""
        found = sorted((a, self.names[k], text[a:z], k) for a, z, k in self.matches(text))
        best: dict[str, tuple[int, str, str]] = {}
        for (at, sid, header, k), end in zip(found, [f[0] for f in found[1:]] + [len(text)]):
            body = text[at:end].strip()[len(header) :].strip()
            if len(body) >= min_chars and (sid not in best or len(body) > len(best[sid][2])):
                best[sid] = k, header, body
        return list(best.values())


def _by_text(docs: DataFrame, rows_of, out: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """One pass over docs (doc_key, text): rows_of(text) gives the other columns' values for each row."""
    docs = docs.select("doc_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows = [], []
            for i, text in enumerate(b.column(1)):
                made = rows_of(text.as_py() or "")
                place += [i] * len(made)
                rows += made
            cols = list(zip(*rows)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), *[pa.array(c, t) for c, (_, _, t) in zip(cols, out)]], names=["doc_key", *[n for n, _, _ in out]])

    return docs.mapInArrow(run, f"doc_key {docs.dtypes[0][1]}, " + ", ".join(f"{n} {t}" for n, t, _ in out))


def markers(docs: DataFrame, headers: list[tuple[str, str]] = HEADERS) -> DataFrame:
    """doc_key, sid, rank, pos (1-based), header: every match of every header pattern, each text read once."""
    known = Headers(headers)
    return _by_text(
        docs,
        lambda text: [(known.names[k], k, a + 1, text[a:z]) for a, z, k in known.matches(text)],
        [("sid", "string", pa.string()), ("rank", "int", pa.int32()), ("pos", "int", pa.int32()), ("header", "string", pa.string())],
    )


def parse(docs: DataFrame, headers: list[tuple[str, str]] = HEADERS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Sections (doc_key, section_id, rank, title, text, char_count) of docs (doc_key, text): a body runs from its header to
    the next header of any id; short ones go; of each id the longest stays, the first of equal ones. Each row of docs is a
    document, read once; nothing is shuffled."""
    known = Headers(headers)
    return _by_text(
        docs,
        lambda text: [(known.names[k], k, header, body, len(body)) for k, header, body in known.sections(text, min_chars)],
        [("section_id", "string", pa.string()), ("rank", "long", pa.int64()), ("title", "string", pa.string()), ("text", "string", pa.string()), ("char_count", "long", pa.int64())],
    )


def parse_rate(docs: DataFrame, sections: DataFrame, headers: list[tuple[str, str]] = HEADERS) -> DataFrame:
    """doc_key, found, missing (sorted, comma-joined), parse_rate for every document."""
    expected = F.array(*[F.lit(sid) for sid, _ in headers])
    have = sections.groupBy("doc_key").agg(F.collect_set("section_id").alias("have"))
    rows = docs.select("doc_key").join(have, "doc_key", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return rows.select(
        "doc_key",
        F.size("have").cast("long").alias("found"),
        F.array_join(F.array_sort(F.array_except(expected, "have")), ",").alias("missing"),
        (F.size("have") / len(headers)).alias("parse_rate"),
    )
