"""Chunkers as table functions of SQL.

    tables.register(spark)
    SELECT s.doc_key, c.chunk_index, c.text FROM sections s, LATERAL chunk_recursive(s.text, 2000, 200) c

Rows of a lateral join stay where they are, and chunks go back in Arrow batches. A null or blank text has no chunks; a null size
or overlap, or one that is no window, is an error. A chunk's index counts from 0. Spark (4.1) has no outer rows for table functions of
Python: texts without chunks go in a LEFT JOIN LATERAL too."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from marlstone.operators import chunking

ROW = "chunk_index int, text string"


def _blank(text: str | None) -> bool:
    return text is None or not text.strip()


@udtf(returnType=ROW, useArrow=True)
class ChunkNaive:
    """(text, size, overlap): windows of words."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        chunking.check_window(size, overlap)
        words = [] if _blank(text) else text.split()
        for i, start in enumerate(range(0, max(1, len(words) - overlap) if words else 0, size - overlap)):
            yield i, " ".join(words[start : start + size])


@udtf(returnType=ROW, useArrow=True)
class ChunkRecursive:
    """(text, size, overlap): at most `size` characters, cut at the coarsest separators; with a section's budget as size, the
    structural chunker."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        chunking.check_window(size, overlap)
        yield from enumerate([] if _blank(text) else chunking.split_recursive(text, size, overlap))


@udtf(returnType=ROW, useArrow=True)
class ChunkSemantic:
    """(text, size, overlap, percentile): whole sentences, cut where the hashed vectors of neighbours jump."""

    def __init__(self):
        self.embed = chunking._hashed()

    def eval(self, text: str, size: int, overlap: int, percentile: float) -> Iterator[tuple[int, str]]:
        chunking.check_window(size, overlap)
        yield from enumerate([] if _blank(text) else chunking.split_semantic(text, self.embed, str.split, size, overlap, float(percentile)))


@udtf(returnType=ROW, useArrow=True)
class ChunkSlices:
    """(text, size, overlap): slices of `size` characters at every stride, blank ones too."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        chunking.check_window(size, overlap)
        for i, start in enumerate(range(0, len(text or ""), size - overlap)):
            yield i, text[start : start + size]


FUNCTIONS = {"chunk_naive": ChunkNaive, "chunk_recursive": ChunkRecursive, "chunk_semantic": ChunkSemantic, "chunk_slices": ChunkSlices}


def register(spark: SparkSession) -> None:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, made)
