"""Bounded-space online packing of token sequences.

Each partition streams its documents once. A document's ids (its tokens, then the end id) are cut into full
windows while they last; the rest goes to the open window that it fits best. There are `n_open` open windows
at most: when none has room, the fullest is emitted (filled to the brim by a cut of the newcomer where both
parts keep `min_piece` ids, since documents may be cut freely) and another opens. What is left open at the end
of each partition (n_open windows at most) is merged in a second step, `group` partitions to a task, by
pouring the leftovers into full windows.

Memory per task: one Arrow batch and the open windows. No key is shuffled but the leftovers' group. Any
style was free here: tokenizers are Python libraries, so this is mapInArrow.

Defined results: a null text is an empty one (one piece, the end id alone); null or repeated ids are packed
like any other row; an empty table gives no piece; other columns are passed by.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, table, written

WINDOW = 2048
END_ID = 1
N_OPEN = 64
MIN_PIECE = 32
GROUP = 8

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STAGED = PIECE + ", ids binary, part int"


def default_tokenizer() -> tuple[str, str, str]:
    """The public byte-level vocabulary: merges file, the same as ranks, and its pre-tokenizer's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Text to ids as little-endian unsigned 32-bit bytes.

    The vocabulary comes as a merges file (tokenizers) and as ranks (tiktoken); both give the same ids and the
    second is four times as fast, so it does the work where it is given. Texts that hold a special token's
    string go to the first, which knows those; so do texts that are too much for the second's pattern matcher (white
    space in a run of a million)."""

    kept: dict = {}

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})

    @classmethod
    def of(cls, *paths) -> "Encoder":
        if paths not in cls.kept:
            cls.kept[paths] = cls(*paths)
        return cls.kept[paths]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.specials):
            return self.whole(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            return self.whole(text)


class Packer:
    """Open windows of one partition. Feed documents; rows come out as windows are emitted."""

    def __init__(self, first_sequence: int, window: int = WINDOW, n_open: int = N_OPEN, min_piece: int = MIN_PIECE):
        self.window, self.n_open, self.min_piece = window, n_open, min_piece
        self.next_sequence = first_sequence
        self.open: list[tuple[int, int, list]] = []  # (free, number, pieces), sorted
        self.number = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next_sequence, at, None, None))
            at += n
        self.next_sequence += 1

    def add(self, doc_id, ids: bytes, start: int = 0, doc_tokens: int | None = None) -> None:
        n = len(ids) // 4
        doc_tokens = n if doc_tokens is None else doc_tokens
        at = 0
        while n - at >= self.window:
            self.emit([(doc_id, start + at, ids[4 * at : 4 * (at + self.window)], doc_tokens)])
            at += self.window
        while at < n:
            rest = n - at
            k = bisect.bisect_left(self.open, (rest,))
            if k == len(self.open) and len(self.open) >= self.n_open:
                free, _, pieces = self.open.pop(0)
                if free >= self.min_piece and rest - free >= self.min_piece:
                    pieces.append((doc_id, start + at, ids[4 * at : 4 * (at + free)], doc_tokens))
                    at += free
                self.emit(pieces)
                continue
            free, number, pieces = self.open.pop(k) if k < len(self.open) else (self.window, self.number, [])
            self.number += 1
            pieces.append((doc_id, start + at, ids[4 * at :], doc_tokens))
            if free == rest:
                self.emit(pieces)
            else:
                bisect.insort(self.open, (free - rest, number, pieces))
            return

    def leftovers(self) -> list[list]:
        left, self.open = [pieces for _, _, pieces in self.open], []
        return left


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


_FIELDS = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
_STAGED = pa.schema([*_FIELDS, pa.field("ids", pa.binary()), pa.field("part", pa.int32())])
_PIECE = pa.schema(_FIELDS)


def pack(
    docs: DataFrame,
    tokenizer: tuple[str, ...] | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    n_open: int = N_OPEN,
    min_piece: int = MIN_PIECE,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    paths = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer = Encoder.of(*paths), Packer(part << 32, window, n_open, min_piece)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encoder.encode(text.as_py() or "") + end)
                if len(packer.rows) >= 50_000:
                    yield _table(packer.rows, _STAGED)
                    packer.rows = []
        for pieces in packer.leftovers():
            for doc_id, start, ids, doc_tokens in pieces:
                packer.rows.append((doc_id, start, len(ids) // 4, None, doc_tokens, None, None, ids, part))
        yield _table(packer.rows, _STAGED)

    def pour(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (1 << 62) + (key[0].as_py() << 32)
        packer, free, pieces = Packer(first), window, []
        for batch in batches:
            for doc_id, start, ids, doc_tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                while ids:
                    now, ids = ids[: 4 * free], ids[4 * free :]
                    pieces.append((doc_id, start, now, doc_tokens))
                    start += len(now) // 4
                    free -= len(now) // 4
                    if not free:
                        packer.emit(pieces)
                        free, pieces = window, []
                    elif free < min_piece and len(ids) == 0:
                        packer.emit(pieces)
                        free, pieces = window, []
        if pieces:
            packer.emit(pieces)
        yield _table([r[:7] for r in packer.rows], _PIECE)

    small_batches(docs.sparkSession)
    staged = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(stream, STAGED), "packed")
    whole = staged.filter("ids is null").select(*_PIECE.names)
    left = staged.filter("ids is not null").withColumn("g", F.expr(f"part div {group}"))
    merged = left.groupBy("g").applyInArrow(pour, PIECE)
    return whole.unionByName(merged)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
