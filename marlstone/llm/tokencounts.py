"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token is what the tokenizer's own normalizer and pre-tokenizer cut a text into; its pieces hang on nothing else.

1. Each task turns documents into frequencies of pre-tokens, in blocks: a block has a dictionary (each of its distinct
   pre-tokens once, numbered) and its documents' pairs of number and frequency, compressed, several documents to a row.
   A block ends at PAIRS pairs, or with the document that passes that.
2. Dictionary entries are dealt and sorted by pre-token; each distinct one goes through the model once, and its number of
   pieces goes back to every block that has it. A frequent pre-token is one row a block, not one a document.
3. A block's numbers of pieces are joined to its documents' frequencies and summed.

Memory per task: one Arrow batch and one block (a dictionary, arrays of PAIRS numbers). Only blocks and dictionary
entries are shuffled, no text. Any style was free here: tokenizers are Python libraries.

Words between blanks that are ASCII letters only are their own lower-case pre-token where the tokenizer is of the known kind
(`_BY_WORD`); other words are cut by the library, remembered for a while. Tokenizers of any other kind have whole texts cut
by the library. Strings of added tokens within a text are one token each, as is the library's default.

Defined results: a null text is an empty one (0 bytes, 0 tokens); null or repeated ids are counted row by row; an empty
table gives an empty result; other columns are passed by; a text of any length is one document of one block.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, table, written

LIMIT = 2048
#: Pairs of a block and of a row of documents, documents of such a row, entries of a row of the dictionary, words remembered.
PAIRS, ROW_PAIRS, ROW_DOCS, ROW_WORDS, REMEMBERED = 4_000_000, 500_000, 512, 4096, 300_000
#: The number of an added token in every dictionary: one piece.
ADDED = 0

STAGED = "block long, first int, words array<string>, doc_ids array<long>, n_bytes array<long>, lens array<int>, idx binary, freq binary"
_ZSTD = pa.Codec("zstd", compression_level=3)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PreTokens:
    """The normalizer, pre-tokenizer and model of a tokenizer file, apart."""

    kept: dict = {}
    #: Fixed values of the file format: the kind of tokenizer whose pre-tokens never span white space.
    _BY_WORD = (
        ["NFC", "Replace", "Lowercase"],
        r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens that strip, are words or are normalized can't be told apart from pre-tokens")
        names = sorted((t.content for t in added), key=lambda c: (-len(c), c))
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kind = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])], steps[0].get("pattern", {}).get("Regex") if steps else None
        self.by_word = kind == self._BY_WORD and not any(c.isspace() for n in names for c in n)
        self.remembered: dict[str, tuple[str | None, ...]] = {}

    @classmethod
    def of(cls, path: str) -> "PreTokens":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def cut(self, text: str) -> list[str | None]:
        """Pre-tokens of a text by the library; None for an added token."""
        out: list[str | None] = []
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            out += [*self._plain(text[at : m.start()]), None]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if self.tokenizer.pre_tokenizer else [normal]

    def frequencies(self, text: str) -> dict[str | None, int]:
        if not self.by_word:
            return Counter(self.cut(text))
        # blanks, line ends and tabs alone: what else is white space is left to the library
        words = Counter(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        words.pop("", None)
        out: dict[str | None, int] = {}
        seen = self.remembered
        for word, n in words.items():
            if word.isascii() and word.isalpha():
                word = word.lower()
                out[word] = out.get(word, 0) + n
                continue
            parts = seen.get(word)
            if parts is None:
                parts = tuple(self.cut(word))
                if len(word) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = parts
            for p in parts:
                out[p] = out.get(p, 0) + n
        return out

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


_STAGED = pa.schema(
    [
        ("block", pa.int64()),
        ("first", pa.int32()),
        ("words", pa.list_(pa.string())),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_bytes", pa.list_(pa.int64())),
        ("lens", pa.list_(pa.int32())),
        ("idx", pa.binary()),
        ("freq", pa.binary()),
    ]
)


class Block:
    """A block as it grows: its dictionary and the row of documents that is being filled."""

    def __init__(self, number: int):
        self.number, self.words, self.pairs = number, {None: ADDED}, 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.sizes, self.lens, self.idx, self.freq, self.held = [], [], [], [], [], 0

    def add(self, doc_id: int | None, size: int, found: dict[str | None, int]) -> None:
        words = self.words
        idx = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found))
        freq = np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(idx)
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.lens.append(len(idx))
        self.idx.append(np.diff(idx[order], prepend=np.int32(0)))
        self.freq.append(freq[order])
        self.held += len(idx)
        self.pairs += len(idx)

    def full_row(self) -> bool:
        return self.held >= ROW_PAIRS or len(self.ids) >= ROW_DOCS

    def documents(self) -> pa.RecordBatch:
        """The filled row: steps between sorted numbers byte by byte, so that equal high bytes lie together."""
        steps = np.concatenate([np.zeros(0, np.int32), *self.idx]).astype("<i4")
        freq = np.concatenate([np.zeros(0, np.int64), *self.freq]).astype("<i8")
        out = _row(_STAGED, block=self.number, doc_ids=self.ids, n_bytes=self.sizes, lens=self.lens, idx=squeezed(steps), freq=squeezed(freq))
        self._clear()
        return out

    def dictionary(self) -> Iterator[pa.RecordBatch]:
        words = list(self.words)[1:]
        for k in range(0, len(words), ROW_WORDS):
            yield _row(_STAGED, block=self.number, first=k + 1, words=words[k : k + ROW_WORDS])


def squeezed(x: np.ndarray) -> bytes:
    return _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), asbytes=True) if len(x) else b""


def unsqueezed(b: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = _ZSTD.decompress(b, decompressed_size=n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs."""
    path = tokenizer or default_tokenizer()
    if not path.endswith(".json"):
        raise ValueError("pre-tokens are told by a tokenizers .json file")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at = PreTokens.of(path), TaskContext.get().partitionId() << 32
        block = Block(at)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for doc_id, size, text in zip(batch.column(0).to_pylist(), sizes, texts):
                block.add(doc_id, size, cutter.frequencies(text.as_py() or ""))
                if block.pairs >= pairs:
                    yield block.documents()
                    yield from block.dictionary()
                    at += 1
                    block = Block(at)
                elif block.full_row():
                    yield block.documents()
        if block.ids:
            yield block.documents()
        yield from block.dictionary()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, n = PreTokens.of(path), None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("word"))
            ends = runs.run_ends.to_numpy(zero_copy_only=False)
            values = np.zeros(len(ends), np.int32)
            for k, word in enumerate(runs.values.to_pylist()):
                if word != last:
                    last, n = word, cutter.pieces(word)
                values[k] = n
            pieces = np.repeat(values, np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("idx"), pa.array(pieces, pa.int32())], names=["block", "idx", "pieces"])

    def summed(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        idx = right["idx"].to_numpy()
        pieces = np.zeros(int(idx.max()) + 1 if len(idx) else 1, np.int64)
        pieces[idx] = right["pieces"].to_numpy()
        pieces[ADDED] = 1
        ids, sizes, tokens = [], [], []
        for row in left.select(["doc_ids", "n_bytes", "lens", "idx", "freq"]).to_pylist():
            lens = np.array(row["lens"], np.int64)
            n = int(lens.sum())
            ends = np.cumsum(lens)
            steps, freq = unsqueezed(row["idx"], n, "<i4"), unsqueezed(row["freq"], n, "<i8")
            # numbers within a document are running sums of its steps
            run = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            number = run[1:] - np.repeat(run[ends - lens], lens)
            total = np.concatenate([[0], np.cumsum(pieces[number] * freq)])
            ids += row["doc_ids"]
            sizes += row["n_bytes"]
            tokens.append(total[ends] - total[ends - lens])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(np.concatenate([np.zeros(0, np.int64), *tokens]))})

    small_batches(docs.sparkSession)
    staged = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(blocks, STAGED), "frequencies")
    entries = staged.filter("words is not null").select("block", "first", F.posexplode("words").alias("k", "word"))
    entries = entries.select("block", (F.col("first") + F.col("k")).cast("int").alias("idx"), "word")
    pieces = entries.repartition("word").sortWithinPartitions("word").mapInArrow(counted, "block long, idx int, pieces int")
    rows = staged.filter("doc_ids is not null").select("block", "doc_ids", "n_bytes", "lens", "idx", "freq")
    out = rows.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
