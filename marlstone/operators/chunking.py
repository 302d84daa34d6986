"""Chunkers: tables of sections (doc_key, section_id, text) in, tables of chunks out.

Hard slices are closed forms over arrays. Fixed and parent/child windows are cut in Arrow batches, each text's tokens made once
and each window taken from them alone. The recursive and the semantic chunker work on places in a text: where pieces begin and
end, and how far a chunk reaches is found by binary search, so their work grows with the number of chunks and not with that of
pieces times their length."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.bpe import Vocabulary
from marlstone.functions.text import SENTENCE_END, TOKEN, sentences, white_tokens
from marlstone.operators.streams import small_batches

#: Characters for each section, and for all others.
BUDGETS = {
    "item_1": 2000,
    "item_1a": 1200,
    "item_1b": 1200,
    "item_1c": 1200,
    "item_2": 2000,
    "item_3": 2000,
    "item_7": 3000,
    "item_7a": 2000,
    "item_8": 3000,
}
DEFAULT_BUDGET, BUDGET_OVERLAP = 2000, 200
#: Characters of chunks that make an Arrow batch.
BATCH = 4 << 20
#: Sentences whose vectors are held at once.
SENTENCES = 512
SEPARATORS = ("\n\n", "\n", ". ", " ")


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the window must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the window, and not negative")


def window_starts(n: int, size: int, overlap: int) -> range:
    """Starts (from 0) of windows over n tokens: the last one is the first that reaches the end."""
    return range(0, max(1, n - overlap) if n else 0, size - overlap)


def windows(rows: DataFrame, keep: list[str], size: int, overlap: int, child: tuple[int, int] | None = None) -> DataFrame:
    """The columns to keep, chunk_index, text: windows over each row's `text` (words between white space) or `w` (an array of
    tokens). With `child`, a window of its own, they are windows within those windows, `i` being their number there."""
    check_window(size, overlap)
    if child is not None:
        check_window(*child)
    small_batches(rows.sparkSession)
    of = "w" if "w" in rows.columns else "text"
    rows = rows.select(*keep, of)
    names = [*keep, "chunk_index", *(["i"] if child else []), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, numbers, inner, out, held = [], [], [], [], 0

            def made(b=b) -> pa.RecordBatch:
                at = pa.array(place, pa.int64())
                cols = [pa.array(numbers, pa.int32()), *([pa.array(inner, pa.int32())] if child else []), pa.array(out, pa.string())]
                return pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], *cols], names=names)

            for row, x in enumerate(b.column(of)):
                words = x.as_py() or []
                words = words.split() if of == "text" and words else words
                for k, s in enumerate(window_starts(len(words), size, overlap)):
                    own = words[s : s + size]
                    for i, c in enumerate(window_starts(len(own), *child) if child else (0,)):
                        out.append(" ".join(own[c : c + child[0]] if child else own))
                        place.append(row)
                        numbers.append(k)
                        inner.append(i)
                        held += len(out[-1])
                    if held >= BATCH:
                        yield made()
                        place, numbers, inner, out, held = [], [], [], [], 0
            if out:
                yield made()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", chunk_index int, " + ("i int, " if child else "") + "text string")


def not_blank(sections: DataFrame, text: str = "text") -> DataFrame:
    return sections.filter(F.col(text).rlike(TOKEN))


def chunk_id(key: Column, section: Column, index: Column) -> Column:
    return F.format_string("%s_%s::%04d", key, section, index)


def naive(sections: DataFrame, size: int = 512, overlap: int = 50, tokens: Callable[[Column], Column] = white_tokens, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Windows of `size` tokens: chunk_id, doc_key, section_id, chunk_index, text, chunker. With a vocabulary they are windows of
    its ids, cut from the text's bytes, whose places are start_byte and end_byte."""
    if vocabulary is not None:
        rows = id_windows(not_blank(sections), ["doc_key", "section_id"], vocabulary, size, overlap)
        return _named(rows, "naive")
    rows = sections if tokens is white_tokens else not_blank(sections).withColumn("w", tokens(F.col("text")))
    return _named(windows(rows, ["doc_key", "section_id"], size, overlap), "naive")


def id_windows(rows: DataFrame, keep: list[str], vocabulary: Vocabulary, size: int, overlap: int) -> DataFrame:
    """The columns to keep, chunk_index, text, start_byte, end_byte: windows over a vocabulary's ids, text by text."""
    check_window(size, overlap)
    rows = rows.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, out = [], []
            for i, text in enumerate(b.column("text")):
                made = vocabulary.windows(text.as_py() or "", size, overlap)
                place += [i] * len(made)
                out += [(k, *w) for k, w in enumerate(made)]
            cols = list(zip(*out)) or [[]] * 4
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*keep, "chunk_index", "text", "start_byte", "end_byte"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", chunk_index int, text string, start_byte long, end_byte long")


def _named(rows: DataFrame, chunker: str) -> DataFrame:
    return rows.select(
        chunk_id(F.col("doc_key"), F.col("section_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_key",
        "section_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "text",
        F.lit(chunker).alias("chunker"),
        *[c for c in rows.columns if c not in ("doc_key", "section_id", "chunk_index", "text")],
    )


def hard_slices(text: Column, size: int, overlap: int) -> Column:
    """Slices at every stride, to the end: the last may lie within the one before."""
    check_window(size, overlap)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def pieces(text: str, low: int, high: int, separator: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of text[low:high] between separators begin and end."""
    cuts = np.array([(m.start(), m.end()) for m in re.compile(re.escape(separator)).finditer(text, low, high)], np.int64).reshape(-1, 2)
    return np.concatenate(([low], cuts[:, 1])), np.concatenate((cuts[:, 0], [high]))


def packed(starts: np.ndarray, ends: np.ndarray, size: int, from_empty: bool = True) -> list[tuple[int, int]]:
    """(first, last) piece of each run that is as long as fits `size`, separators counted; a longer piece is a run of its own.
    Without `from_empty` no run begins with an empty piece: those are passed over."""
    out, i = [], 0
    while i < len(starts):
        if not from_empty and starts[i] == ends[i]:
            i += 1
            continue
        j = max(i, int(np.searchsorted(ends, starts[i] + size, side="right")) - 1)
        out.append((i, j))
        i = j + 1
    return out


def recursive_spans(text: str, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `size` characters. What is too long is cut at the coarsest separator that it has, and
    neighbouring pieces are packed; what stays too long goes on to finer ones. Without any it is cut into slices, the only
    place where the overlap acts. Blank chunks go."""
    check_window(size, overlap)
    out, todo = [], [(0, len(text), 0)]
    while todo:  # the last entry is the next in the text
        low, high, level = todo.pop()
        if high - low <= size:
            out.append((low, high))
            continue
        level = next((k for k in range(level, len(separators)) if text.find(separators[k], low, high) >= 0), len(separators))
        if level == len(separators):
            out += [(at, min(at + size, high)) for at in range(low, high, size - overlap)]
            continue
        starts, ends = pieces(text, low, high, separators[level])
        todo += [(int(starts[i]), int(ends[j]), level + 1) for i, j in reversed(packed(starts, ends, size, from_empty=False))]
    return [(a, z) for a, z in out if text[a:z].strip()]


def split_recursive(text: str, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return [text[a:z] for a, z in recursive_spans(text, size, overlap, separators)]


def neighbour_distances(vectors: np.ndarray) -> np.ndarray:
    """Cosine distance, from 0 to 2, of each row to the next."""
    v = np.asarray(vectors, np.float64)
    length = np.sqrt((v * v).sum(axis=1))
    unit = v / np.where(length == 0, 1.0, length)[:, None]
    return np.clip(1.0 - (unit[:-1] * unit[1:]).sum(axis=1), 0.0, 2.0)


def sentence_vectors_distances(said: list[str], embed: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """Distances of sentences to the next, with the vectors of SENTENCES of them at a time."""
    parts = [neighbour_distances(embed(said[at : at + SENTENCES + 1])) for at in range(0, len(said) - 1, SENTENCES)]
    return np.concatenate(parts) if parts else np.zeros(0)


def jumps(distances: np.ndarray, percentile: float = 95.0) -> np.ndarray:
    """Places (from 0) of distances at the percentile of all of them or above."""
    return np.flatnonzero(distances >= np.percentile(distances, percentile)) if len(distances) else np.zeros(0, np.int64)


def semantic_runs(sizes: np.ndarray, opening: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """(first, last) sentence of each chunk. sizes: tokens of each sentence; opening: sentences that a chunk should open with.

    Stretches between sentences over the budget, which stand alone, are taken in turn. A chunk reaches to the next opening
    sentence or to where the budget ends, and the next one begins a sentence earlier. Where that one and the opening one are
    too much together, it is a chunk of its own as well."""
    n = len(sizes)
    total = [0, *np.cumsum(sizes).tolist()]
    opens = [*np.sort(opening).tolist(), n]
    out = []
    alone = np.flatnonzero(sizes > budget)
    for low, high in zip(np.concatenate(([0], alone + 1)), np.append(alone, n)):
        first, new = int(low), int(low) + 1  # the chunk's first sentence, and the first that may still be cut off
        while first < high:
            full = bisect.bisect_right(total, total[first] + budget) - 1
            cut = min(opens[bisect.bisect_left(opens, new)], max(full, new), int(high))
            out.append((first, cut - 1))
            if cut == high:
                break
            if cut < n and opens[bisect.bisect_left(opens, cut)] == cut and sizes[cut - 1] + sizes[cut] > budget:
                out.append((cut - 1, cut - 1))
            first, new = cut - 1, cut + 1
        if high < n:
            out.append((int(high), int(high)))
    return out


def split_semantic(text: str, embed: Callable[[list[str]], np.ndarray], tokens: Callable[[str], list[str]] | Vocabulary, size: int = 512, overlap: int = 50, percentile: float = 95.0) -> list[str]:
    """Chunks of whole sentences, cut where meaning jumps and at the budget of tokens, each but the first after its cut opening
    with the last sentence before it. A sentence over the budget is cut into windows."""
    check_window(size, overlap)
    said = [x for x in map(str.strip, re.split(SENTENCE_END, text.strip())) if x]
    by_ids = isinstance(tokens, Vocabulary)
    words = [tokens.ids(x) if by_ids else tokens(x) for x in said]
    sizes = np.array([len(w) for w in words], np.int64)
    opening = jumps(sentence_vectors_distances(said, embed), percentile) + 1 if len(said) > 1 else np.zeros(0, np.int64)
    out = []
    for first, last in semantic_runs(sizes, opening, size):
        if sizes[first] <= size:
            out.append(" ".join(said[first : last + 1]))
        elif by_ids:
            out += [w for w, _, _ in tokens.windows(said[first], size, overlap)]
        else:
            starts = range(0, max(1, int(sizes[first]) - overlap), size - overlap)
            out += [" ".join(words[first][k : k + size]) for k in starts]
    return out


def _stateful(sections: DataFrame, split: Callable[[dict], list[str]], chunker: str, extra: str = "") -> DataFrame:
    names = sections.columns
    small_batches(sections.sparkSession)

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * (4 + bool(extra))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *([pa.int32()] if extra else [])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_key", "section_id", "chunk_index", "text", *([extra] if extra else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                for i, x in enumerate(split(r)):
                    out.append((r["doc_key"], r["section_id"], i, x, *([r[extra]] if extra else [])))
                    held += len(x)
                if held >= BATCH:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    out = "doc_key string, section_id string, chunk_index int, text string" + (f", {extra} int" if extra else "")
    return _named(not_blank(sections).select(*names).mapInArrow(run, out), chunker)


def recursive(sections: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    check_window(size, overlap)
    return _stateful(sections.select("doc_key", "section_id", "text"), lambda r: split_recursive(r["text"], size, overlap), "recursive")


def semantic(sections: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None, size: int = 512, overlap: int = 50, percentile: float = 95.0, vocabulary: Vocabulary | None = None) -> DataFrame:
    how = embed or _hashed()
    check_window(size, overlap)
    return _stateful(sections.select("doc_key", "section_id", "text"), lambda r: split_semantic(r["text"], how, vocabulary or str.split, size, overlap, percentile), "semantic")


def budgets(sections: DataFrame, table: dict[str, int] | None = None, default: int = DEFAULT_BUDGET) -> DataFrame:
    """Sections with their budget in characters: a lookup with a default."""
    chosen = F.create_map(*[F.lit(x) for kv in (BUDGETS if table is None else table).items() for x in kv])
    return sections.withColumn("section_budget", F.coalesce(F.try_element_at(chosen, F.col("section_id")), F.lit(default)))


def structural(sections: DataFrame, table: dict[str, int] | None = None, default: int = DEFAULT_BUDGET, overlap: int = BUDGET_OVERLAP) -> DataFrame:
    """Recursive chunks, each section with its own budget."""
    rows = budgets(sections, table, default).select("doc_key", "section_id", "text", "section_budget")
    return _stateful(rows, lambda r: split_recursive(r["text"], r["section_budget"], overlap), "structural", "section_budget")


def parent_child(sections: DataFrame, size: int = 512, overlap: int = 50, child: int = 256, child_overlap: int = 25, vocabulary: Vocabulary | None = None) -> tuple[DataFrame, DataFrame]:
    """(parents, children): windows, and windows within each parent's text with ids {parent}:c00 and up."""
    parents = naive(sections, size, overlap, vocabulary=vocabulary)
    if vocabulary is not None:
        rows = parents.withColumnRenamed("chunk_id", "parent_id")
        rows = id_windows(rows, ["parent_id", "doc_key", "section_id"], vocabulary, child, child_overlap).withColumnsRenamed({"chunk_index": "i"})
    else:
        rows = windows(sections, ["doc_key", "section_id"], size, overlap, (child, child_overlap))
        rows = rows.withColumn("parent_id", chunk_id(F.col("doc_key"), F.col("section_id"), F.col("chunk_index")))
    children = rows.select(F.format_string("%s:c%02d", "parent_id", "i").alias("chunk_id"), "doc_key", "section_id", F.col("i").cast("long").alias("child_index"), "text", "parent_id")
    return parents, children


def line_packs(docs: DataFrame, id_col: str = "doc_id", size: int = 600, separator: str = "\n", text_col: str = "text") -> DataFrame:
    """id, chunk, n_lines, n_chars: pieces between separators packed as they come, a longer one alone; none for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                starts, ends = pieces(text, 0, len(text), separator)
                rows += [(key, k, j - i + 1, int(ends[j] - starts[i])) for k, (i, j) in enumerate(packed(starts, ends, size))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[id_col, "chunk", "n_lines", "n_chars"])

    rows = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, chunk long, n_lines long, n_chars long")


def sentence_distances(docs: DataFrame, id_col: str = "doc_id", embed: Callable[[list[str]], np.ndarray] | None = None, percentile: float = 95.0, text_col: str = "text") -> DataFrame:
    """id, i, distance, jump: of each sentence to the next, and whether a chunk is cut there."""
    how = embed or _hashed()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, far, cut = [], [], [], []
            for key, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(said) > 1:
                    d = sentence_vectors_distances(said, how)
                    keys += [key] * len(d)
                    places += range(len(d))
                    far += d.tolist()
                    cut += np.isin(np.arange(len(d)), jumps(np.round(d, 9), percentile)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(places, pa.int64()), pa.array(far, pa.float64()), pa.array(cut, pa.bool_())], names=[id_col, "i", "distance", "jump"])

    rows = docs.select(id_col, sentences(F.col(text_col)).alias("said"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, i long, distance double, jump boolean")


def _hashed(dim: int | None = None) -> Callable[[list[str]], np.ndarray]:
    from marlstone.operators.embedding import DIM, hashed_rows

    return functools.partial(hashed_rows, dim=dim or DIM)


CHUNKERS = {"naive": naive, "recursive": recursive, "semantic": semantic, "structural": structural}


def chunk(sections: DataFrame, strategy: str = "naive", **how) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunker {strategy!r}; there are {sorted(CHUNKERS)}")
    return CHUNKERS[strategy](sections, **how)
