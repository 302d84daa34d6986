"""Byte-pair vocabularies: ids, and windows over them that are cut from the text's bytes."""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass

import numpy as np


@functools.lru_cache(maxsize=4)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})


@functools.lru_cache(maxsize=4)
def _merges(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@dataclass(frozen=True)
class Vocabulary:
    """A file of ranks, the pattern that cuts texts before merging, and, for texts that are too much for the pattern's matcher
    (white space in a run of a million), the same vocabulary as a file of merges. Special tokens' strings are ordinary text."""

    ranks: str
    pattern: str
    merges: str | None = None

    @classmethod
    def public(cls) -> "Vocabulary":
        """The installed byte-level vocabulary."""
        import public_tokenizers as p

        return cls(p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("byte_bpe_50k.json"))

    def ids(self, text: str) -> list[int]:
        try:
            return _encoding(self.ranks, self.pattern).encode_to_numpy(text, disallowed_special=()).tolist()
        except ValueError:
            if self.merges is None:
                raise
            return _merges(self.merges).encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def windows(self, text: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
        """(text, first byte, byte behind the last) of windows of `size` ids; the last is the first that reaches the end. What a
        border leaves of a character is U+FFFD."""
        ids = self.ids(text)
        if not ids:
            return []
        raw, known = text.encode(), _encoding(self.ranks, self.pattern)
        ends = np.cumsum([len(known.decode_single_token_bytes(i)) for i in ids])
        out = []
        for start in range(0, max(1, len(ids) - overlap), size - overlap):
            a, z = int(ends[start - 1]) if start else 0, int(ends[min(start + size, len(ids)) - 1])
            out.append((raw[a:z].decode(errors="replace"), a, z))
        return out
