"""Words as maximal runs of letters of the lower-cased text, with code points in one array a chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES, U64, mix64, runs_of, span_hash

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter; a 64-bit hash of each code point (built once a worker)."""
    if not _TABLES:
        n = 0x110000
        letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        with np.errstate(over="ignore"):
            _TABLES.extend((letter, mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))))
    return _TABLES[0], _TABLES[1]


class LetterWords:
    """code: code points of the lower-cased rows, values: their hashes; starts, ends, row, hash: of each word; rows: number of rows."""

    def __init__(self, texts: list[str | None]):
        low = [t.lower() if t else "" for t in texts]
        letter, hashed = _tables()
        self.rows = len(low)
        self.code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
        self.starts, self.ends, self.row = runs_of(self.code, self.off, letter[self.code])
        self.values = hashed[self.code]
        self.hash = span_hash(self.values, self.starts, self.ends) if len(self.starts) else np.empty(0, U64)


def letter_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, LetterWords]]:
    """(first row, last row + 1, words) of chunks of at most so many characters, or one row."""
    rows = texts.to_pylist()
    lo, size = 0, 0
    for i, t in enumerate(rows):
        n = len(t) if t else 0
        if i > lo and size + n > most:
            yield lo, i, LetterWords(rows[lo:i])
            lo, size = i, 0
        size += n
    if lo < len(rows):
        yield lo, len(rows), LetterWords(rows[lo:])


def find(vocab: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in an ascending vocabulary, and which are there."""
    if not len(vocab):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    return at, vocab[at] == h
