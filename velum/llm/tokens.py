"""What several operators share: byte-level views of texts, for use inside tasks, and free column names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_ASCII = bytes(range(128))
_LETTERS_DIGITS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")

#: Lower-cases A-Z, turns every other ASCII character but letters and digits into a blank; bytes from 128 stay.
ALNUM = bytes((c if c in _LETTERS_DIGITS else 32) if c < 128 else c for c in (bytes([b]).lower()[0] for b in range(256)))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def each_text(column: pa.Array | pa.ChunkedArray, rows: int = 512) -> Iterator[bytes]:
    """The same one after another, ``rows`` of them as Python objects at once."""
    for at in range(0, len(column), rows):
        yield from texts(column.slice(at, rows))


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{name}{i}" for i in range(len(taken) + 1)) if n not in taken)


class WordIds(dict):
    """CRC-32 of a word, remembered for up to ``limit`` words; the numbers never depend on what is remembered."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


_MIX = np.uint32(0x9E3779B1)


def mixed(*parts: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Bucket numbers of ``bits`` bits for n-grams given as equally long columns of word numbers."""
    h = np.full(len(parts[0]), kind * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for p in parts:
        h = (h ^ p) * _MIX
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
