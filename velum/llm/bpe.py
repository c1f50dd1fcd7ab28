"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

The tree's leaves are the positions of a word; a leaf holds the rank of the pair that starts there,
joined with its position, so the root is the leftmost pair of the lowest rank. A merge changes three
leaves, each in logarithmic time, and the word is done when the root holds no pair.

Null and empty texts have no tokens and decode to the empty text. A text of any length is one row;
a single word of n bytes takes O(n log n). Repeated rows give repeated results; other columns stay
as they are, whatever their names, as the functions are column expressions.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the published splitting pattern and byte alphabet of this kind of vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# ---

#: White space with the characters up to the next white space. No match of ``PATTERN`` goes on from a
#: character into the white space behind it, so such chunks can be split and remembered one by one.
_CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORDS = regex.compile(
    PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))

REMEMBERED = 300_000
LONGEST_REMEMBERED = 48
#: Words up to so many bytes are merged many at a time, a tree in each row of one array.
WIDTHS = (8, 16, 32, 64)
_WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]
#: Characters of text that are tokenised together; a longer text is taken alone.
TOGETHER = 4_000_000
#: Texts of a batch that exist as Python objects at once.
SLICE = 512
#: Words that are merged in one array, which then fits a core's cache.
ROWS = 4096
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    free = iter(range(256, 512))
    shown = set(PRINTABLE)
    return [chr(b if b in shown else next(free)) for b in range(256)]


def merge_word(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none is left.

    ``merges`` maps ``left << 32 | right`` to ``(rank, merged symbol)``.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * width)
    get = merges.get
    for i in range(n - 1):
        found = get(symbols[i] << 32 | symbols[i + 1])
        if found:
            tree[width + i] = found[0] * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += width
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        symbols[i] = get(symbols[i] << 32 | symbols[j])[1]
        symbols[j] = -1
        k = after[i] = after[j]
        put(j, none)
        if k < n:
            before[k] = i
            found = get(symbols[i] << 32 | symbols[k])
            put(i, found[0] * n + i if found else none)
        else:
            put(i, none)
        p = before[i]
        if p >= 0:
            found = get(symbols[p] << 32 | symbols[i])
            put(p, found[0] * n + p if found else none)
    return [s for s in symbols if s >= 0]


class Pairs:
    """Ranks and results of all merges, for looking up many pairs at once."""

    def __init__(self, merges: dict[int, tuple[int, int]]):
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        values = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        self.keys, self.ranks = np.append(keys[order], 1 << 62), np.append(values[order, 0], 0).astype(np.int32)
        self.merged = np.zeros(len(values), np.int32)
        self.merged[values[:, 0]] = values[:, 1]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of pairs at positions ``at``; a symbol below zero is in no pair."""
        wanted = left.astype(np.int64) << 32 | right
        found = np.searchsorted(self.keys, wanted)
        hit = (self.keys[found] == wanted) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[found] * np.int32(width) + at, _NONE)


def merge_words(words: list[list[int]] | np.ndarray, width: int, pairs: Pairs) -> np.ndarray:
    """``merge_word`` for many words: rows of at most ``width`` symbols, filled up with -1.

    Each step takes the root of every row that has a mergeable pair left, and updates the three leaves
    and the nodes above them in all these rows. Returns the rows with -1 where no symbol is left.
    """
    rows = len(words)
    symbols = np.full((rows, width + 1), -1, np.int32)
    symbols[:, :width] = words
    lengths = (symbols >= 0).sum(axis=1)
    at = np.arange(width, dtype=np.int32)
    tree = np.full((rows, 2 * width), _NONE)
    tree[:, width:] = pairs.leaves(symbols[:, :-1], symbols[:, 1:], at, width)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    after = np.tile(np.append(at + 1, np.int32(width)), (rows, 1))
    after[np.arange(rows), np.maximum(lengths - 1, 0)] = width
    before = np.tile(np.append(at - 1, np.int32(width)), (rows, 1))
    row = np.flatnonzero(tree[:, 1] != _NONE)
    while len(row):
        root = tree[row, 1]
        i = root & (width - 1)
        j = after[row, i]
        k = after[row, j]
        merged = pairs.merged[root // width]
        symbols[row, i], symbols[row, j] = merged, -1
        after[row, i], before[row, k] = k, i
        p = before[row, i]
        p = np.where(p < 0, width - 1, p)  # the last leaf never starts a pair
        first = before[row, i] < 0
        tree[row, width + j] = _NONE
        tree[row, width + i] = pairs.leaves(merged, symbols[row, k], i, width)
        tree[row, width + p] = np.where(first, tree[row, width + p], pairs.leaves(symbols[row, p], merged, p, width))
        nodes = [width + j, width + i, width + p]
        for _ in range(width.bit_length() - 1):
            for x, node in enumerate(nodes):
                nodes[x] = node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        row = row[tree[row, 1] != _NONE]
    return symbols[:, :width]


class Tokenizer:
    """Encodes and decodes by a vocabulary given as the text of its file."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        ids = data["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([ids[c] for c in letters], np.int32)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        self.pairs = Pairs(self.merges)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        bytes_of |= {i: content.encode() for content, i in self.special.items()}
        in_order = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.blob = np.frombuffer(b"".join(in_order), np.uint8)
        self.sizes = np.array(list(map(len, in_order)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._known: dict[str, bytes] = {}

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of different words."""
        out, by_width = {}, {w: ([], []) for w in WIDTHS}
        for word in words:
            raw = word.encode()
            if len(raw) <= WIDTHS[-1]:
                group = by_width[_WIDTH_OF[len(raw)]]
                group[0].append(word)
                group[1].append(raw)
            else:
                out[word] = np.array(merge_word(self.first[np.frombuffer(raw, np.uint8)].tolist(), self.merges), "<u4").tobytes()
        for width, (group, raws) in by_width.items():
            for at in range(0, len(group), ROWS):
                part = raws[at : at + ROWS]
                raw = np.array(part, f"S{width}").view(np.uint8).reshape(-1, width)
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                rows = merge_words(np.where(np.arange(width) < sizes[:, None], self.first[raw], -1), width, self.pairs)
                left = rows >= 0
                packed, ends = rows[left].astype("<u4").tobytes(), (np.cumsum(left.sum(axis=1)) * 4).tolist()
                out.update(zip(group[at : at + ROWS], map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of chunks that are not remembered."""
        several, words = {}, []
        for c in chunks:
            if c[0] == " " and c[1:].isalpha():  # one word by the pattern
                words.append(c)
            elif c[-1] in ".," and c[0] == " " and c[1:-1].isalpha():
                several[c] = (c[:-1], c[-1])
            else:
                several[c] = _WORDS.findall(c)
        out = self._merged(list({*words, *chain.from_iterable(several.values())}))
        out |= {c: b"".join([out[w] for w in ws]) for c, ws in several.items()}
        return {c: out[c] for c in chunks}

    def _encode_together(self, texts: list[str]) -> list[bytes]:
        pieces = [_CHUNKS.findall(t) for t in texts]
        known = self._known
        new = self._learn(set().union(*pieces) - known.keys())
        short = {c: ids for c, ids in new.items() if len(c) <= LONGEST_REMEMBERED}
        if len(known) + len(short) > REMEMBERED:
            # Of what was remembered, only what these texts use as well is kept.
            known = {c: known[c] for p in pieces for c in p if c in known}
        known |= new
        out = [b"".join(map(known.__getitem__, p)) for p in pieces]
        for c in new.keys() - short.keys():
            del known[c]
        self._known = known
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        out, group, size = [], [], 0
        for t in texts:
            if group and size + len(t) > TOGETHER:
                out += self._encode_together(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._encode_together(group)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        gc.disable()  # millions of strings live for a moment, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self._special is None:
            return self._encode_plain(texts)
        marked = {i: (self._special.split(t), self._special.findall(t)) for i, t in enumerate(texts) if self._special.search(t)}
        plain = self._encode_plain(["" if i in marked else t for i, t in enumerate(texts)])
        for i, (between, found) in marked.items():
            parts = self._encode_plain(between)
            ids = [np.array([self.special[f]], "<u4").tobytes() for f in found]
            plain[i] = b"".join(x for pair in zip(parts, [*ids, b""]) for x in pair)
        return plain

    def decode(self, packed: list[bytes]) -> list[str]:
        """The text of each sequence of packed ids."""
        out, at = [], 0
        while at < len(packed):
            size, to = len(packed[at]), at + 1
            while to < len(packed) and size + len(packed[to]) <= TOGETHER:
                size += len(packed[to])
                to += 1
            ids = np.frombuffer(b"".join(packed[at:to]), "<u4").astype(np.int64)
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            raw = self.blob[np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()
            counts = np.cumsum([len(p) // 4 for p in packed[at:to]])
            stops = np.where(counts > 0, ends[np.maximum(counts - 1, 0)] if total else 0, 0).tolist()
            out += [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops)]
            at = to
        return out


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read once by the driver and sent to every executor (a few MB for any vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(text: Column | str, vocabulary) -> Column:
    """Token ids of a text, packed as little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary.value)
        return pa.array(t.encode([x or "" for x in column.to_pylist()]), pa.binary())

    return ids(text)


def decode(ids: Column | str, vocabulary) -> Column:
    """The text of packed token ids; null ids give the empty text."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary.value)
        return pa.array(t.decode([x or b"" for x in column.to_pylist()]), pa.string())

    return text(ids)


def round_trip(text: Column | str, vocabulary) -> Column:
    """``struct<ids binary, decoded string>``: both in one visit to Python, the text decoded from the ids."""

    @F.arrow_udf("ids binary, decoded string")
    def both(column: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary.value)
        kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
        parts = []
        # A few texts at a time exist as Python objects; the batch is held in Arrow's form only.
        for at in range(0, len(column), SLICE):
            ids = t.encode([x or "" for x in column.slice(at, SLICE).to_pylist()])
            parts.append(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(t.decode(ids), pa.string())], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return both(text)
