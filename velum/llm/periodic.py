"""Periodic runs of words: seeds on diagonals, extended.

A run is a stretch of words in which words ``period`` apart are the same, with no smaller period, at least
``max(6, 4 * period)`` words long, which no neighbouring word continues. On the diagonal of its period (pairs of
places that far apart) it is a stretch of ``length - period`` equal pairs, so every run of a class of periods
``2**j`` to ``2**(j + 1) - 1`` holds equal k-grams, k being the least overlap that the class guarantees: 5 words for
period 1, ``3 * 2**j`` for the others. These k-grams are indexed by exact names, made by doubling from the names of
shorter ones; a place whose shorter gram stands once in its document is not looked at again, so ordinary prose costs a
few sorts.

Of the occurrences of a k-gram only neighbouring ones are paired. No run is lost by that: k is at least the period, so
an occurrence between two that are a period apart would give the period's words a period of their own. Pairs are
thus fewer than words, whatever is repeated. A seed is a pair whose distance is in the class. For each
distance a table holds how far the last extension reached; seeds before that place are skipped, others are
extended in both directions.

Words are ``[^\\x20\\x09-\\x0D]+``, whole texts are read. Null, empty and blank texts have no words and no
runs; repeated rows get repeated results; a text is never compared with another one. Batches are worked through
in groups of texts of up to ``GROUP`` bytes, a longer text alone, so memory follows the longest text. An empty table
gives an empty result. The operator is a column, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are indexed together.
GROUP = 4 << 20
#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(column: pa.Array, limit: int = GROUP) -> Iterator[pa.Array]:
    """Slices of consecutive texts of up to ``limit`` bytes, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield column.slice(start, end - start)
        start = end


def _names(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 for equal keys; 0 for a key that stands once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(counts[inverse] > 1, inverse + 1, 0)


def _paired(left: np.ndarray, right: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram in ``left`` is followed, ``apart`` words on, by one in ``right``, and keys of the two together."""
    n = len(left)
    if apart >= n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((left[: n - apart] > 0) & (right[apart:] > 0))
    return at, left[at] * (n + 1) + right[at + apart]


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of grams of ``2 * size`` words from those of ``size``."""
    out = np.zeros(len(names), np.int64)
    at, keys = _paired(names, names, size)
    if len(at):
        out[at] = _names(keys)
    return out


def _seeds(at: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring occurrences of equal grams, from ``least`` to under ``2 * least`` apart, by distance and place."""
    order = np.argsort(keys, kind="stable")
    place, key = at[order], keys[order]
    lag = place[1:] - place[:-1]
    near = (key[1:] == key[:-1]) & (lag >= least) & (lag < 2 * least)
    place, lag = place[:-1][near], lag[near]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _reach(words: np.ndarray, at: int, lag: int, way: int) -> int:
    """Number of equal pairs ``(i, i + lag)`` from ``i = at`` on, forwards or backwards."""
    done, step = 0, 32
    while True:
        if way > 0:
            a = words[at + done : at + done + step]
            b = words[at + done + lag : at + done + lag + step]
            a = a[: len(b)]
        else:
            low, high = max(0, at + 1 - done - step), max(0, at + 1 - done)
            a, b = words[low:high][::-1], words[low + lag : high + lag][::-1]
        other = np.flatnonzero(a != b)
        if len(other):
            return done + int(other[0])
        done += len(a)
        if len(a) < step:
            return done
        step *= 2


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows ``(start, length, period)`` by start and period. ``words`` are numbers that differ between documents."""
    found: list[tuple[int, int, int]] = []
    levels = [_names(words)] if len(words) else []
    longest: dict[int, int] = {}
    for j in range(64):
        if not levels or not levels[-1].any():
            break
        while len(levels) < max(j + 2, 3):
            levels.append(_doubled(levels[-1], 1 << (len(levels) - 1)))
        # The least overlap: 5 words for period 1, three times the least period for the other classes.
        k, (at, keys) = (5, _paired(levels[2], levels[0], 4)) if j == 0 else (3 << j, _paired(levels[j + 1], levels[j], 2 << j))
        places, lags = _seeds(at, keys, 1 << j)
        # A seed right behind another on its diagonal is within the other's extension.
        fresh = np.concatenate([[True], (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)]) if len(lags) else []
        for place, lag in zip(places[fresh].tolist(), lags[fresh].tolist()):
            if place < longest.get(lag, 0):
                continue
            start = place - _reach(words, place - 1, lag, -1)
            end = place + k + _reach(words, place + k, lag, 1)
            longest[lag] = end
            if end - start + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((start, end - start + lag, lag))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _of_group(column: pa.Array) -> pa.Array:
    """Results for a few texts together."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(column, ""))
    filled = pc.greater(pc.binary_length(trimmed), 0)
    lists = pc.ascii_split_whitespace(trimmed.filter(filled))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    ends = np.cumsum(counts)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    document = np.repeat(np.arange(len(counts)), counts)
    found = runs_of(document * (len(numbers) + 1) + numbers)
    start, length, period = found.T
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(np.bincount(document[keep], minlength=len(counts)))])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), " ")
    owner = document[start]
    runs = pa.StructArray.from_arrays([pa.array(start - (ends - counts)[owner]), pa.array(length), pa.array(period)], fields=list(_RUN))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
    # Texts without words get empty results.
    all_counts = np.zeros(len(column), np.int64)
    where = np.flatnonzero(filled.to_numpy(zero_copy_only=False))
    all_counts[where] = counts
    all_bounds = np.zeros(len(column) + 1, np.int64)
    all_bounds[where + 1] = np.diff(bounds)
    lists_of_runs = pa.ListArray.from_arrays(pa.array(np.cumsum(all_bounds), pa.int32()), runs)
    place = np.full(len(column), -1)
    place[where] = np.arange(len(where))
    texts = pc.fill_null(collapsed.take(pa.array(place, mask=place < 0)), "")
    return pa.StructArray.from_arrays([pa.array(all_counts), lists_of_runs, texts], names=["n_words", "runs", "collapsed"])


def periodic_runs(text: Column | str) -> Column:
    """``struct<n_words, runs array<struct<start, length, period>>, collapsed>`` of a text.

    Starts are word numbers from 0; runs are in order of start, then period. ``collapsed`` is the text, its words
    joined by one blank, without the words that a run contains behind its first period.
    """

    @F.arrow_udf(RESULT)
    def found(column: pa.Array) -> pa.Array:
        parts = [_of_group(g) for g in _groups(column.cast(pa.string()))]
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
        return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)

    return found(text)
