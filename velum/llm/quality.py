"""Quality by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a
linear hinge-loss model fitted by dual coordinate descent.

Indicators are the different word n-grams (1 to 2), n-grams (1 to 3) of word shapes, and patterns of
equal words among neighbours, hashed to ``2**bits`` buckets. Each text's scaled vector has unit length.

Null and empty texts have no indicator and get the score of the intercept. Repeated rows get repeated
scores and texts of any length are scored whole. Without labels the score is 0.5, with one class only
the score of that class for every text. Other columns stay as they are, as scoring is a column
expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.linear import bounded_sample
from velum.llm.tokens import WordIds, mixed, texts

BITS = 18
#: Labelled rows that are used to fit at most.
SAMPLE_ROWS = 12_000
SMOOTHING, COST, PASSES = 1.0, 1.0, 20

_CLASS = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


class Shapes(WordIds):
    """Number of a word's shape: kinds of its characters, runs counted once."""

    def __missing__(self, word: bytes) -> int:
        kinds = word.translate(_CLASS)
        shape = kinds[:1] + bytes(b for a, b in zip(kinds, kinds[1:]) if a != b)
        value = WordIds.__missing__(WordIds(), shape)
        if len(self) < self.limit:
            self[word] = value
        return value


def features(raw: bytes, ids: WordIds, shapes: Shapes, bits: int = BITS) -> np.ndarray:
    """Different buckets of a text."""
    words = raw.split()
    a, s = ids.of(words), shapes.of(words)
    parts = [mixed(a, kind=1, bits=bits), mixed(s, kind=2, bits=bits)]
    if len(words) > 1:
        parts += [mixed(a[:-1], a[1:], kind=3, bits=bits), mixed(s[:-1], s[1:], kind=4, bits=bits)]
    if len(words) > 2:
        parts.append(mixed(s[:-2], s[1:-1], s[2:], kind=5, bits=bits))
    if len(words) > 3:
        equal = [(a[:-3] == a[k : len(a) - 3 + k]).astype(np.uint32) << np.uint32(k) for k in (1, 2, 3)]
        parts.append(mixed(np.unique(equal[0] | equal[1] | equal[2]), kind=6, bits=bits))
    return np.unique(np.concatenate(parts))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """``log((p / |p|) / (q / |q|))`` of the smoothed indicator counts of both classes; 0 where no row has the bucket."""
    counts = [np.zeros(size), np.zeros(size)]
    for at, y in zip(rows, labels):
        counts[y][at] += 1
    q, p = (c + smoothing for c in counts)
    return np.where(counts[0] + counts[1] > 0, np.log((p / p.sum()) / (q / q.sum())), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, signs: np.ndarray, cost: float = COST,
                            passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise ``|w|^2 / 2 + cost * sum of hinge losses`` over unit vectors with a constant 1.

    Each step solves the dual for one row's multiplier, kept between 0 and the cost; rows are visited
    in a new order each pass.
    """
    w, b = np.zeros(len(ratios)), 0.0
    values = [ratios[at] / max(np.sqrt((ratios[at] ** 2).sum()), 1e-12) for at in rows]
    lengths = [float(v @ v) + 1.0 for v in values]
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v, y = rows[i], values[i], signs[i]
            gradient = y * (float(w[at] @ v) + b) - 1.0
            new = min(max(alpha[i] - gradient / lengths[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                w[at] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = SAMPLE_ROWS, bits: int = BITS) -> dict:
    """Ratios and weights of all buckets, and the intercept.

    ``train`` is a condition on ``__key``, the id. At most ``rows`` texts are used: indicators are made
    where the texts are read, and one task learns from their packed buckets.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shapes = WordIds(), Shapes()
        for b in batches:
            packed = [features(t, ids, shapes, bits).astype("<u4").tobytes() for t in texts(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([b.column("__order"), b.column("__label"), pa.array(packed, pa.binary())],
                                             names=["order", "label", "packed"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, int(y > 0), p) for b in batches for o, y, p in zip(*(c.to_pylist() for c in b.columns)))
        at, y = [np.frombuffer(p, "<u4") for _, _, p in rows], np.array([y for _, y, _ in rows], np.int64)
        if len(set(y.tolist())) == 2:
            ratios = log_count_ratios(at, y, 1 << bits)
            w, b = dual_coordinate_descent(at, ratios, 2.0 * y - 1)
        else:
            ratios, w = np.zeros(1 << bits), np.zeros(1 << bits)
            b = 0.0 if not len(y) else 1.0 if y[0] else -1.0
        yield pa.RecordBatch.from_arrays(
            [pa.array([ratios.astype("<f4").tobytes()]), pa.array([w.astype("<f4").tobytes()]), pa.array([float(b)])],
            names=["ratios", "weights", "intercept"])

    sample = bounded_sample(docs, labels, train, key=key, text=text, label=label, rows=rows)
    packed = sample.mapInArrow(hashed, "order long, label int, packed binary")
    made = packed.repartition(1).mapInArrow(learnt, "ratios binary, weights binary, intercept double").first()
    return {"bits": bits, "ratios": bytes(made["ratios"]), "weights": bytes(made["weights"]), "intercept": made["intercept"]}


def score(text: Column | str, model: dict, spark) -> Column:
    """How sure the model is of good quality: the logistic curve of twice the margin."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = sent.value["bits"]
        r = np.frombuffer(sent.value["ratios"], "<f4")
        product, squares = r * np.frombuffer(sent.value["weights"], "<f4"), r * r
        ids, shapes = WordIds(), Shapes()
        for column in batches:
            margins = np.empty(len(column))
            for i, raw in enumerate(texts(column)):
                at = features(raw, ids, shapes, bits)
                margins[i] = product[at].sum(dtype=np.float64) / max(np.sqrt(squares[at].sum(dtype=np.float64)), 1e-12)
            yield pa.array(1.0 / (1.0 + np.exp(np.clip(-2.0 * (margins + sent.value["intercept"]), -35, 35))))

    return scored(text)
