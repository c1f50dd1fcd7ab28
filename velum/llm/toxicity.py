"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the different words, word pairs, and pairs with one or two words between them, hashed
to ``2**bits`` buckets. Learning rates are kept per coordinate; the L1 term leaves most weights at
zero, so the model that is sent to the executors is a short list of buckets and weights, bounded by
the number of buckets.

Null and empty texts have only the intercept and get its score, as any text without a known feature.
Repeated rows get repeated scores, texts of any length are scored whole, and a missing training set
(no labels, or one class only) gives the share of toxic labels, 0 without labels. Other columns stay
as they are, as scoring is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.linear import bounded_sample
from velum.llm.tokens import ALNUM, WordIds, each_text, mixed, texts

BITS = 20
#: Labelled rows that are used to fit at most; a model of this kind gains nothing from more.
SAMPLE_ROWS = 16_384
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 12.0, 1.0, 4
SKIPS = 2


def features(raw: bytes, ids: WordIds, bits: int = BITS) -> np.ndarray:
    """Buckets of all n-grams and skip-grams, repeats included."""
    a = ids.of(raw.translate(ALNUM).split())
    parts = [mixed(a, kind=1, bits=bits)]
    parts += [mixed(a[:-gap], a[gap:], kind=1 + gap, bits=bits) for gap in range(1, 2 + SKIPS) if len(a) > gap]
    return np.concatenate(parts)


class Ftrl:
    """FTRL-proximal state: ``z`` and ``n`` per coordinate; coordinate 0 of ``intercept`` has no penalty."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.z0 = self.n0 = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def intercept(self) -> float:
        return -self.z0 / ((self.beta + np.sqrt(self.n0)) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, w0 = self.weights(at), self.intercept()
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.z0 += g - (np.sqrt(self.n0 + g * g) - np.sqrt(self.n0)) / self.alpha * w0
        self.n0 += g * g


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = SAMPLE_ROWS, bits: int = BITS) -> dict:
    """Weights of the buckets that are not zero, and the intercept.

    ``train`` is a condition on ``__key``, the id. At most ``rows`` texts are used: features are made
    where the texts are read, and one task learns from their packed buckets.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            packed = [np.unique(features(t, ids, bits)).astype("<u4").tobytes() for t in texts(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([b.column("__order"), b.column("__label"), pa.array(packed, pa.binary())],
                                             names=["order", "label", "packed"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, y, p) for b in batches for o, y, p in zip(*(c.to_pylist() for c in b.columns)))
        model, share = Ftrl(1 << bits), sum(y for _, y, _ in rows) / len(rows) if rows else 0.0
        both = 0.0 < share < 1.0
        for _ in range(PASSES if both else 0):
            for _, y, p in rows:
                model.learn(np.frombuffer(p, "<u4"), y)
        at = np.flatnonzero(np.abs(model.z) > model.l1)
        w0 = model.intercept() if both else np.log((share + 1e-9) / (1 - share + 1e-9))
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.astype("<u4").tobytes()]), pa.array([model.weights(at).astype("<f4").tobytes()]), pa.array([float(w0)])],
            names=["at", "weights", "intercept"])

    sample = bounded_sample(docs, labels, train, key=key, text=text, label=label, rows=rows)
    packed = sample.mapInArrow(hashed, "order long, label int, packed binary")
    made = packed.repartition(1).mapInArrow(learnt, "at binary, weights binary, intercept double").first()
    return {"bits": bits, "at": bytes(made["at"]), "weights": bytes(made["weights"]), "intercept": made["intercept"]}


def score(text: Column | str, model: dict) -> Column:
    """Probability that a text is toxic."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.zeros(1 << model["bits"], np.float32)
        weights[np.frombuffer(model["at"], "<u4")] = np.frombuffer(model["weights"], "<f4")
        ids = WordIds()
        for column in batches:
            sums = np.full(len(column), model["intercept"])
            for i, raw in enumerate(each_text(column)):
                at = features(raw, ids, model["bits"])
                at = np.unique(at[weights[at] != 0])
                sums[i] += weights[at].sum(dtype=np.float64)
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))

    return scored(text)
