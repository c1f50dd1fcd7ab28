"""Language by the nearest of several centroids per language, in the space of TF-IDF n-gram vectors.

Vectors are hashed byte n-grams (1 to 4) of the lower-cased text with everything but letters as blanks,
weighted ``log(1 + count) * idf`` and of unit length. Each language's sample is clustered (spherical
k-means) into a few centroids. A text gets the language of the centroid with the greatest cosine and
that cosine as score; it is rejected if the cosine distance to it is over a threshold learnt per model.

A null text, and one without any letter, has language ``und``, score 0 and is rejected; so is every text
if nothing was learnt. Rows whose language is null teach nothing. Repeated rows get repeated results,
ties between centroids go to the language that sorts first, and texts of any length are read whole.
Other columns stay as they are, as the prediction is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.tokens import mixed
from velum.operators.summary import top_per_group
from velum.session import materialize

BITS = 13
#: Ids per language that are used to fit at most.
SAMPLE_ROWS = 1_000
CLUSTERS, ROUNDS = 4, 8
#: Share of the sample whose distance is within the rejection threshold.
ACCEPTED = 0.999
UNKNOWN = "und"

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and ``log(1 + count)`` of each."""
    raw = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = a.copy()
    total = np.bincount(mixed(grams, kind=1, bits=bits), minlength=1 << bits)
    for n in (2, 3, 4):
        if len(a) < n:
            break
        grams = (grams[:-1] << np.uint32(8)) | a[n - 1 :]
        total += np.bincount(mixed(grams, kind=n, bits=bits), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, np.log1p(total[at])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def clustered(vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids; the first are rows far from those before them."""
    centres = vectors[:1]
    for _ in range(1, min(clusters, len(vectors))):
        centres = np.vstack([centres, vectors[(vectors @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == k].sum(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = SAMPLE_ROWS, bits: int = BITS, clusters: int = CLUSTERS) -> dict:
    """Centroids of all languages; ``train`` is a condition on ``__key``, the id.

    Ids are drawn per language by the order of a hash, in slices, so no task meets a whole language; only
    the chosen ids, ``rows`` a language at most, are broadcast. An id that stands in several rows of a language
    counts once there, with its smallest text; texts without letters take no part. Each language is learnt in a
    task of its own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.col(text).alias("__text")).filter(
        F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}"))
    narrow = texts.filter(train).select("__key", "__lang").distinct()
    chosen = top_per_group(narrow, ["__lang"], [F.xxhash64("__key"), F.col("__key")], rows)
    sample = (
        texts.join(F.broadcast(chosen), ["__key", "__lang"])
        .groupBy("__key", "__lang")
        .agg(F.min("__text").alias("__text"))
        .select(F.xxhash64("__key").alias("__order"), "__lang", "__text")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(o, y, *counts(t, bits)) for o, y, t in zip(*(b.column(c).to_pylist() for c in ("__order", "__lang", "__text"))) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()),
                 pa.array([m[2].astype("<u4").tobytes() for m in made], pa.binary()), pa.array([m[3].astype("<f4").tobytes() for m in made], pa.binary())],
                names=["order", "lang", "at", "tf"])

    def counted(own: pa.Table) -> pa.Table:
        seen = np.zeros(1 << bits, "<i4")
        for at in own["at"].to_pylist():
            seen[np.frombuffer(at, "<u4")] += 1
        return pa.table({"rows": [len(own)], "seen": pa.array([seen.tobytes()], pa.binary())})

    def learnt(own: pa.Table) -> pa.Table:
        own = sorted(zip(*(own[c].to_pylist() for c in ("order", "at", "tf"))))
        x = np.zeros((len(own), 1 << bits), np.float32)
        for i, (_, at, tf) in enumerate(own):
            at = np.frombuffer(at, "<u4")
            x[i, at] = np.frombuffer(tf, "<f4") * sent.value[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = clustered(x, clusters)
        return pa.table({"centres": pa.array([c.astype("<f4").tobytes()], pa.binary()),
                         "within": pa.array([(x @ c.T).max(axis=1).astype("<f4").tobytes()], pa.binary())})

    made = materialize(sample.mapInArrow(hashed, "order long, lang string, at binary, tf binary"), "language-sample")
    total, seen = 0, np.zeros(1 << bits, np.int64)
    for r in made.groupBy("lang").applyInArrow(counted, "rows long, seen binary").toLocalIterator():
        total += r["rows"]
        seen += np.frombuffer(r["seen"], "<i4")
    idf = np.log((1 + total) / (1 + seen)).astype("<f4")
    sent = spark.sparkContext.broadcast(idf)

    def named(key: tuple, own: pa.Table) -> pa.Table:
        return learnt(own).add_column(0, "lang", [pa.array([key[0].as_py()], pa.string())])

    found = sorted(made.groupBy("lang").applyInArrow(named, "lang string, centres binary, within binary").collect(), key=lambda r: r["lang"])
    centres = [bytes(r["centres"]) for r in found]
    within = [np.frombuffer(bytes(r["within"]), "<f4") for r in found]
    return {
        "bits": bits, "names": [r["lang"] for r, c in zip(found, centres) for _ in range(len(c) // (4 << bits))],
        "farthest": 1.0 - float(np.quantile(np.concatenate(within), 1 - ACCEPTED)) if within else 0.0,
        "centres": b"".join(centres), "idf": idf.tobytes(),
    }


def predict(text: Column | str, model: dict, spark) -> Column:
    """``struct<lang, score, rejected>`` of a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits, names, farthest = (sent.value[k] for k in ("bits", "names", "farthest"))
        idf = np.frombuffer(sent.value["idf"], "<f4")
        centres = np.ascontiguousarray(np.frombuffer(sent.value["centres"], "<f4").reshape(-1, 1 << bits).T)
        for column in batches:
            langs, scores, rejected = [], [], []
            for t in column.to_pylist():
                lang, score = UNKNOWN, 0.0
                if t is not None and names and has_letter(t):
                    at, tf = counts(t, bits)
                    v = tf * idf[at]
                    cosines = v @ centres[at] / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(cosines.argmax())
                    lang, score = names[best], float(min(max(cosines[best], 0.0), 1.0))
                langs.append(lang)
                scores.append(score)
                rejected.append(lang == UNKNOWN or 1.0 - score > farthest)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)],
                                             ["lang", "score", "rejected"])

    return predicted(text)
