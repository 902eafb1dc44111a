"""Quality classifier: logistic regression on hashed word 1- and 2-grams, fitted by follow-the-regularised-leader.

A feature's value is 1 + ln(count), the vector is scaled to unit length, and a score is the sigmoid of a sparse dot
product.  Null and empty texts have no features and get the bias alone; equal texts get equal scores; without labels
every score is 0.5.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import as_bytes, bounded_sample, documents, fold, labelled, map_batches, share

BITS = 18
FIT_ROWS = 10_000  # bound on the labelled rows used for fitting
EPOCHS, ALPHA, BETA, L1, L2 = 8, 2.0, 1.0, 0.01, 0.0
CACHE = 400_000


class WordHash(dict):
    """Word -> 32-bit hash, bounded by clearing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


def features(b: bytes, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of the whole text and their scaled values."""
    words = b.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        one = h * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9) + np.uint64(1))
        two *= np.uint64(0x9E3779B97F4A7C15)
    index, count = np.unique(np.concatenate([one, two]) >> np.uint64(64 - BITS), return_counts=True)
    value = 1 + np.log(count)
    return index.astype(np.int32), (value / np.sqrt((value * value).sum())).astype(np.float32)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates, one example at a time."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            index, value = rows[k]
            zi, ni = z[index], n[index]
            w, wb = weight(zi, ni), -zb * ALPHA / (BETA + nb**0.5)
            g = 1 / (1 + np.exp(-np.clip(w @ value + wb, -30, 30))) - y[k]
            gi = g * value
            sigma = (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / ALPHA
            z[index], n[index] = zi + gi - sigma * w, ni + gi * gi
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * wb
            nb += g * g
    return weight(z, n), float(-zb * ALPHA / (BETA + nb**0.5))


def quality_model(docs: DataFrame, known: DataFrame, seed: int = 3) -> tuple[np.ndarray, float]:
    """known(doc_id, label) of the training fold; a bounded sample's features reach the driver."""

    def start():
        hashes = WordHash()

        def step(batch: pa.RecordBatch) -> dict:
            found = [features(b, hashes) for b in as_bytes(batch.column(1))]
            return {"label": batch.column(2), "doc_id": batch.column(0), "index": [x[0] for x in found], "value": [x[1] for x in found]}

        return step

    ids = bounded_sample(known.select(F.col("doc_id").cast("long").alias("doc_id"), "label"), FIT_ROWS, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    table = map_batches(rows, start, "doc_id long, label int, index array<int>, value array<float>").toArrow()
    if not table.num_rows:
        return np.zeros(1 << BITS), 0.0
    table = table.sort_by("doc_id")
    pairs = [(i.values.to_numpy(), v.values.to_numpy().astype(float)) for i, v in zip(table["index"], table["value"])]
    return fit_ftrl(pairs, table["label"].to_numpy(), seed)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    shared = share(docs.sparkSession, model)

    def start():
        (weights, bias), hashes = shared.value, WordHash()

        def score(b: bytes) -> float:
            index, value = features(b, hashes)
            return float(1 / (1 + np.exp(-np.clip(weights[index] @ value + bias, -30, 30))))

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "score": [score(b) for b in as_bytes(batch.column(1))]}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), start, "doc_id long, score double")


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, quality_model(docs, labelled(spark, sf_dir, "quality", 5)))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
