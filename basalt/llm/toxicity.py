"""Toxicity by non-negative positive-unlabelled learning.

A word's features are hashes: the word itself, and of its bytes, closed by a mark on either side, the 4- to 6-grams and
the beginnings of 7 to 9, so inflected insults share weight with their stem.  A document's value of a feature is how often it
occurs, over the square root of the number of words: a stem that a long text has once by chance counts little.

1. Features are chosen by a log-likelihood ratio between confirmed toxic rows and a mixture of labelled rows (their
   labels unread); both samples of labelled rows are bounded by parameters.
2. Weights minimise the non-negative PU risk: the toxic rows against ALL texts of the training fold, taken as
   unlabelled and corrected by the class prior.  The texts are dealt into blocks of bounded size; each block is fitted
   in a task against the same toxic rows, and the blocks' weights are averaged by their number of texts.
3. A score is the sigmoid of bias plus weights times values; the PU risk is corrected by the prior, so one half is
   where toxic and other texts are equally likely, without a later calibration.

Null and empty texts get the bias; equal texts get equal scores; repeated rows are scored (and, in the fit, counted)
each; without any toxic label, or without a feature that tells toxic rows apart, every score is the prior (0 without
labels); an empty table gives an empty result.  Columns other than doc_id and text are ignored by scores; the stage
passes them through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from basalt.llm.common import as_bytes, bounded_sample, documents, fold, labelled, map_batches, map_stream, share, stage

BITS = 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
LONGEST, PART = 9, 1 << 18  # bytes of the longest gram; bytes that are hashed at once
POSITIVE_ROWS, MIXED_ROWS = 6_000, 6_000  # bounds on the labelled rows used: toxic ones, and any (label unread)
LEAST_RATIO, MOST_FEATURES = 8.0, 4_096  # log-likelihood ratio that makes a feature; size of the model
BLOCK = 8_192  # unlabelled texts that are fitted in one task
STEPS, RATE, L2 = 100, 0.1, 3e-3
OFFSET = 10.0  # words added before the square root
CACHE = 300_000
PUNCTUATION = b".,;:!?*#$%&|<>\"'()"
NOTHING = np.zeros(0, np.int32)


def word_features(tokens: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in tokens, hashed feature) of every feature of the tokens, in parts of bounded size, however long a token.

    Outer punctuation of a token does not count; a token of punctuation alone has no features.
    """
    words = [t.strip(PUNCTUATION) for t in tokens]
    some = np.array([k for k, w in enumerate(words) if w], np.int64)
    if not len(some):
        return
    yield some, np.array([zlib.crc32(words[k]) for k in some.tolist()], np.uint64) * GOLD >> np.uint64(64 - BITS)
    size = np.array([len(words[k]) + 2 for k in some.tolist()], np.int64)
    end = np.cumsum(size)
    joined = np.frombuffer(b"".join(b"^" + words[k] + b"$" for k in some.tolist()) + bytes(LONGEST), np.uint8)
    for a in range(0, end[-1], PART):
        part = joined[a : a + PART + LONGEST].astype(np.uint64)
        n = min(PART, end[-1] - a)
        of = np.searchsorted(end, np.arange(a, a + n), side="right")
        room, first = end[of] - np.arange(a, a + n), end[of] - size[of] == np.arange(a, a + n)
        h = np.zeros(n, np.uint64)
        for k in range(1, LONGEST + 1):
            h = h * np.uint64(0x100000001B3) + part[k - 1 : k - 1 + n]
            if k >= 4:
                at = np.flatnonzero((room >= k) & (first if k > 6 else True))
                yield some[of[at]], (h[at] ^ np.uint64(k)) * GOLD >> np.uint64(64 - BITS)


class WordTable(dict):
    """Token -> value, learnt a batch at a time; ``compute(tokens)`` gives the values of new tokens.  Bounded by clearing."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def learn(self, texts: list[list[bytes]]) -> None:
        """Have all tokens of texts, until the next call."""
        if len(self) > CACHE:
            self.clear()
        new = list(set().union(*texts) - self.keys())
        self.update(zip(new, self.compute(new)))


def row_counts(rows: DataFrame) -> DataFrame:
    """rows(text, positive) -> (feature, positive_rows, mixed_rows): in how many rows of either kind a feature occurs.

    Feature -1 counts the rows.  Tasks count before they send.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, last = np.zeros((2, (1 << BITS) + 1), np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                texts = [list(set(b.lower().split())) for b in as_bytes(batch.column(0)[a : a + 128])]
                words = list(set().union(*texts))
                owner, feature = (np.concatenate(x) for x in zip(*word_features(words), (np.zeros(0, np.int64), np.zeros(0, np.uint64))))
                order = np.argsort(owner, kind="stable")
                feature, begin = feature[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))
                place = {w: k for k, w in enumerate(words)}
                for text, kind in zip(texts, batch.column(1)[a : a + 128].to_pylist()):
                    at = [place[w] for w in text]
                    f = np.concatenate([feature[begin[k] : begin[k + 1]] for k in at]) if at else feature[:0]
                    last[f] = np.arange(len(f))  # of a feature's places in the text the last one stays
                    total[0 if kind else 1, f[last[f] == np.arange(len(f))]] += 1
                    total[0 if kind else 1, -1] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield {"feature": np.where(some == 1 << BITS, -1, some), "positive_rows": total[0, some], "mixed_rows": total[1, some]}

    counts = map_stream(rows.select("text", "positive"), count, "feature int, positive_rows long, mixed_rows long")
    return counts.groupBy("feature").agg(F.sum("positive_rows").alias("positive_rows"), F.sum("mixed_rows").alias("mixed_rows"))


def choose(positive: np.ndarray, n_positive: int, mixed: np.ndarray, n_mixed: int) -> np.ndarray:
    """The features, ascending, whose share of toxic rows is above that of mixed rows by LEAST_RATIO at least."""
    a, b = (positive + 0.5) / (n_positive + 1), (mixed + 0.5) / (n_mixed + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where((a > b) & (positive >= 2), n_positive * (a * np.log(a / b) + (1 - a) * np.log((1 - a) / (1 - b))), 0.0)
    best = np.argsort(-ratio, kind="stable")[:MOST_FEATURES]
    return np.sort(best[ratio[best] > LEAST_RATIO]).astype(np.int32)


def vectors(rows: DataFrame, live: np.ndarray) -> DataFrame:
    """rows(positive, text) -> (positive, index, value): each text's chosen features and their values; a map."""
    shared = share(rows.sparkSession, live)

    def start():
        place = np.full(1 << BITS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))

        def compute(tokens: list[bytes]) -> list[np.ndarray | None]:
            out: list[np.ndarray | None] = [None] * len(tokens)
            parts = [(o[place[f] >= 0], place[f][place[f] >= 0]) for o, f in word_features(tokens)]
            if parts:
                owner, index = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(owner, kind="stable")
                owner, index = owner[order], index[order]
                cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    out[owner[i]] = index[i:j]
            return out

        table = WordTable(compute)

        def step(batch: pa.RecordBatch) -> dict:
            index, value = [], []
            texts = [b.lower().split() for b in as_bytes(batch.column(1))]
            table.learn(texts)
            for tokens in texts:
                found = [at for at in map(table.__getitem__, tokens) if at is not None]
                i, n = np.unique(np.concatenate(found), return_counts=True) if found else (NOTHING, NOTHING)
                index.append(i.astype(np.int32))
                value.append((n / np.sqrt(len(tokens) + OFFSET)).astype(np.float32))
            return {"positive": batch.column(0), "index": index, "value": value}

        return step

    return map_batches(rows.select("positive", "text"), start, "positive boolean, index array<int>, value array<float>")


def risk_gradient(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative PU risk (logistic loss) of the logits and its slope in each of them.

    Rows that are not positive are unlabelled.  Where the estimated risk of negatives is below 0, it counts as 0 and
    the slope is that which raises it again.
    """
    n_p, n_u = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    negative = np.logaddexp(0, f[~positive]).sum() / n_u - prior * np.logaddexp(0, f[positive]).sum() / n_p
    slope = np.where(positive, -prior * p / n_p, p / n_u)
    if negative < 0:
        return float(prior * np.logaddexp(0, -f[positive]).sum() / n_p), -slope
    return float(prior * np.logaddexp(0, -f[positive]).sum() / n_p + negative), slope + np.where(positive, prior * (p - 1) / n_p, 0)


def fit_nnpu(doc: np.ndarray, index: np.ndarray, value: np.ndarray, positive: np.ndarray, prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and a bias, by full-batch Adam; entry k says that row doc[k] has value[k] of index[k]."""
    square = lambda of: np.bincount(index[of], value[of] ** 2, minlength=size)
    n_p, n_u = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    mine = positive[doc]
    scale = 0.3 / (np.sqrt((square(~mine) / n_u + prior * square(mine) / n_p) / 2) + 1e-9)
    x = value * scale[index]
    theta = np.append(np.zeros(size), np.log(prior / (1 - prior)) if prior < 1 else 0.0)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        f = np.bincount(doc, x * theta[index], minlength=len(positive)) + theta[-1]
        _, d = risk_gradient(f, positive, prior)
        g = np.append(np.bincount(index, x * d[doc], minlength=size) + L2 * theta[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (1 - 0.9 * t / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-1] * scale, float(theta[-1])


def _flat(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of every entry of a table of vectors."""
    index, value = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("index"), table.column("value")))
    row = np.repeat(np.arange(len(index)), np.diff(index.offsets.to_numpy()))
    return row, index.flatten().to_numpy(), value.flatten().to_numpy().astype(float)


def toxicity_model(spark: SparkSession, docs: DataFrame, known: DataFrame, divisor: int = 5, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """docs(doc_id, text), known(doc_id, label) of the training fold -> (features, weights, bias)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    total = known.agg(F.count("*"), F.sum("label")).first()
    n, toxic = total[0] or 0, total[1] or 0
    if not toxic:
        return NOTHING, np.zeros(0), -30.0
    prior = min(toxic / n, 0.999)
    nothing = NOTHING, np.zeros(0), float(np.log(prior / (1 - prior)))
    toxic_ids, any_ids = bounded_sample(known.where("label = 1"), POSITIVE_ROWS, seed), bounded_sample(known, MIXED_ROWS, seed + 1)
    ids = toxic_ids.select("doc_id", F.lit(True).alias("positive")).union(any_ids.select("doc_id", F.lit(False)))
    # (at most POSITIVE_ROWS + MIXED_ROWS numbers)
    counts = row_counts(docs.join(F.broadcast(ids), "doc_id")).toArrow().to_pandas()
    of_rows = counts[counts.feature < 0]
    dense = np.zeros((2, 1 << BITS))
    counts = counts[counts.feature >= 0]
    dense[:, counts.feature] = counts[["positive_rows", "mixed_rows"]].to_numpy().T
    live = choose(dense[0], int(of_rows.positive_rows.sum()), dense[1], int(of_rows.mixed_rows.sum()))
    if not len(live):
        return nothing
    flagged = docs.where(fold(divisor) != 0).join(F.broadcast(toxic_ids.select("doc_id", F.lit(True).alias("positive"))), "doc_id", "left")
    pool = stage(vectors(flagged, live).select("index", "value", "positive", F.rand(seed).alias("deal")))
    confirmed, texts_in = pool.where("positive").select("index", "value").toArrow(), pool.count()
    if not confirmed.num_rows:
        return nothing
    shared = share(spark, (_flat(confirmed), confirmed.num_rows))
    size = len(live)

    def block(part: pa.Table) -> pa.Table:
        (doc, index, value), n_p = shared.value
        row, i, v = _flat(part)
        positive = np.arange(n_p + part.num_rows) < n_p
        weights, bias = fit_nnpu(np.concatenate([doc, row + n_p]), np.concatenate([index, i]), np.concatenate([value, v]), positive, prior, size)
        return pa.table({"feature": np.arange(size + 1, dtype=np.int32), "total": np.append(weights, bias) * part.num_rows})

    blocks = -(-texts_in // BLOCK)
    dealt = pool.withColumn("block", F.floor(F.col("deal") * blocks)).select("block", "index", "value")
    fitted = dealt.groupBy("block").applyInArrow(block, "feature int, total double").groupBy("feature").agg(F.sum("total").alias("total")).toArrow()
    mean = np.zeros(size + 1)
    mean[fitted.column("feature").to_numpy()] = fitted.column("total").to_numpy() / texts_in
    return live, mean[:-1], float(mean[-1])


def score_toxicity(docs: DataFrame, model: tuple) -> DataFrame:
    """Every column of docs (text and others) plus ``toxicity`` (0 to 1); a map, no exchange."""
    shared = share(docs.sparkSession, model)

    def start():
        live, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[live] = weights

        def compute(tokens: list[bytes]) -> list[float]:
            total = np.zeros(len(tokens))
            for owner, feature in word_features(tokens):
                total += np.bincount(owner, dense[feature], minlength=len(tokens))
            return total.tolist()

        scores = WordTable(compute)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [b.lower().split() for b in as_bytes(batch.column(batch.schema.get_field_index("text")))]
            scores.learn(texts)
            f = np.array([bias + sum(map(scores.__getitem__, tokens)) / np.sqrt(len(tokens) + OFFSET) for tokens in texts])
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            return out | {"toxicity": 1 / (1 + np.exp(-np.clip(f, -30, 30)))}

        return step

    return map_batches(docs, start, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))


def op4_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_model(spark, docs, labelled(spark, sf_dir, "toxic", 5))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose toxicity is under one half, all columns kept."""
    model = toxicity_model(spark, docs.select("doc_id", "text"), labelled(spark, sf_dir, "toxic", 5))
    own = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return score_toxicity(own, model).where(F.col("toxicity") < 0.5).select("row.*")
