"""Quality rules: text statistics, fixed rules, and isolation forests over the statistics.

Nulls and empty texts have zero words and fail the base rule; equal rows get equal results; an empty table gives an
empty result; an empty label table leaves the thresholds at ``DEFAULT_THRESHOLD``.  Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import as_bytes, map_batches, share, stage

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW = 8
MIN_WORDS = 20
TREES, SUBSAMPLE, DEPTH = 64, 256, 10
CLEAN_COST = 10.0  # bad rows that must be caught for each good row given up
SINGLE_TREES = 24
DEFAULT_THRESHOLD = 0.8
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "distinct_share")
FIT_ROWS = (TREES + SINGLE_TREES * len(FEATURES)) * SUBSAMPLE  # every tree's own rows
BINS = 256  # of scores: a forest's labelled scores are sorted apart
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{x} double" for x in FEATURES)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (ids[j : j + n] ^ (ids[j : j + n] << np.uint64(29)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    starts = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(starts):
        return 0
    # windows of one hash are compared word by word
    _, which, times = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts], axis=0, return_inverse=True, return_counts=True)
    starts = starts[times[which.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(b: bytes) -> tuple:
    words = b.split()
    n, dense = len(words), b.translate(None, b" \t\n\x0b\x0c\r")
    chars = len(dense.decode("utf-8", "surrogatepass"))
    symbols = len(dense) - len(dense.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup, repeat = len(lines) - len(set(lines)), repeat_words(words)
    c, k = max(chars, 1), max(n, 1)
    upper, shout = len(dense) - len(dense.translate(None, UPPER)), dense.count(b"!")
    return n, chars, symbols, dup, repeat, math.log1p(n), chars / k, symbols / c, dup / max(len(lines), 1), repeat / k, upper / c, shout / c, len(set(words)) / k


def rule_stats(docs: DataFrame) -> DataFrame:
    """One row of statistics a document; a map, no exchange."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            rows = [text_stats(b) for b in as_bytes(batch.column(1))]
            names = [x.split()[0] for x in STATS.split(", ")][1:]
            return {"doc_id": batch.column(0)} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, STATS)


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random axis-parallel splits on subsamples; short mean paths mark anomalies (scores near 1).

    Trees grow from rows of their own if there are enough, else from draws out of all rows.
    """

    def __init__(self, x: np.ndarray, seed: int = 7, trees: int = TREES):
        rng = np.random.default_rng(seed)
        size = min(SUBSAMPLE, len(x))
        self.norm = max(average_path(size), 1e-9)
        own = len(x) >= size * trees
        self.trees = [self._grow(x[t * size : (t + 1) * size] if own else x[rng.choice(len(x), size, replace=False)], rng) for t in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple:
        feature, cut, child, value, todo = [], [], [], [], []

        def new() -> int:
            for a, v in ((feature, -1), (cut, 0.0), (child, 0), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        todo.append((new(), x, 0))
        while todo:
            node, rows, depth = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            varied = np.flatnonzero(high > low)
            if depth >= DEPTH or len(rows) < 2 or not len(varied):
                value[node] = depth + average_path(len(rows))
                continue
            f = int(rng.choice(varied))
            feature[node], cut[node] = f, float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < cut[node]
            child[node] = new()
            new()  # the right child follows the left one
            todo += [(child[node], rows[left], depth + 1), (child[node] + 1, rows[~left], depth + 1)]
        return np.array(feature), np.array(cut), np.array(child), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, child, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, child[at] + (x[rows, np.maximum(f, 0)] >= cut[at]))
            total += value[at]
        return np.power(2.0, -total / (len(self.trees) * self.norm))


def _bin_cut(part: pa.Table) -> pa.Table:
    """Of a forest's scores in one bin, from the highest: the gain of all, the best gain of a cut, and where it lies."""
    score = part.column("score").to_numpy()
    order = np.argsort(-score)
    s, good, bad = score[order], part.column("good").to_numpy()[order], part.column("bad").to_numpy()[order]
    gain = np.cumsum(bad - CLEAN_COST * good)
    k = int(np.argmax(gain))
    row = {"forest": part.column("forest")[0].as_py(), "top": s[0], "good": good.sum(), "bad": bad.sum(), "gain": gain[-1], "best": gain[k], "at": s[k], "below": s[k + 1] if k + 1 < len(s) else None}
    return pa.Table.from_pylist([row], pa.schema([("forest", pa.int32()), ("top", pa.float64()), ("good", pa.int64()), ("bad", pa.int64()), *((n, pa.float64()) for n in ("gain", "best", "at", "below"))]))


def calibrate(scored: DataFrame) -> dict[int, float]:
    """scored(forest, score, good, bad: rows) -> each forest's threshold.

    It has the best balance of bad rows caught against CLEAN_COST times the good rows given up, over all rows.  At a tie
    the highest; infinite if no threshold is worth its losses; none unless there are good and bad rows.
    """
    scores = scored.groupBy("forest", "score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    found = scores.groupBy("forest", F.floor(F.col("score") * BINS)).applyInArrow(_bin_cut, "forest int, top double, good long, bad long, gain double, best double, at double, below double").collect()
    out = {}
    for forest in {r.forest for r in found}:
        rows = sorted((r for r in found if r.forest == forest), key=lambda r: -r.top)
        if not sum(r.good for r in rows) or not sum(r.bad for r in rows):
            continue
        gain, best, out[forest] = 0.0, 0.0, math.inf
        for r, after in zip(rows, [*rows[1:], None]):
            if gain + r.best > best:
                best, below = gain + r.best, r.below if r.below is not None else after and after.top
                out[forest] = (r.at + below) / 2 if below is not None else r.at - 1e-9
            gain += r.gain
    return out


def fit_rows(usable: DataFrame, seed: int) -> np.ndarray:
    """The statistics of FIT_ROWS rows, those with the least seeded hash, or of all."""
    rows = usable.select(*FEATURES, F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), *FEATURES).alias("hash"))
    number = usable.count()
    if number > 2 * FIT_ROWS:  # far rows stay where they are
        near = rows.where(F.col("hash") < -(2**63) + int(2**64 * 1.2 * FIT_ROWS / number))
        rows = near if near.count() >= FIT_ROWS else rows
    return rows.orderBy("hash", *FEATURES).limit(FIT_ROWS).select(*FEATURES).toPandas().to_numpy(float)


class RuleForests:
    """One forest over all statistics and one for each of them, each with a threshold of its own.

    The joint forest finds odd combinations; a single statistic's forest is not diluted by the spread of the others.
    """

    def __init__(self, x: np.ndarray, seed: int):
        self.columns = [list(range(x.shape[1])), *([i] for i in range(x.shape[1]))]
        trees = [TREES] + [SINGLE_TREES] * x.shape[1]
        ends = np.cumsum(trees) * SUBSAMPLE
        rows = [x[e - t * SUBSAMPLE : e] if len(x) >= ends[-1] else x for e, t in zip(ends, trees)]
        self.forests = [IsolationForest(r[:, c], seed + k, t) for k, (r, c, t) in enumerate(zip(rows, self.columns, trees))]
        self.thresholds = [DEFAULT_THRESHOLD] * len(self.forests)

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.round(f.score(x[:, c]), 12) for f, c in zip(self.forests, self.columns)]

    def excess(self, x: np.ndarray) -> np.ndarray:
        """How far the most anomalous forest's score is above its threshold; at most 0 for documents to keep."""
        return np.max([np.maximum(s - t, -1.0) for s, t in zip(self.scores(x), self.thresholds)], axis=0)


def labelled_scores(known: DataFrame, forests) -> DataFrame:
    """known(*FEATURES, quality) -> forest, score, good, bad: rows of a score in a batch."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1)
            good = batch.column(len(FEATURES)).to_numpy(zero_copy_only=False) == 1
            out: dict = {"forest": [], "score": [], "good": [], "bad": []}
            for k, scores in enumerate(forests.value.scores(x)):
                score, of = np.unique(scores, return_inverse=True)
                out["forest"].append(np.full(len(score), k))
                out["score"].append(score)
                out["good"].append(np.bincount(of, good, len(score)).astype(np.int64))
                out["bad"].append(np.bincount(of, ~good, len(score)).astype(np.int64))
            return {k: np.concatenate(v) for k, v in out.items()}

        return step

    return map_batches(known, start, "forest int, score double, good long, bad long")


def quality_rules(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> statistics, base_failed, anomaly, kept, one row a document.

    Every tree grows from SUBSAMPLE documents of its own, as the method has it: FIT_ROWS rows of statistics reach the
    driver.  Every labelled document counts for the thresholds; statistics and scores cover every document.
    """
    spark = docs.sparkSession
    stats = stage(rule_stats(docs))
    usable = stats.where(~base_failed())
    sample = fit_rows(usable, seed)
    forests = RuleForests(sample, seed) if len(sample) else None
    if forests:
        chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        for k, threshold in calibrate(labelled_scores(usable.join(chosen, "doc_id").select(*FEATURES, "quality"), share(spark, forests))).items():
            forests.thresholds[k] = threshold
    model = share(spark, forests)
    names = [x.split()[0] for x in STATS.split(", ")]

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            x = np.stack([batch.column(names.index(f)).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            return {n: batch.column(i) for i, n in enumerate(names[:6])} | {"anomaly": model.value.excess(x) if model.value else np.full(len(x), -1.0)}

        return step

    schema = ", ".join(STATS.split(", ")[:6]) + ", anomaly double"
    return map_batches(stats, start, schema).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= 0))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def op3_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
