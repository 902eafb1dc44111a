"""Best-fit packing by linear grouping.

Documents become token ids and then pieces of at most ``capacity`` ids.  The packing is planned on the histogram of
piece lengths, which has at most ``capacity`` entries whatever the corpus: large lengths are rounded up within groups
of equal cardinality, a column-generation LP finds the configurations of the few rounded sizes, real lengths take
the places of rounded ones (all but a configuration's smallest), and what is left is put best-fit, longest first,
into the gaps.  Bins of like content
are one run, so the plan has some thousands of runs at any size.  Pieces then find their place by their rank within
their length.

Null and empty texts are one piece of one id (0); equal texts give equal ids; repeated rows are packed each; an
empty table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from basalt.llm.common import as_bytes, documents, map_batches, process_cache, share, stage

CAPACITY = 2048
GROUPS = 64
LARGE = 8  # a length over capacity / LARGE is large
RANK_ROWS = 20_000  # pieces of one length that one window partition holds on average
CACHE = 700_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Word -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in a row.  Two
    generations of at most CACHE words are kept: what a batch needs is carried over, what none has needed goes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The table that has all of words, until the next call."""
        if len(self.now) > CACHE:
            self.before, self.now = self.now, {}
        new = []
        for w in words - self.now.keys():
            ids = self.before.get(w)
            if ids is None:
                new.append(w)
            else:
                self.now[w] = ids
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)):
                ids = array("I", e.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                self.now[w] = ids.tobytes()
        return self.now


def split_words(b: bytes) -> list[bytes]:
    """Words, ASCII ones in lower case (the tokenizer's own normal form), unless a special token's mark makes case matter.

    Words with other letters stay as they are: the tokenizer composes letters and marks before it folds case.
    """
    if b"<|" in b:
        return b.split()
    if b.isascii():
        return b.lower().split()
    return [w.lower() if w.isascii() else w for w in b.split()]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> one row a piece; a map, no exchange."""
    path, step_bytes = path or tokenizer_path(), 4 * capacity

    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = process_cache(("word ids", path), lambda: WordIds(path))

        def step(batch: pa.RecordBatch) -> dict:
            texts = [split_words(b) for b in as_bytes(batch.column(1))]
            table = ids.learn(set().union(*map(set, texts)))
            out: dict[str, list] = {x.split()[0]: [] for x in PIECES.split(", ")}
            for doc_id, words in zip(batch.column(0).to_pylist(), texts):
                data = b"".join(map(table.__getitem__, words)) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), step_bytes)):
                    part = data[at : at + step_bytes]
                    for name, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
            return out

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), start, PIECES)


# ---------------------------------------------------------------------------------------------- plan


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """Column generation for the few rounded sizes: (bins, items of each size) that cover the demand with least bins."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        dual = inverse.sum(axis=0)
        # best configuration by dual value: layers by number of items, over all capacities at once
        value, layers = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):
            trial = np.full((k, capacity + 1), -1.0)
            for g, s in enumerate(sizes):
                trial[g, s:] = value[: capacity + 1 - s] + dual[g]
            pick = trial.argmax(axis=0)
            better = trial[pick, np.arange(capacity + 1)]
            layers.append(np.where(better > value + 1e-12, pick, -1))
            value = np.maximum(value, better)
        if value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(layers):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= int(sizes[pick[room]])
        direction, x = inverse @ column, inverse @ demand
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    x = np.linalg.solve(basis, demand)
    return [(float(n), basis[:, j].astype(int)) for j, n in enumerate(x)]


class Bins:
    """Runs of bins alike: (bins, lengths in order) by room left; best-fit insertion of many items of one length."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, [[] for _ in range(capacity + 1)]

    def add(self, bins: int, lengths: tuple[int, ...]) -> None:
        if bins:
            self.by_room[self.capacity - sum(lengths)].append((bins, lengths))

    def insert(self, length: int, count: int) -> None:
        room = length
        while count and room <= self.capacity:
            if not self.by_room[room]:
                room += 1
                continue
            bins, lengths = self.by_room[room].pop()
            used = min(count, bins)
            if used < bins:
                self.by_room[room].append((bins - used, lengths))
            self.add(used, (*lengths, length))
            count -= used
            if room - length >= length:
                room = length
        per = self.capacity // length
        self.add(count // per, (length,) * per)
        self.add(int(count % per > 0), (length,) * (count % per))

    def runs(self) -> list[tuple[int, tuple[int, ...]]]:
        return [r for at in self.by_room for r in at]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (bins, lengths of each of their bins) that hold the histogram exactly."""
    bins, left = Bins(capacity), {n: c for n, c in histogram.items() if c}
    bins.add(left.pop(capacity, 0), (capacity,))
    large = sorted((n for n in left if n * LARGE > capacity), reverse=True)
    total = sum(left[n] for n in large)
    if total >= 4 * groups:
        # queues[g]: real (length, count) of group g, longest first; its rounded size is its first length
        quota, queues, fill = -(-total // groups), [[]], 0
        for n in large:
            c = left[n]
            while c:
                if fill == quota:
                    queues.append([])
                    fill = 0
                take = min(c, quota - fill)
                queues[-1].append([n, take])
                c, fill = c - take, fill + take
        merged: list[list] = []
        for q in queues:  # groups that round to one size are one
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1] += q
            else:
                merged.append(q)
        queues = merged
        demand = np.array([sum(c for _, c in q) for q in queues], float)
        for amount, column in configurations(np.array([q[0][0] for q in queues]), demand, capacity):
            if column.sum() > 1:  # the room of a configuration's smallest item is left to best-fit, which sees real lengths
                column = column.copy()
                column[np.flatnonzero(column)[-1]] -= 1
            slots = [g for g, times in enumerate(column) for _ in range(times)]
            have = [sum(c for _, c in q) for q in queues]
            number = min([int(amount + 1e-6), *(have[g] // int(column[g]) for g in set(slots))])
            while number:
                # as many bins as keep one real length in every slot
                # (one bin of mixed lengths where a group's next length runs out)
                take = max(1, min([number, *(queues[g][0][1] // int(column[g]) for g in set(slots))]))
                lengths = []
                for g in dict.fromkeys(slots):
                    for _ in range(int(column[g])):
                        lengths.append(queues[g][0][0])
                        queues[g][0][1] -= take
                        if not queues[g][0][1]:
                            queues[g].pop(0)
                bins.add(take, tuple(sorted(lengths, reverse=True)))
                number -= take
        rest: dict[int, int] = {}
        for q in queues:
            for n, c in q:
                rest[n] = rest.get(n, 0) + c
        left = {n: c for n, c in left.items() if n * LARGE <= capacity} | rest
    for n in sorted(left, reverse=True):
        bins.insert(n, left[n])
    return bins.runs()


def places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, items a bin, first sequence, offset of the first item), by rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, lengths in runs:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            times = lengths.count(n)
            out.setdefault(n, []).append((used.get(n, 0), times, sequence, offset))
            used[n] = used.get(n, 0) + bins * times
            offset += times * n
        sequence += bins
    return {n: np.array(v, np.int64) for n, v in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with columns doc_id, piece, length, ids_crc32 (others pass) -> the same with sequence_id and offset.

    The driver gets the histogram of lengths, at most ``capacity`` rows.
    """
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = share(spark, places(plan(histogram, capacity)))
    # (at most ``capacity`` rows)
    buckets = spark.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in histogram.items()], "length long, buckets long")
    dealt = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "bucket", before.alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(inner)).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
    kept = cut.columns

    def start():
        by_length = table.value

        def step(batch: pa.RecordBatch) -> dict:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), by_length[int(n)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                inside = rank[at] - rows[k, 0]
                sequence[at] = rows[k, 2] + inside // rows[k, 1]
                offset[at] = rows[k, 3] + inside % rows[k, 1] * n
            return {c: batch.column(c) for c in kept} | {"sequence_id": sequence, "offset": offset}

        return step

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return map_batches(ranked.select(*kept, F.col("rank").cast("long").alias("rank")), start, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stage(pieces(docs, path, capacity)), capacity)


def op9_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the sequences of the documents' pieces."""
    return pack_documents(docs)
