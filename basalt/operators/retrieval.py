"""Exact searches of every question over all chunks or vectors, with memory that does not depend on the corpus.

A task scores its rows against every question in blocks of numpy and keeps each question's best rows, so no row a pair
of question and chunk is ever made.  Scores are rounded as Spark rounds them before they are ranked: a cut never
decides a tie otherwise than ``order by score desc, id`` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# What bytes make a term (runs of these, and single hyphens between two of them).
LETTER = np.zeros(256, dtype=bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
HYPHEN = ord("-")
# Cells of a score matrix, terms asked so often that a matrix product serves them, questions of a dense
# task and how many such tasks a smaller table is dealt to.
CELLS, DENSE_TERMS = 1 << 20, 256
PART_BYTES, COUNTED_TERMS = 4 << 20, 1 << 21  # text handled at once; terms of a task that are counted together
ASKED_ROWS, ASKED_TASKS, LEAST_ASKED = 16_384, 32, 1024
SCALE = 1_000_000


def micro(x: np.ndarray) -> np.ndarray:
    """round(x, 6) in millionths, half away from zero in the decimal that prints x, as Spark rounds."""
    scaled = np.abs(x) * SCALE
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled + 0.5 - np.rint(scaled + 0.5)) < 1e-6 * (1 + scaled * 1e-6)):
        whole[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return (np.sign(x) * whole).astype(np.int64)


class Best:
    """The k best (score, id) of each question so far: highest score, then least id."""

    def __init__(self, questions: int, k: int):
        self.k, self.rows = k, [[] for _ in range(questions)]
        self.least = np.full(questions, -np.inf)  # the k-th score

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rank: np.ndarray, extra: np.ndarray) -> None:
        """ids in any order; rank orders those of this call."""
        order = np.lexsort((rank, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        order = order[place < self.k]
        for i, s, name, e in zip(q[place < self.k].tolist(), score[order].tolist(), ids[order].tolist(), extra[order].tolist()):
            if s >= self.least[i]:
                self.rows[i].append((-s, name, e))
        for i in np.unique(q).tolist():
            self.rows[i] = sorted(self.rows[i])[: self.k]
            if len(self.rows[i]) == self.k:
                self.least[i] = -self.rows[i][-1][0]


# terms


def terms(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms [a-z0-9]+(-[a-z0-9]+)* of lower-case lines, and how many each line has."""
    lines = lines.cast(pa.string())
    off = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int32)
    data = np.frombuffer(lines.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    letter = LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a line begins here
    edge[off] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:-1] if len(data) else letter
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:] if len(data) else letter
    inside = letter | (data == HYPHEN) & before & after
    begins = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:-1])) if len(data) else np.zeros(0, np.int64)
    upto = np.cumsum(inside, dtype=np.int32)
    cuts = np.append(upto[begins] - 1, upto[-1] if len(data) else 0).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(cuts), pa.py_buffer(data[inside].tobytes()))
    return found, np.diff(np.searchsorted(begins, off))


def parts(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and PART_BYTES of a column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right"))
        upto = min(max(upto, at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def term_counts(units: DataFrame) -> DataFrame:
    """(term, n, n_chunks): occurrences and chunks, summed over parts of a task's rows only; the null term has all
    terms and all chunks with any.  units: (chunk_id, line), lines in lower case."""
    schema = "term string, n long, n_chunks long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, units, held = [], [], 0

        def flush():
            coded = pa.concat_arrays(found).dictionary_encode()
            term, unit = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(units)
            n = len(coded.dictionary)
            first = np.unique(unit * n + term) % n
            columns = [pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())]), pa.array(np.append(np.bincount(term, minlength=n), len(term))), pa.array(np.append(np.bincount(first, minlength=n), len(np.unique(unit))))]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

        for batch in batches:
            for part in parts(batch, 0, batch.num_rows):
                names, lengths = terms(part.column(0))
                if len(names):
                    last = int(units[-1][-1]) + 1 if units else 0
                    found.append(names)
                    units.append(np.repeat(np.arange(last, last + len(lengths)), lengths))
                    held += len(names)
                if held >= COUNTED_TERMS:
                    yield flush()
                    found, units, held = [], [], 0
        if held:
            yield flush()

    return units.select("line").mapInArrow(count, schema)


# lexical


class Lexical:
    """Okapi scores of chunks for all questions; known: the terms asked that occur."""

    def __init__(self, known: list[str], idf: list[float], mean_len: float, asked: list[list[tuple[int, float]]], questions: int, k1: float, b: float):
        """asked: for each term the (question, times) that name it."""
        self.mean_len, self.k1, self.b, self.n = mean_len, k1, b, questions
        self.terms, self.idf = pa.array(known, pa.string()), np.array(idf, dtype=float)
        self.count = np.array([len(a) for a in asked], dtype=np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.q = np.array([q for a in asked for q, _ in a], dtype=np.int64)
        self.times = np.array([t for a in asked for _, t in a], dtype=float)
        often = np.argsort(-self.count, kind="stable")[:DENSE_TERMS]
        often = often[self.count[often] > questions / 32]
        self.column = np.full(len(known), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), questions))
        for i, t in enumerate(often):
            at = slice(self.start[t], self.start[t] + self.count[t])
            self.matrix[i, self.q[at]] = self.times[at]
        self.named = np.zeros((len(known), questions), dtype=bool)
        self.named[np.repeat(np.arange(len(known)), self.count), self.q] = True

    def _spread(self, unit, term):
        """A posting for each question that names its term: which posting, which entry of q and times."""
        of = np.repeat(np.arange(len(term)), self.count[term])
        first = np.cumsum(self.count[term]) - self.count[term]
        return of, np.arange(len(of)) - first[of] + self.start[term][of]

    def offer(self, best: Best, ids: pa.Array, lines: pa.Array) -> None:
        n = len(ids)
        names, length = terms(lines)
        found = pc.fill_null(pc.index_in(names, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        unit = np.repeat(np.arange(n), length)
        key, tf = np.unique(unit[found >= 0] * len(self.terms) + found[found >= 0], return_counts=True)
        unit, term = key // len(self.terms), key % len(self.terms)
        weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[unit] / self.mean_len))
        often = self.column[term] >= 0
        table = np.zeros((n, self.matrix.shape[0]))
        table[unit[often], self.column[term[often]]] = weight[often]
        of, at = self._spread(unit[~often], term[~often])
        score = np.bincount(unit[~often][of] * self.n + self.q[at], weights=weight[~often][of] * self.times[at], minlength=n * self.n).reshape(n, self.n)
        score = score + table @ self.matrix
        likely = score >= (best.least[None, :] - 0.6) / SCALE
        if (best.least < 1).any():  # a chunk that shares no term is no hit, whatever 0 would rank
            of, at = self._spread(unit, term)
            shares = np.zeros(n * self.n, dtype=bool)
            shares[unit[of] * self.n + self.q[at]] = True
            likely &= shares.reshape(n, self.n)
        u, q = np.nonzero(likely)
        if not len(u):
            return
        exact = micro(score[u, q])
        keep = exact >= best.least[q]
        u, q, exact = u[keep], q[keep], exact[keep]
        rank = np.empty(n, dtype=np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        # only the best of a question need their shared terms counted
        order = np.lexsort((rank[u], -exact, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
        order = order[place < best.k]
        u, q, exact = u[order], q[order], exact[order]
        first = np.searchsorted(unit, np.arange(n + 1))
        held = np.array([self.named[term[first[i] : first[i + 1]], j].sum() for i, j in zip(u, q)], dtype=np.int64)
        best.offer(q, exact, np.array(ids.to_pylist(), dtype=object)[u], rank[u], held)


def lexical_top(units: DataFrame, questions: DataFrame, words: str, k: int, k1: float, b: float, epsilon: float) -> DataFrame:
    """(item_id, chunk_id, score, held, place) of the k best chunks of every question.

    units: (chunk_id, line), lines in lower case, one row a chunk; questions: (item_id, text), held by the driver and by every task with their terms.  held: how many of the
    question's distinct terms the chunk has.
    """
    spark = units.sparkSession
    asked = questions.select("item_id", F.explode(F.expr(words)).alias("term")).groupBy("item_id", "term").agg(F.count("*").cast("double").alias("times")).collect()
    schema = StructType([StructField("item_id", questions.schema["item_id"].dataType), StructField("chunk_id", StringType()), StructField("score", DoubleType()), StructField("held", LongType())])
    items = list(dict.fromkeys(r.item_id for r in asked))
    index = {item: i for i, item in enumerate(items)}
    by_term: dict[str, list[tuple[int, float]]] = {}
    for r in asked:
        by_term.setdefault(r.term, []).append((index[r.item_id], r.times))
    n, total, idf = _idf(units, by_term, epsilon) if by_term else (0, 0, {})
    ranked = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "chunk_id")).cast("long")).where(F.col("place") <= k)
    if not n or not idf:
        return ranked(spark.createDataFrame([], schema))
    known = [t for t in by_term if t in idf]
    model = spark.sparkContext.broadcast((known, [idf[t] for t in known], total / n, [by_term[t] for t in known], len(items), k1, b))
    arrow, block = to_arrow_schema(schema), max(1, CELLS // len(items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = None, Best(len(items), k)
        for batch in batches:
            scorer = scorer or Lexical(*model.value)
            for part in parts(batch, 1, block):
                scorer.offer(best, part.column(0), part.column(1))
        for item, rows in zip(items, best.rows):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([item] * len(rows), [r[1] for r in rows], [-r[0] / SCALE for r in rows], [r[2] for r in rows]), arrow.types)], schema=arrow)

    return ranked(units.select("chunk_id", "line").mapInArrow(search, schema))


def _idf(units: DataFrame, asked: dict, epsilon: float) -> tuple[int, int, dict[str, float]]:
    """Chunks that have a term, terms in all, and the idf of the asked terms that occur; one pass over the chunks."""
    spark = units.sparkSession
    counts = term_counts(units).groupBy("term").agg(F.sum("n_chunks").alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("len"))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in asked], "asked string"))
    # of the other terms only how many have a frequency
    found = counts.join(wanted, counts.term == wanted.asked, "left").groupBy("asked", F.col("term").isNull().alias("all"), "n", "len").agg(F.count("*").alias("terms")).collect()
    n, total = next(((r.n, r.len) for r in found if r["all"]), (0, 0))
    if not n:
        return 0, 0, {}
    frequency = [r for r in found if not r["all"]]
    raw = np.log(n - np.array([r.n for r in frequency], dtype=float) + 0.5) - np.log(np.array([r.n for r in frequency], dtype=float) + 0.5)
    weights = np.array([r.terms for r in frequency], dtype=float)
    mean = float((raw * weights).sum() / weights.sum())
    return n, total, {r.asked: float(x) if x >= 0 else epsilon * mean for r, x in zip(frequency, raw) if r.asked is not None}


# dense


class Dense:
    """Cosines of a block of questions with batches of rows: single precision finds what may rank, then the exact sum."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt(_dots(vectors, vectors))
        self.unit = (vectors / self.norm[:, None]).astype(np.float32)
        self.slack = 2 * (vectors.shape[1] + 4) * 2.0**-24 + 1e-6
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        keep = _least_of_copies(ids, vectors, self.k + 1)
        ids, vectors = ids[keep], vectors[keep]
        norm = np.sqrt(_dots(vectors, vectors))
        unit = (vectors / norm[:, None]).astype(np.float32)
        step = max(1, 4 * CELLS // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            near = self.unit[at : at + step] @ unit.T
            least = self.score[at : at + step, -1]
            floor = np.where(least == np.iinfo(np.int64).min, -np.inf, least / SCALE)
            fresh = np.flatnonzero(np.isinf(floor))
            if len(fresh) and len(ids) > self.k + 1:  # the question itself may be among them
                floor[fresh] = np.partition(near[fresh], -self.k - 1, axis=1)[:, -self.k - 1]
            q, r = np.nonzero(near >= (floor - self.slack).astype(np.float32)[:, None])
            other = self.ids[at + q] != ids[r]
            q, r = q[other] + at, r[other]
            for part in range(0, len(q), CELLS >> 4):
                self._keep(q[part : part + (CELLS >> 4)], r[part : part + (CELLS >> 4)], ids, vectors, norm)

    def _keep(self, q, r, ids, vectors, norm) -> None:
        score = micro(_dots(self.vectors[q], vectors[r]) / (self.norm[q] * norm[r]))
        least = self.score[q, -1]
        better = (score > least) | (score == least) & (ids[r] < self.found[q, -1])
        touched = np.unique(q[better])
        if not len(touched):
            return
        every = np.concatenate([np.repeat(touched, self.k), q[better]])
        scores = np.concatenate([self.score[touched].ravel(), score[better]])
        found = np.concatenate([self.found[touched].ravel(), ids[r[better]]])
        order = np.lexsort((found, -scores.astype(np.float64), every))
        every = every[order]
        place = np.arange(len(every)) - np.searchsorted(every, every, "left")
        order, every, place = order[place < self.k], every[place < self.k], place[place < self.k]
        self.score[every, place], self.found[every, place] = scores[order], found[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, place = np.nonzero(self.score > np.iinfo(np.int64).min)
        return self.ids[q], self.found[q, place], self.score[q, place] / SCALE


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, as the SQL sums."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _least_of_copies(ids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The rows without equal vectors beyond the n least ids of each: those never rank."""
    same = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(same, return_inverse=True)
    order = np.lexsort((ids, group))
    group = group[order]
    return np.sort(order[np.arange(len(group)) - np.searchsorted(group, group, "left") < n])


def dense_ready(vectors: DataFrame) -> tuple[int, int] | None:
    """Rows and dimensions, if all vectors with an id are of one length, finite and not zero, and no id comes twice."""
    v, name = vectors.where("vec_id is not null"), F.col("embedding")
    if not isinstance(vectors.schema["vec_id"].dataType, LongType) or not isinstance(vectors.schema["embedding"].dataType, ArrayType):
        return None
    square = F.aggregate(name, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = F.coalesce((square > 0) & (square < float("inf")) & ~F.isnan(square), F.lit(False))
    n, low, high, sound_rows = v.agg(F.count("*"), F.min(F.size(name)), F.max(F.size(name)), F.sum(sound.cast("long"))).first()
    if not n or low != high or sound_rows != n or not v.groupBy("vec_id").count().where("count > 1").isEmpty():
        return None
    return n, low


def dense_top(vectors: DataFrame, size: tuple[int, int], k: int) -> DataFrame:
    """(item_id, vec_id, cosine, place): the k nearest others of every vector; size: as dense_ready found it.

    The questions are dealt out in blocks, and every row is sent to each block once; a task holds its block and one
    batch of rows.
    """
    n, d = size
    blocks = -(-n // min(ASKED_ROWS, max(LEAST_ASKED, -(-n // ASKED_TASKS))))
    v = vectors.where("vec_id is not null").select("vec_id", "embedding")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = v.select(own.alias("block"), F.lit(0).alias("side"), "vec_id", "embedding")
    rows = v.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "embedding")
    schema = "item_id long, vec_id long, cosine double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, dense = None, [], None

        def done():
            if dense is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(dense.rows(), arrow.types)], schema=arrow)

        for batch in batches:
            where = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                block, side = divmod(int(where[a]), 2)
                if block != now:
                    yield from done()
                    now, gathered, dense = block, [], None
                part = batch.slice(a, b - a)
                ids = part.column(2).to_numpy()
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                if side == 0:
                    gathered.append((ids, x))
                elif gathered or dense is not None:
                    if dense is None:
                        dense, gathered = Dense(np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered]), k), []
                    dense.offer(ids, x)
        yield from done()

    dealt = asked.unionByName(rows).repartition(blocks, "block").sortWithinPartitions("block", "side")
    found = dealt.mapInArrow(search, schema)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cosine"), "vec_id")).cast("long")).where(F.col("place") <= k)
