"""Language-model scores of whole texts.

Texts are lower-cased (A-Z) and split into words; words become subword ids of a public byte-level vocabulary cut to
its first ranks, each word with a space before it; one end id closes a text.  A causal self-attention model (see
attention) gives the next id's probability from overlapping windows that score each id once.  Ids that begin a word
(and the end) have their own classes, so the probability that a word ends after its last id is known, and the model is
a distribution over the next word.  Word by word it is mixed in equal parts with the word's share of all training
tokens, whatever its count; both are distributions over the next word, so the score is a probability of the text.

The base score is add-0.1 smoothed word counts over the whole training part of the corpus.  Counts of frequent words,
of which there are at most MOST_FREQUENT whatever the corpus, go to the tasks; other words meet their counts in a
join, for the base score and for the mixture alike.  The attention weights are learned from every id of the whole
training part: texts are dealt to as many rounds as there are RATES, in a round every task learns on from the same
weights with all of its texts' windows, and the tasks' weights are averaged by their windows.

Null and empty texts consist of the end alone; equal texts have equal scores; repeated rows are scored each; an
empty table gives an empty result.  Texts are scored in pieces of PIECE words that see the ids before them.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.attention import CONTEXT, GROUP, Attention, windows
from basalt.llm.common import as_bytes, documents, fold, map_batches, map_stream, process_cache, share, stage

RANKS = 1_024  # subword ids
END_WORD = b"\n"  # no word has white space
SMOOTH = 0.1
MOST_FREQUENT = 1 << 20  # words with at least N / MOST_FREQUENT occurrences: no more than so many
RATES = (0.03, 0.02, 0.01, 0.003)  # of the rounds; a text is learned from in one of them
STEPS, BATCH = 2_000, 256  # where a task has few windows, it passes over them until it has made its share of STEPS
BLOCK = 1 << 17  # windows learned from at once
TASK_WORDS = 3_000_000  # smaller tasks are joined: each has to learn enough for an average
SLICES = 64  # of the weights, summed apart
MIX = 0.5  # the corpus counts' part
PIECE = 60_000  # words scored at once
CACHE, LONGEST_KEPT, IDS_KEPT = 500_000, 200, 32  # words, bytes of a kept one, ids a word on average
TASK_CACHE = 100_000  # words a learning task keeps until its end
WORD = np.dtype([("ids", "<u4"), ("count", "<i8")])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codes:
    """Subword ids by the file's first RANKS merges: first those that begin a word, then the end, then the rest."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {k: v for k, v in ranks.items() if v < RANKS}
        self._encode = tiktoken.Encoding("first-ranks", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        begins = [v for k, v in ranks.items() if k.startswith(b" ")]
        rest = [v for k, v in ranks.items() if not k.startswith(b" ")]
        self.end = len(begins)
        self.starts = -(-(len(begins) + 1) // GROUP)  # classes of ids that begin a word
        self.pad = self.starts * GROUP + len(rest)
        self._id = np.zeros(RANKS, "<u2")
        self._id[begins], self._id[rest] = np.arange(len(begins)), np.arange(self.starts * GROUP, self.pad)

    def __call__(self, word: bytes) -> list[int]:
        if word == END_WORD:
            return [self.end]
        return self.of_words([word])[0].tolist()

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words other than the end, encoded at once, and how many each has: only its first begins a word."""
        ids = self._id[self._encode((b" " + b" ".join(words)).decode("utf-8"))]
        return ids, np.diff(np.flatnonzero(ids < self.end), append=len(ids))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over docs, the end word included; tasks count before they send."""

    def count(batches):
        seen: Counter = Counter()

        def out() -> dict:
            return {"word": list(seen.keys()), "c": list(seen.values())}

        for batch in batches:
            for b in as_bytes(batch.column(0)):
                seen.update(b.lower().split())
            seen[END_WORD] += batch.num_rows
            if len(seen) > CACHE:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return map_stream(docs.select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Tables:
    """What scoring knows of words: their ids, and the frequent words' counts.

    It keeps up to ``kept`` words, or those of one lookup where these are more.
    """

    def __init__(self, counts: dict[bytes, int], codes: Codes, kept: int = CACHE):
        self.counts, self.codes, self.kept = counts, codes, kept
        self.forget()

    def forget(self) -> None:
        """Only the end is known: words' places, their records and first ids by place, and the ids of all."""
        self.words, self.size, self.length = {END_WORD: 0}, 1, 1
        self.records, self.first = np.array([(1, self.counts.get(END_WORD, -1))], WORD), np.zeros(1, np.int64)
        self.ids = np.array(self.codes(END_WORD), "<u2")

    def learn(self, words: list[bytes]) -> None:
        """Adds distinct words that are not known."""
        ids, number = self.codes.of_words(words)
        size, length = self.size + len(words), self.length + len(ids)
        self.records, self.first, self.ids = _with_room(self.records, size), _with_room(self.first, size), _with_room(self.ids, length)
        new = slice(self.size, size)
        self.ids[self.length : length] = ids
        self.first[new] = self.length + np.cumsum(number) - number
        self.records["ids"][new] = number
        self.records["count"][new] = np.fromiter(map(self.counts.get, words, repeat(-1)), np.int64, len(words))
        self.words.update(zip(words, range(self.size, size)))
        self.size, self.length = size, length

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and their records."""
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = dict.fromkeys(map(words.__getitem__, missing.tolist()))
            if self.size + len(new) > self.kept or self.length > IDS_KEPT * self.kept:
                self.forget()
                missing, new = np.arange(len(words)), dict.fromkeys(words)
                new.pop(END_WORD, None)
            self.learn(list(new))
            at[missing] = np.fromiter(map(self.words.__getitem__, map(words.__getitem__, missing.tolist())), np.int64, len(missing))
            for word in new:
                if len(word) > LONGEST_KEPT:
                    del self.words[word]
        records = self.records[at]
        number = records["ids"].astype(np.int64)
        place = np.repeat(self.first[at] - np.cumsum(number) + number, number)
        place += np.arange(len(place))
        return self.ids[place], records


def _with_room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer one that begins with it, if it has less than ``size`` places."""
    if len(array) >= size:
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def pieces_of(words: list[bytes], codes: Codes, size: int = PIECE) -> list[tuple[list[int], list[bytes], bool]]:
    """(ids before, words, whether the last word belongs to the next piece and is only looked at) of a text's pieces."""
    out = []
    for a in range(0, len(words), size):
        before = [i for w in words[max(0, a - CONTEXT - 1) : a] for i in codes(w)][-CONTEXT - 1 :] if a else [codes.end]
        out.append((before, words[a : a + size + 1], a + size < len(words)))
    return out


def piece_windows(pieces: list, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of the pieces' windows; the words' records, their first ids' places, and ends of pieces."""
    ids, words = tables.lookup([w for _, ws, _ in pieces for w in ws])
    last = np.cumsum([len(ws) for _, ws, _ in pieces])
    first = np.concatenate([[0], np.cumsum(words["ids"].astype(np.int64))])
    cut = first[np.concatenate([[0], last])].tolist()
    sequences = [np.concatenate([before[-1:], ids[a:b]]) for (before, _, _), a, b in zip(pieces, cut, cut[1:])]
    x, y, _ = windows(sequences, tables.codes.pad, [before[:-1] for before, _, _ in pieces])
    return x, y, words, first, last


def word_scores(pieces: list, tables: Tables, model: Attention, ready: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the pieces: the model's natural log probability of it as the next word, its count or -1."""
    codes = tables.codes
    x, y, words, first, last = piece_windows(pieces, tables)
    q, begun = model.log_probs(x, y, ready, codes.starts)
    real = y != codes.pad
    logs, begun = np.add.reduceat(q[real].astype(np.float64), first[:-1]), begun[real][first[:-1]].astype(np.float64)
    logs -= begun  # given that a word begins; and it has to end, unless the text does
    ends = np.append(begun[1:], 0.0)
    ends[last - 1] = 0.0
    return logs + ends, words["count"]


def training_windows(batches, tables: Tables):
    """(inputs, targets) of all texts of a task: every id is the target of one window."""
    part, size = [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        x, y, *_ = piece_windows(part, tables)
        return x.astype("<u2"), y.astype("<u2")

    for batch in batches:
        for b in as_bytes(batch.column(0)):
            for before, ws, more in pieces_of(b.lower().split() + [END_WORD], tables.codes):
                part.append((before, ws[: len(ws) - more], False))
                size += len(ws)
                if size >= PIECE:
                    yield out()
                    part, size = [], 0
    if part:
        yield out()


def blocks_of(found, size: int):
    """The windows in blocks of ``size``; the last one is smaller."""
    kept, number = [], 0
    for pair in found:
        kept.append(pair)
        number += len(pair[0])
        while number >= size:
            x, y = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            yield x[:size], y[:size]
            kept, number = [(x[size:], y[size:])], number - size
    if number:
        yield tuple(np.concatenate([k[i] for k in kept]) for i in (0, 1))


def fit_attention(docs: DataFrame, words: int, path: str, steps: int = STEPS) -> Attention:
    """The model learned from all windows of docs, which have ``words`` words: rounds of tasks, averaged."""
    spark, pad = docs.sparkSession, Codes(path).pad
    model = Attention(pad)
    docs = docs.select("doc_id", "text").coalesce(max(1, -(-words // TASK_WORDS)))

    def total(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("n").to_pylist(), part.column("flat").to_pylist()))
        flat = sum(n * np.frombuffer(b, np.float32).astype(np.float64) for n, b in rows)
        return pa.table({"slice": part.column("slice")[:1], "n": pa.array([sum(n for n, _ in rows)], pa.int64()), "flat": pa.array([flat.tobytes()], pa.binary())})

    for k, rate in enumerate(RATES):
        shared, least = share(spark, model.flat()), -(-steps // len(RATES))

        def learn(batches, shared=shared, rate=rate):
            tables, own, n = Tables({}, Codes(path), TASK_CACHE), Attention(pad), 0
            own.load(shared.value)
            for x, y in blocks_of(training_windows(batches, tables), BLOCK):
                own.train(x, y, 1 if n else least, rate, BATCH)
                n += len(x)
            if n:
                parts = [p.tobytes() for p in np.array_split(own.flat(), SLICES)]
                yield {"slice": list(range(SLICES)), "n": [n] * SLICES, "flat": parts}

        texts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(len(RATES))) == k).select("text")
        learned = stage(map_stream(texts, learn, "slice int, n long, flat binary"))
        slices = learned.groupBy("slice").applyInArrow(total, "slice int, n long, flat binary").orderBy("slice").collect()
        if slices:
            model.load(np.concatenate([np.frombuffer(r.flat) for r in slices]) / slices[0].n)
    return model


def lm_scores(docs: DataFrame, divisor: int = 10, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row a row."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(fold(divisor) != 0)
    counts = stage(word_counts(training))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    frequent = {bytes(r[0]): r[1] for r in counts.where(F.col("c") >= max(1.0, total / MOST_FREQUENT)).collect()} if total else {}
    model = fit_attention(training, total, path)
    shared = share(spark, (frequent, model.flat()))
    floor, own = total + SMOOTH * (distinct + 1), uuid.uuid4().hex

    def start():
        frequent, flat = shared.value

        def make() -> tuple[Tables, Attention, dict]:
            codes = Codes(path)
            attention = Attention(codes.pad)
            attention.load(flat)
            return Tables(frequent, codes), attention, attention.prepare()

        tables, attention, ready = process_cache(("language model", own), make)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [b.lower().split() + [END_WORD] for b in as_bytes(batch.column(2))]
            pieces = [(i, piece) for i, ws in enumerate(texts) for piece in pieces_of(ws, tables.codes)]
            n_known, base, score = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            rare, rare_log, rare_of, at = [], [], np.zeros(len(texts), np.int64), 0
            while at < len(pieces):
                part, size = [], 0
                while at < len(pieces) and size < PIECE:  # bounded arrays, however long the texts
                    part.append(pieces[at])
                    size += len(pieces[at][1][1])
                    at += 1
                logs, c = word_scores([piece for _, piece in part], tables, attention, ready)
                number = np.array([len(piece[1]) for _, piece in part])
                owner, own_ = np.repeat([i for i, _ in part], number), np.ones(len(c), bool)
                own_[(np.cumsum(number) - 1)[[piece[2] for _, piece in part]]] = False
                known, unknown = own_ & (c >= 0), np.flatnonzero(own_ & (c < 0))
                k, o = c[known], owner[known]
                n_known += np.bincount(o, minlength=len(texts))
                base += np.bincount(o, np.log10((k + SMOOTH) / floor), len(texts))
                score += np.bincount(o, np.logaddexp(logs[known] + np.log(1 - MIX), np.log(MIX * k / total)), len(texts)) / np.log(10)
                flat_words = [w for _, piece in part for w in piece[1]]
                rare += [flat_words[j] for j in unknown.tolist()]
                rare_log.append(logs[unknown])
                rare_of += np.bincount(owner[unknown], minlength=len(texts))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(np.concatenate(rare_log or [np.zeros(0)]))], ["word", "log"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(rare_of)]), pa.int32())
            return {"key": batch.column(0), "doc_id": batch.column(1), "n_tokens": list(map(len, texts)), "n_known": n_known, "base": base, "score": score, "rare": pa.ListArray.from_arrays(offsets, pairs)}

        return step

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    scored = stage(map_batches(keyed, start, "key long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, log: double>>"), 256)
    c = F.coalesce("c", F.lit(0).cast("long"))
    rare = scored.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.log").join(counts, "word", "left")
    by_model, by_count = F.col("log") + F.lit(math.log(1 - MIX)), F.log(F.lit(MIX / max(total, 1)) * F.col("c"))
    larger, smaller = F.greatest(by_model, by_count), F.least(by_model, by_count)
    mixed = F.when(c > 0, larger + F.log1p(F.exp(smaller - larger))).otherwise(by_model)
    rare = rare.groupBy("key").agg(
        F.sum(F.log10((c + SMOOTH) / F.lit(floor))).alias("rare_base"), F.sum((c > 0).cast("long")).alias("rare_known"), F.sum(mixed / F.lit(math.log(10))).alias("rare_score")
    )
    alike = scored.groupBy("key").agg(F.count("*").alias("alike"))  # equal rows share a key and so a sum
    joined = scored.drop("rare").join(alike.join(rare, "key", "left"), "key")

    return joined.select(
        "doc_id",
        (fold(divisor) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.expr("coalesce(rare_known, 0) div alike")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rare_base"), F.lit(0.0)) / F.col("alike")).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("rare_score"), F.lit(0.0)) / F.col("alike")).alias("score"),
    )


def op1_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
