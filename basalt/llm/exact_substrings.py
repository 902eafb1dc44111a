"""Repeated byte strings of the corpus, found with suffix arrays over shards.

Every 200-byte window belongs to its minimizer, the least of the hashes of its k-byte strings; equal windows have
equal minimizers, wherever they are.  A run of windows with one minimizer is a fragment.  Fragments whose minimizer
occurs once cannot hold a repeated window.  The others meet by minimizer, each distinct content once, marked if it
occurs more often, in shards whose suffix array and common prefixes (see suffix_array) tell which windows repeat.  A
minimizer with more than HOT_CONTENTS distinct contents would make a shard too large for a task: its contents' windows
are counted by their 128-bit hashes instead, which spreads them over all tasks.

Null texts are empty, texts under 200 bytes keep all bytes; rows with the same text repeat each other (rows that also
share their id are one text, counted as often as it occurs); an empty
table gives an empty result.  A match may cut a UTF-8 sequence: digests are of the exact bytes kept; the stage's
texts drop the sequence's remains.  Columns other than doc_id and text pass the stage untouched (but n_chars, which
is brought up to date), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import BATCH_ROWS, as_bytes, documents, map_batches, map_stream, stage
from basalt.llm.near_dedup import GOLD, mix64
from basalt.llm.suffix_array import repeated_starts

LENGTH = 200
GRAM = 40
WINDOWS = LENGTH - GRAM + 1  # k-byte strings of a window
SEGMENT = 1 << 21  # windows that are hashed at once
SHARD_BYTES = 1_500_000  # bytes of a suffix array
HOT_CONTENTS = 40_000  # distinct contents of one minimizer (some 10 MB) that a shard takes
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for i, b in enumerate((BASE, inverse)):
            steps = np.full(n + 1, b, np.uint64)
            steps[0] = 1
            _POWERS[i : i + 1] = [np.cumprod(steps)]
    return _POWERS[0], _POWERS[1]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte string of b."""
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    n = len(b) - GRAM + 1
    return mix64((total[GRAM:] - total[:-GRAM]) * inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def fragments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimizer, content hash) of every fragment."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]

    def flush(parts: list[tuple[int, int, bytes]]) -> None:
        joined = b"".join(p[2] for p in parts)
        h = gram_hashes(np.frombuffer(joined, np.uint8))
        # position in the low bits: the leftmost of equal hashes wins, in every copy alike
        shift = np.uint64(24)
        key = (h >> shift << shift) | np.arange(len(h), dtype=np.uint64)
        best = (sliding_min(key, WINDOWS) & np.uint64((1 << 24) - 1)).astype(np.int64)
        size = np.array([len(p[2]) for p in parts])
        begin = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(parts)), size)[: len(best)]
        inside = np.arange(len(best)) + LENGTH <= begin[owner + 1]
        at = np.flatnonzero(inside)
        if not len(at):
            return
        m, o = best[at], owner[at]
        new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (o[1:] != o[:-1])]))
        start, count = at[new], np.diff(np.append(new, len(at)))
        part = o[new]
        base = np.array([p[1] for p in parts])
        out[0].append(np.array([p[0] for p in parts])[part])
        out[1].append(start - begin[part] + base[part])
        out[2].append(count)
        out[3].append(h[m[new]])
        out[4].append(np.array([xxhash.xxh64_intdigest(joined[s : s + c + LENGTH - 1]) for s, c in zip(start.tolist(), count.tolist())], np.uint64))

    parts, held = [], 0
    for i, b in enumerate(texts):
        for base in range(0, max(0, len(b) - LENGTH + 1), SEGMENT):  # segments share LENGTH - 1 bytes, so no window is cut or doubled
            parts.append((i, base, b[base : base + SEGMENT + LENGTH - 1]))
            held += len(parts[-1][2])
            if held >= SEGMENT:
                flush(parts)
                parts, held = [], 0
    if parts:
        flush(parts)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds))


def row_keys() -> list[Column]:
    """128 bits that stand for a row's id and text; equal rows share them."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", text).alias(f"k{k}") for k in (1, 2)]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(*row_keys(), "text")


def _fragment_rows(docs: DataFrame) -> DataFrame:
    """(k1, k2, place, minimizer, content): place holds the first window and the number of windows less one."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            text, first, count, minimizer, content = fragments(as_bytes(batch.column(2)))
            place = (first << 8) | (count - 1)
            row = pa.array(text)
            return {"k1": batch.column(0).take(row), "k2": batch.column(1).take(row), "place": place, "minimizer": minimizer.view(np.int64), "content": content.view(np.int64)}

        return step

    return map_batches(_keyed(docs), start, "k1 long, k2 long, place long, minimizer long, content long")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Contents sorted by minimizer -> (minimizer, content, starts): the windows that repeat, as first, number, ... .

    A shard is closed between two minimizers once it has SHARD_BYTES.
    """
    keys: list[tuple[int, int]] = []
    contents: list[bytes] = []
    times: list[int] = []
    held = 0

    def settle() -> dict:
        out: dict[str, list] = {"minimizer": [], "content": [], "starts": []}
        for key, mark in zip(keys, repeated_starts(contents, LENGTH, times)):
            if mark.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                out["minimizer"].append(key[0])
                out["content"].append(key[1])
                out["starts"].append(np.stack([edge[::2], edge[1::2] - edge[::2]], axis=1).ravel().astype(np.int32))
        return out

    for batch in batches:
        for m, c, twice, data in zip(*(batch.column(n).to_pylist() for n in ("minimizer", "content", "twice", "data"))):
            if held >= SHARD_BYTES and keys[-1][0] != m:
                yield settle()
                keys, contents, times, held = [], [], [], 0
            keys.append((m, c))
            contents.append(data)
            times.append(1 + twice)
            held += len(data)
    if keys:
        yield settle()


def _counted(sent: DataFrame) -> DataFrame:
    """Contents (minimizer, content, twice, data) -> (minimizer, content, starts), by counting hashed windows."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("minimizer", "content", "at", "window", "times")}
            for m, c, twice, data in zip(*(batch.column(n).to_pylist() for n in ("minimizer", "content", "twice", "data"))):
                for i in range(len(data) - LENGTH + 1):
                    for name, value in zip(out, (m, c, i, xxhash.xxh3_128_digest(data[i : i + LENGTH]), 1 + twice)):
                        out[name].append(value)
            return out

        return step

    windows = map_batches(sent, start, "minimizer long, content long, at int, window binary, times int")
    often = windows.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    found = windows.join(often, "window").groupBy("minimizer", "content").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return found.select("minimizer", "content", F.flatten(F.transform("at", lambda i: F.array(i, F.lit(1)))).alias("starts"))


def cut_spans(b: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(bytes kept, removed runs) for runs of repeated windows (first, number)."""
    kept, spans, at = [], 0, 0
    run: list[int] | None = None
    for first, count in [*sorted(starts), (len(b) + LENGTH, 0)]:
        if run and first <= run[1]:
            run[1] = max(run[1], first + count + LENGTH - 1)
            continue
        if run:
            kept.append(b[at : run[0]])
            at, spans = run[1], spans + 1
        run = [first, first + count + LENGTH - 1]
    return b"".join([*kept, b[at:]]), spans


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> the texts that share a minimizer with any (k1, k2, data: zstd), and their repeated windows
    (k1, k2, starts: array of first and number).

    Fragments are counted by minimizer and by content before they are exchanged, so a key of any number of fragments
    is a row a task; the fragments meet these counts in joins, whose large side can be split anywhere.
    """
    every = stage(_fragment_rows(docs), BATCH_ROWS)
    shared = every.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer")
    rows = stage(every.join(shared, "minimizer").select("k1", "k2", "place", "minimizer", "content"))
    distinct = rows.groupBy("minimizer", "content").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("first"))
    distinct = stage(distinct.select("minimizer", "content", (F.col("n") > 1).alias("twice"), "first.*"))
    # the rows that share a minimizer, and of each content the first row
    firsts = distinct.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "minimizer", "content", "twice")).alias("firsts"))
    sharing = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).select("k1", "k2")
    lists = sharing.join(firsts, ["k1", "k2"], "left")

    def compress():
        z = zstandard.ZstdCompressor(level=1)

        def step(batch: pa.RecordBatch) -> dict:
            return {"k1": batch.column(0), "k2": batch.column(1), "data": [z.compress(b) for b in as_bytes(batch.column(2))]}

        return step

    packed = map_batches(_keyed(docs.where(F.octet_length("text") >= LENGTH)), compress, "k1 long, k2 long, data binary")
    texts = packed.dropDuplicates(["k1", "k2"]).join(lists, ["k1", "k2"]).select("k1", "k2", "data", F.coalesce("firsts", F.array()).alias("firsts"))
    texts = stage(texts, BATCH_ROWS)

    def contents():
        z = zstandard.ZstdDecompressor()

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("minimizer", "content", "twice", "data")}
            for data, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = z.decompress(data)
                for f in firsts:
                    at = (f["place"] >> 8) & 0xFFFFFFFF
                    out["minimizer"].append(f["minimizer"])
                    out["content"].append(f["content"])
                    out["twice"].append(f["twice"])
                    out["data"].append(b[at : at + (f["place"] & 0xFF) + LENGTH])
            return out

        return step

    sent = map_batches(texts.where(F.size("firsts") > 0).select("data", "firsts"), contents, "minimizer long, content long, twice boolean, data binary")
    hot = stage(distinct.groupBy("minimizer").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CONTENTS).select("minimizer"))
    some_hot = not hot.isEmpty()
    cold = sent.join(hot, "minimizer", "left_anti") if some_hot else sent
    cold = cold.repartition(_partitions(docs), "minimizer").sortWithinPartitions("minimizer")
    repeats = map_stream(cold, _shards, "minimizer long, content long, starts array<int>")
    if some_hot:
        repeats = repeats.unionByName(_counted(sent.join(hot, "minimizer", "left_semi")))
    at = F.shiftrightunsigned(F.col("place"), 8)
    runs = rows.join(repeats, ["minimizer", "content"]).groupBy("k1", "k2").agg(F.collect_set(F.struct(at.alias("at"), "starts")).alias("runs"))
    return texts.select("k1", "k2", "data"), runs


def _partitions(docs: DataFrame) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> k1, k2, n_removed, n_spans, kept_sha256 (and kept: the text left) of the texts that lose bytes."""
    texts, runs = repeated_windows(docs)

    def start():
        z = zstandard.ZstdDecompressor()

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept")}
            for k1, k2, data, runs in zip(*(c.to_pylist() for c in batch.columns)):
                b = z.decompress(data)
                kept, spans = cut_spans(b, [(r["at"] + o, n) for r in runs for o, n in zip(r["starts"][::2], r["starts"][1::2])])
                for name, value in zip(out, (k1, k2, len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None)):
                    out[name].append(value)
            return out

        return step

    both = texts.join(runs, ["k1", "k2"]).select("k1", "k2", "data", "runs")
    return map_batches(both, start, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = F.coalesce("text", F.lit("")).cast("binary")
    every = docs.select("doc_id", *row_keys(), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"))
    joined = every.join(remove_repeats(docs).drop("kept"), ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its repeated bytes, n_chars brought up to date."""
    columns = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").select("row", *row_keys())
    cut = remove_repeats(docs.select("doc_id", "text"), keep_text=True)
    out = own.join(cut, ["k1", "k2"], "left").select("row", F.coalesce("kept", "row.text").alias("new_text"))
    changes = {"text": F.col("new_text")}
    if "n_chars" in columns:
        changes["n_chars"] = F.char_length(F.coalesce("new_text", F.lit(""))).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(changes[c].alias(c) if c in changes else F.col(f"row.`{c}`").alias(c) for c in columns))
