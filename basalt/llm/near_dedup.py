"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text's elements are its five-word shingles, weighted by how often they occur (a text of one to four words has one
shingle).  Hashed darts fall on every element's weighted region at unit rate; of those below a rank that depends on
the total weight, the earliest in each of ``K`` coordinates is kept.  Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.  Equal texts are one node.  Bands of the signature send nodes to
buckets; in a bucket every node is paired with the bucket's pivot (the order that elects pivots differs between
bands), then, where a bucket still has nodes of different components, with the node that has most links so far, and at
last every two nodes of it that are in different components and may be similar, which their rarest units tell, are
paired.  Pairs are verified on the exact shingles, and
classes are the connected components of the verified links: every two similar nodes of a bucket are compared or already
of one class.

Null texts are empty; all empty texts are one class; equal rows are of one class, of which one row is kept; an
empty table gives an empty result; null ids are allowed and come last in electing the kept row.  Columns other than
doc_id and text pass the stage untouched, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from basalt.llm.common import as_bytes, documents, map_batches, stage
from basalt.llm.graph import connected_components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4  # at similarity 0.8 a pair misses all bands with probability 5e-8
K = BANDS * ROWS
DARTS = K * math.log(K) + 2 * K  # darts expected over a whole text
ORDERS = 4
HUBS = 2  # rounds in which the best linked nodes are pivots
BLOCK = 512  # nodes of a block; two blocks of a bucket meet in a cell
CACHE = 300_000
UNITS = 100_000  # shingles whose darts are thrown at once (a longer text is alone)
GOLD, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word -> 64-bit hash, bounded by clearing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def elements(b: bytes, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, in order, and their weights."""
    words = b.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        rolled = mix64(rolled * GOLD + h[j : j + len(rolled)])
    return np.unique(rolled, return_counts=True)


def _units(e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One id a unit of weight: the c-th unit of an element is the same in all texts."""
    nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    return mix64(np.repeat(e, w) + nth.astype(np.uint64) * GOLD)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of K dart ids a text; every text must have an element."""
    weight = np.array([w.sum() for _, w in texts], float)
    sizes = np.array([w.sum() for _, w in texts])
    # the c-th unit of an element's weight is a region of its own
    key, doc = np.concatenate([_units(e, w) for e, w in texts]), np.repeat(np.arange(len(texts)), sizes)
    out, todo, limit = np.zeros((len(texts), K), np.uint64), np.arange(len(texts)), DARTS / weight
    while len(todo):
        best, dart = np.full(len(texts) * K, np.inf), np.zeros(len(texts) * K, np.uint64)
        h, d, rank, step = key, doc, np.zeros(len(key)), 0
        while len(h):
            u = mix64(h ^ np.uint64((2 * step + 1) * int(GOLD) & MASK))
            rank = rank - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            near = rank < limit[d]
            h, d, rank = h[near], d[near], rank[near]
            thrown = mix64(h + np.uint64((2 * step + 2) * int(GOLD) & MASK))
            slot = d * K + (thrown % np.uint64(K)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            first = best[slot] == rank
            dart[slot[first]] = thrown[first]
            step += 1
        full = np.isfinite(best).reshape(-1, K).all(axis=1)
        ready = todo[full[todo]]
        out[ready] = dart.reshape(-1, K)[ready]
        todo = todo[~full[todo]]
        again = np.isin(doc, todo)
        key, doc = key[again], doc[again]
        limit = limit * 2  # a coordinate stayed empty: throw to twice the rank
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Band keys of each row; a key stands for its band, too."""
    parts = signature.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix64(key * GOLD + parts[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two element lists; two empty ones are equal."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common) if total else 1.0


def text_id() -> F.Column:
    """128-bit id of a text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _banded(docs: DataFrame) -> DataFrame:
    def start():
        hashes = WordHash()

        def step(batch: pa.RecordBatch) -> dict:
            found = [elements(b, hashes) for b in as_bytes(batch.column(2))]
            keys: list = [[] for _ in found]
            some = [i for i, (e, _) in enumerate(found) if len(e)]
            at = 0
            while at < len(some):
                part, units = [], 0
                while at < len(some) and (not part or units + int(found[some[at]][1].sum()) <= UNITS):
                    part.append(some[at])
                    units += int(found[some[at]][1].sum())
                    at += 1
                for i, k in zip(part, bands(signatures([found[i] for i in part]))):
                    keys[i] = k
            return {"doc_id": batch.column(0), "tid": batch.column(1), "bands": keys}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"), "text"), start, "doc_id long, tid binary, bands array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, text_a, text_b) -> (u, v) of those at least SIMILAR."""

    def start():
        hashes = WordHash()
        last: list = [None, None]

        def step(batch: pa.RecordBatch) -> dict:
            u, v = [], []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if last[0] != b:
                    last[:] = b, elements(y, hashes)
                if similarity(elements(x, hashes), last[1]) >= SIMILAR:
                    u.append(a)
                    v.append(b)
            return {"u": u, "v": v}

        return step

    return map_batches(pairs.select("a", "b", "text_a", "text_b"), start, "u binary, v binary")


def _text_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(tid), distinct -> tid, text."""
    wanted = wanted.join(nodes.select("tid", "rep"), "tid")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_id().alias("tid"), "text")
    # the id in the key spreads the copies of one text; equal rows are then one
    texts = wanted.join(texts, (texts["tid"] == wanted["tid"]) & texts["rep"].eqNullSafe(wanted["rep"])).groupBy(wanted["tid"]).agg(F.first("text").alias("text"))
    return stage(texts)


def _with_texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with text_a and text_b."""
    texts = _text_of(docs, nodes, pairs.select(F.col("a").alias("tid")).union(pairs.select(F.col("b").alias("tid"))).distinct())
    return pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")


def _open(rest: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """rest(key, tid) of the buckets with nodes of different components, with each node's root and the bucket's n and hub."""
    ends = links.select(F.col("u").alias("tid")).union(links.select(F.col("v").alias("tid")))
    known = roots.withColumnRenamed("node", "tid").join(ends.groupBy("tid").agg(F.count("*").alias("degree")), "tid", "left")
    rooted = rest.join(known, "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    best, bucket = F.max(F.struct("degree", F.xxhash64("tid"), "tid", "root")), Window.partitionBy("key")
    known = {"low": F.min("root"), "high": F.max("root"), "n": F.count("*"), "best": best}
    buckets = rooted.select("key", "tid", "root", *(c.over(bucket).alias(n) for n, c in known.items())).where("low <> high")
    return buckets.select("key", "tid", "root", "n", F.col("best.tid").alias("hub"), F.col("best.root").alias("hub_root"))


def _hub_pairs(rest: DataFrame) -> DataFrame:
    """Every node with its bucket's hub, unless they are of one component."""
    return rest.where("tid <> hub and root <> hub_root").select(F.col("tid").alias("a"), F.col("hub").alias("b")).distinct()


def _candidates(found: list[tuple[np.ndarray, np.ndarray]], left: list[int], right: list[int]) -> np.ndarray:
    """Which of left (rows) may be SIMILAR to which of right (columns); no pair that is SIMILAR is missed.

    Texts of W and V units that are SIMILAR share at least SIMILAR * W and SIMILAR * V of them, so with units in one
    order, here the rarest first, they share one of the first W - ceil(SIMILAR * W) + 1 and as many of V.
    """
    units = [_units(e, w) for e, w in found]
    _, unit, times = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(times, kind="stable")] = np.arange(len(times))
    ends = np.cumsum([len(u) for u in units]).tolist()
    first = []
    for a, b in zip([0, *ends], ends):
        p = b - a - math.ceil(SIMILAR * (b - a) - 1e-9) + 1
        first.append(np.sort(place[unit[a:b]])[:p])

    def posted(side: list[int]) -> tuple[np.ndarray, np.ndarray]:
        of, at = np.concatenate([first[i] for i in side]), np.repeat(np.arange(len(side)), [len(first[i]) for i in side])
        order = np.argsort(of, kind="stable")
        return of[order], at[order]

    out = np.zeros((len(left), len(right)), bool)
    if not left or not right:
        return out
    (a, i), (b, j) = posted(left), posted(right)
    both = np.intersect1d(a, b)
    for p, q, r, t in zip(*(np.searchsorted(x, both, side).tolist() for x in (a, b) for side in ("left", "right"))):
        out[i[p:q, None], j[None, r:t]] = True
    return out


def _cell_links(cell: pa.Table) -> pa.Table:
    """Verified links of a cell's two blocks (or one with itself); nodes that share buckets meet in the first only."""
    key, low, high = (cell.column(c)[0].as_py() for c in ("key", "low", "high"))
    tid, root, keys = (cell.column(c).to_pylist() for c in ("tid", "root", "keys"))
    hashes, block, keys = WordHash(), cell.column("block").to_pylist(), [frozenset(k) for k in keys]
    found = [elements(b, hashes) for b in as_bytes(cell.column("text").combine_chunks())]
    left, right = ([i for i, x in enumerate(block) if x == side] for side in (low, high))
    near = _candidates(found, left, right)
    u, v = [], []
    for i, j in zip(*(np.array(side, np.int64)[at].tolist() for side, at in zip((left, right), np.nonzero(near)))):
        if (low == high and i >= j) or root[i] == root[j] or min(keys[i] & keys[j]) != key:
            continue
        if similarity(found[i], found[j]) >= SIMILAR:
            u.append(tid[i])
            v.append(tid[j])
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def _cross_links(docs: DataFrame, nodes: DataFrame, rest: DataFrame) -> DataFrame:
    """Links between any two nodes of a bucket that are of different components; the blocks of a bucket meet in cells."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rest.groupBy("tid").agg(F.collect_set("key").alias("keys")).join(_text_of(docs, nodes, rest.select("tid").distinct()), "tid")
    placed = rest.withColumn("block", F.pmod(F.xxhash64("tid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = placed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tid", "root").join(own, "tid")
    return cells.groupBy("key", "low", "high").applyInArrow(_cell_links, "u binary, v binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tid (its text's id), class_id (the least doc_id of its class), kept; one row a row.

    ``kept`` marks the (doc_id, tid) that stands for the class.
    """
    rows = stage(_banded(docs))
    nodes = stage(rows.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    dealt = nodes.select("tid", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64(F.col("band") % ORDERS, "tid")
    pivots = dealt.groupBy("key").agg(F.min_by("tid", order).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    met = stage(dealt.join(pivots, "key").where("tid <> pivot").select("key", "tid", "pivot", "n"))
    pairs = stage(met.select(F.col("tid").alias("a"), F.col("pivot").alias("b")).distinct())
    links = stage(_verified(_with_texts(docs, nodes, pairs)))
    roots = connected_components(links)
    rest = met.where("n > 2").select("key", "tid")
    for _ in range(HUBS):
        rest = stage(_open(rest, roots, links))
        ends = [F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")]
        new = stage(_hub_pairs(rest).select("a", "b", *ends).join(pairs.select(*ends), ["x", "y"], "left_anti").select("a", "b"))
        rest = rest.where("tid <> hub").select("key", "tid")
        if new.isEmpty():
            break
        pairs, links = pairs.union(new), links.union(stage(_verified(_with_texts(docs, nodes, new))))
        roots = connected_components(links)
    rest = stage(_open(rest, roots, links))
    if not rest.isEmpty():
        roots = connected_components(links.union(stage(_cross_links(docs, nodes, rest))))
    grouped = nodes.select("tid", "rep").join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "rep", F.coalesce("root", "tid").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "tid")).alias("head"))
    classes = grouped.join(heads, "root").select("tid", "class_id", F.col("head.rep").alias("head_rep"), (F.col("head.tid") == F.col("tid")).alias("head"))
    kept = F.col("head") & F.col("doc_id").eqNullSafe(F.col("head_rep"))
    return rows.select("doc_id", "tid").join(classes, "tid").select("doc_id", "tid", "class_id", kept.alias("kept"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "kept")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, all columns kept."""
    columns = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").cast("long").alias("k_id"), text_id().alias("k_tid"))
    stay = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("s_id"), F.col("tid").alias("s_tid")).distinct()
    found = own.join(stay, own["k_id"].eqNullSafe(stay["s_id"]) & (own["k_tid"] == stay["s_tid"])).select("row", "k_id", "k_tid")
    nth = F.row_number().over(Window.partitionBy("k_id", "k_tid").orderBy(F.lit(1)))
    return found.withColumn("nth", nth).where("nth = 1").select("row.*")
