"""Mixing sources to target weights by the cube method.

Each source has a target of words; its ratio to the source's size splits into whole copies of every document and an
inclusion probability for one more.  The cube method moves the probabilities of a block through the null space of two
balancing equations (documents and words), so that all but two of the block's units become 0 or 1 while both totals
stay put.  What is left of the blocks meets again, in blocks, until one block a source is left, whose last two units
are rounded to the total nearest the target.

Null texts have no words; null sources are one source, last in order; documents without words take part like others
but take 0 words; repeated rows are units of their own; an empty table gives an empty result.  Columns other than
doc_id, text and source pass the stage untouched, whatever their names.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from basalt.llm.common import WORD_RE, documents, stage

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 2_000  # units of a block on average
MOST_BROADCAST = 50_000  # sources whose facts are sent to the tasks; more meet the units in a join


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give: shares of the total by weight, cut at most times the size, the excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), share * sum(n for _, n in order)
    fixed: dict[str | None, float] = {}
    while len(fixed) < len(order):
        left, pool = total - sum(fixed.values()), sum(w for s, w in weight.items() if s not in fixed)
        now = {s: left * weight[s] / pool for s in size if s not in fixed}
        over = {s for s, t in now.items() if t > most * size[s]}
        if not over:
            return fixed | now
        fixed |= {s: most * size[s] for s in over}
    return fixed


def flight(pi: list[float], size: list[int], rng: random.Random) -> None:
    """Fast cube flight in place: three units at a time along the null vector of (1, size), until under three can move."""
    todo, active, eps = [i for i, p in enumerate(pi) if 1e-9 < p < 1 - 1e-9], [], 1e-9
    todo.reverse()
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            return
        up = min((1 - pi[i]) / v if v > 0 else pi[i] / -v for i, v in zip(active, u) if v)
        down = min(pi[i] / v if v > 0 else (1 - pi[i]) / -v for i, v in zip(active, u) if v)
        move = up if rng.random() * (up + down) < down else -down
        rest = []
        for i, v in zip(active, u):
            p = pi[i] + move * v
            pi[i] = 0.0 if p < eps else 1.0 if p > 1 - eps else p
            if eps < pi[i] < 1 - eps:
                rest.append(i)
        if len(rest) == len(active):  # rounding kept all inside; settle the nearest
            i = min(rest, key=lambda j: min(pi[j], 1 - pi[j]))
            pi[i] = float(round(pi[i]))
            rest.remove(i)
        active = rest


def land(pi: list[float], size: list[int]) -> None:
    """Round the units still inside so that their words come nearest to what they stand for."""
    open_units = [i for i, p in enumerate(pi) if 1e-9 < p < 1 - 1e-9]
    want = sum(pi[i] * size[i] for i in open_units)
    best = min(range(1 << len(open_units)), key=lambda m: (abs(want - sum(size[i] for k, i in enumerate(open_units) if m >> k & 1)), m))
    for k, i in enumerate(open_units):
        pi[i] = float(best >> k & 1)


def _settle(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "row_hash", "size"], kind="stable", na_position="first").reset_index(drop=True)
        pi, size = rows["pi"].tolist(), rows["size"].tolist()
        rng = random.Random(f"{level}:{rows['source_key'].iloc[0]}:{rows['block'].iloc[0]}")
        flight(pi, size, rng)
        if last:
            land(pi, size)
        return rows.assign(pi=pi)

    return run


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, row_hash) -> doc_id, row_hash, size, source_size, target, copies, taken; one row a row.

    Only one row a source reaches the driver.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_RE)).cast("long")
    units = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row_hash", key.alias("source_key"), words.alias("size")))
    per = units.groupBy("source_key").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    targets = source_targets([(None if r.source_key == "n" else r.source_key[1:], r.n) for r in per])
    facts = []
    for r in per:
        t = targets[None if r.source_key == "n" else r.source_key[1:]]
        ratio = min(t / r.n, MOST) if r.n else 0.0
        whole = min(int(ratio + 1e-12), int(MOST))
        facts.append((r.source_key, r.n, float(t), whole, max(0.0, ratio - whole)))
    sent = F.broadcast if len(facts) <= MOST_BROADCAST else (lambda small: small)
    schema = "source_key string, doc_id long, row_hash long, size long, pi double, block long"
    table = spark.createDataFrame(facts, "source_key string, source_size long, target double, whole long, pi double")
    open_units = units.join(sent(table.select("source_key", "pi")), "source_key")
    counts, settled, level = {r.source_key: r.rows for r in per}, [], 0
    while counts:
        blocks = {k: -(-n // BLOCK) for k, n in counts.items()}
        last = max(blocks.values()) == 1  # (else the blocks are dealt by block, too: one source may hold a third of the rows)
        number = spark.createDataFrame(list(blocks.items()), "source_key string, blocks long")
        dealt = open_units.join(sent(number), "source_key").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "row_hash"), F.col("blocks")))
        done = stage(dealt.select("source_key", "doc_id", "row_hash", "size", "pi", "block").repartition("source_key", "block").groupBy("source_key", "block").applyInPandas(_settle(level, last), schema)).drop("block")
        settled.append(done if last else done.where("pi = 0 or pi = 1"))
        if last:
            break
        open_units = done.where("pi > 0 and pi < 1")
        counts = {r[0]: r[1] for r in open_units.groupBy("source_key").count().collect()}
        level += 1
    out = settled[0] if settled else spark.createDataFrame([], schema).drop("block")
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("pi").cast("long")).alias("copies")
    out = out.join(sent(table.drop("pi")), "source_key").select("doc_id", "row_hash", "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source").withColumn("row_hash", F.xxhash64("text"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, all columns kept."""
    columns = docs.columns
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    mixed = mix(docs.select("doc_id", "text", "source", row_hash.alias("row_hash")))
    totals = mixed.groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("total"), F.count("*").alias("alike"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").cast("long").alias("k_id"), row_hash.alias("k_hash"))
    totals = totals.select(F.col("doc_id").alias("k_id2"), F.col("row_hash").alias("k_hash"), "total", "alike")
    joined = own.join(totals, (F.col("k_id").eqNullSafe(F.col("k_id2"))) & (own["k_hash"] == totals["k_hash"])).select("row", "k_id", own["k_hash"], "total", "alike")
    nth = F.row_number().over(Window.partitionBy("k_id", "k_hash").orderBy(F.lit(1)))
    times = (F.expr("total div alike") + (nth <= F.col("total") % F.col("alike")).cast("long")).cast("int")
    return joined.withColumn("times", times).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
