"""Mean and median of the values within a span before each row: n log n in the rows, not rows times their neighbours.

Rows are dealt out by key and by block of one span; a row is a value of its own block and of the next, so a block holds
every value its rows look back to, each once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BEFORE = "event_id long, grade double, n long, mean double, median double"
DECIMALS = 10_000  # grades have four decimals: sums are kept in whole units and their differences are exact


def kth(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th least (from 0) of ranks[lo:hi] for every query at once: a wavelet matrix, built and asked bit by bit."""
    found = np.zeros(len(k), dtype=np.int64)
    for bit in range(max(1, int(ranks.max()).bit_length()) - 1, -1, -1) if len(ranks) else ():
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[lo], zeros[hi]
        up = k >= b - a
        found[up] |= 1 << bit
        k = np.where(up, k - (b - a), k)
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return found


def before(us: np.ndarray, x: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and median of the x whose us is in [t - span, t), for every t of at; NaN where there is none."""
    order = np.argsort(us, kind="stable")
    us, x = us[order], x[order]
    lo, hi = np.searchsorted(us, at - span), np.searchsorted(us, at)
    n = hi - lo
    mean, median = np.full(len(at), np.nan), np.full(len(at), np.nan)
    some = np.flatnonzero(n)
    if not np.isfinite(x).all():  # sums over NaN or infinity have no differences
        for i in some.tolist():
            part = np.sort(x[lo[i] : hi[i]])
            mean[i], median[i] = part.mean(), (part[(n[i] - 1) // 2] + part[n[i] // 2]) / 2
        return n, mean, median
    total = np.concatenate([[0], np.cumsum(np.rint(x * DECIMALS).astype(np.int64))])
    mean[some] = (total[hi[some]] - total[lo[some]]) / DECIMALS / n[some]
    values, ranks = np.unique(x, return_inverse=True)
    lower = values[kth(ranks, lo[some], hi[some], (n[some] - 1) // 2)] if len(some) else values[:0]
    upper = values[kth(ranks, lo[some], hi[some], n[some] // 2)] if len(some) else values[:0]
    median[some] = (lower + upper) / 2
    return n, mean, median


def week_before(rows: DataFrame, keys: list[str], asks: str, span: int) -> DataFrame:
    """(event_id, grade, n, mean, median) of every row for which asks holds, over the grades of its keys in the span
    before it.  rows: event_id, keys, us, grade.  A row without time or key has none before it."""
    own = F.expr(f"cast(floor(us / {span}) as bigint)")
    known = F.col("us").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    asked = F.coalesce(F.expr(asks), F.lit(False))
    # a row goes on to the next block as a value alone
    blocks = F.when(known & F.col("grade").isNotNull(), F.array(own, own + 1)).otherwise(F.array(F.when(known, own)))
    dealt = rows.select(*keys, "event_id", F.when(known, F.col("us")).alias("us"), "grade", asked.alias("asked"), F.posexplode(blocks).alias("later", "block")).where("later = 0 and asked or grade is not null and us is not null")
    arrow = to_arrow_schema(StructType.fromDDL(BEFORE))

    def look_back(group: pa.Table) -> pa.Table:
        us, grade = group["us"].combine_chunks(), group["grade"].combine_chunks()
        asks = group["asked"].to_numpy() & (group["later"].to_numpy() == 0)
        value = us.is_valid().to_numpy(zero_copy_only=False) & grade.is_valid().to_numpy(zero_copy_only=False)
        time = us.fill_null(0).to_numpy(zero_copy_only=False)
        n, mean, median = before(time[value], grade.fill_null(0.0).to_numpy(zero_copy_only=False)[value], time[asks], span)
        lost = ~us.is_valid().to_numpy(zero_copy_only=False)[asks]
        n[lost] = 0
        none = n == 0
        columns = [group["event_id"].combine_chunks().filter(pa.array(asks)), grade.filter(pa.array(asks)), pa.array(n), pa.array(mean, mask=none), pa.array(median, mask=none)]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return dealt.groupBy(*keys, "block").applyInArrow(look_back, BEFORE)
