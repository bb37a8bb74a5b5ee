"""Byte-balanced shards by histogram sort.

Splitters are found before any row moves, on two levels.  On the first, each round counts the exact bytes at or below
a set of candidate key boundaries in every partition, adds the counts up, and narrows the bracket of every splitter that
is not yet within tolerance; about the square root of the number of shards is found so, and that is all that the driver
probes.  On the second, the keys with their byte counts (16 bytes a row) go to the range between two such splitters,
where every key is a candidate: running counts tell the splitters inside.  Then the rows are exchanged once, straight to
their shard, and sorted there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import n_bytes, read, shared_dir, stored

SHARD_BYTES = 64 << 20
LEAST_SHARDS = 16
NULL_KEY = -(1 << 63)


def _counter(probes: np.ndarray):
    """Per partition: bytes, least and greatest key of each interval between neighbouring probes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(probes) + 1, np.int64)
        low = np.full(len(probes) + 1, np.iinfo(np.int64).max)
        high = np.full(len(probes) + 1, np.iinfo(np.int64).min)
        seen = np.zeros(len(probes) + 1, bool)
        for batch in batches:
            key, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            slot = np.searchsorted(probes, key, side="left")
            at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            hit = slot[at]
            size[hit] += np.add.reduceat(n, at)
            low[hit] = np.minimum(low[hit], key[at])
            high[hit] = np.maximum(high[hit], key[np.r_[at[1:], len(key)] - 1])
            seen[hit] = True
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(size[hit]), pa.array(low[hit]), pa.array(high[hit])], names=["slot", "n", "low", "high"])

    return count


def splitters(sizes: DataFrame, goal: np.ndarray, *, slack: float = 0.0, probes: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For each goal the least key with so many bytes at or below it, and those bytes; ``sizes`` is (k BIGINT, n BIGINT).

    A key whose bytes exceed the goal by at most ``slack`` is accepted too.  Goals ascend from 1 to the total.  Every
    round reads the narrow table once and sends one row per occupied interval between probes to the driver.
    """
    found, reached = np.zeros(len(goal), np.int64), np.zeros(len(goal), np.int64)
    if not len(goal):
        return found, reached
    a, b, total = sizes.agg(F.min("k"), F.max("k"), F.sum("n")).first()
    # bytes at or below ``lo`` < goal <= bytes at or below ``hi``; ``lo`` is the key before the first of the interval
    first, hi = np.full(len(goal), a), np.full(len(goal), b)
    reached[:] = total
    left = np.flatnonzero((first < hi) & (reached - goal > slack))
    while len(left):
        edges = [hi[left], first[left] - (first[left] > NULL_KEY)]
        width = hi[left].astype(np.float64) - first[left]
        step = (hi[left].view(np.uint64) - first[left].view(np.uint64)) // np.uint64(probes + 1)  # never overflows
        edges += [(first[left].view(np.uint64) + np.where(width > 0, step, 0).astype(np.uint64) * np.uint64(t)).view(np.int64) for t in range(0, probes + 1)]
        edge = np.unique(np.concatenate(edges))
        got = sizes.mapInArrow(_counter(edge), "slot bigint, n bigint, low bigint, high bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("slot")
        slot, upto = got["slot"].to_numpy(), np.cumsum(got["n"].to_numpy())
        at = np.searchsorted(upto, goal[left], side="left")  # the interval in which the goal is reached
        first[left], hi[left], reached[left] = got["low"].to_numpy()[at], got["high"].to_numpy()[at], upto[at]
        left = left[(first[left] < hi[left]) & (reached[left] - goal[left] > slack)]
    return hi, reached


def _inner(ends: np.ndarray, before: np.ndarray, goal: np.ndarray):
    """(j, k): the key at which goal j is reached, for rows (g, k, n) that come range by range in order of their keys.

    ``before``: bytes in front of each range.  Goals that the first level met come out the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sum_ = -1, 0
        for batch in batches:
            g, k, n = (batch.column(c).to_numpy() for c in range(3))
            edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if g[a] != own:
                    own, sum_ = int(g[a]), int(before[g[a]])
                upto = sum_ + np.cumsum(n[a:b])
                j = np.arange(np.searchsorted(goal, sum_, side="right"), np.searchsorted(goal, upto[-1], side="right"))
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(k[a + np.searchsorted(upto, goal[j], side="left")])], names=["j", "k"])
                sum_ = int(upto[-1])

    return run


def shard_ends(sizes: DataFrame, shards: int, total: int, *, tolerance: float = 0.0) -> np.ndarray:
    """The ``shards - 1`` keys that end shards, found on two levels; the driver gets 8 bytes a shard.

    Key j is the least with j/shards of the bytes at or below it.  A ``tolerance``, as a share of a shard, spares the first
    level rounds; the second is exact anyway.
    """
    goal = np.array([-(-j * total // shards) for j in range(1, shards)], np.int64)
    stride = max(1, math.isqrt(shards))
    outer = goal[stride - 1 :: stride]
    ends, reached = splitters(sizes, outer, slack=tolerance * total / shards)
    ends, at = np.unique(ends, return_index=True)
    before = np.r_[0, reached[at]]

    @F.pandas_udf("bigint")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, key.to_numpy(), side="left"))

    ranged = sizes.select(range_of("k").alias("g"), "k", "n")
    got = ranged.repartition(F.col("g")).sortWithinPartitions("g", "k").mapInArrow(_inner(ends, before, goal), "j bigint, k bigint").toArrow()
    out = np.zeros(len(goal), np.int64)
    out[got.column("j").to_numpy()] = got.column("k").to_numpy()
    return out


def histogram_sort(docs: DataFrame, *, shard_bytes: int = SHARD_BYTES, least: int = LEAST_SHARDS, key: str = "doc_id", tolerance: float = 0.0, shard_col: str = "shard") -> DataFrame:
    """All rows of ``docs`` plus a shard number; shards are key ranges of about ``shard_bytes`` bytes of text.

    There are ``least`` shards at least, of fewer bytes then.  A row with b bytes of text in front of its key belongs to
    shard b * shards // total.  Rows of one key are never split (ties stay together, so a very hot key or a very long text
    can make one shard larger and others empty).  Null key: before all others.  Null or empty text: 0 bytes.  No bytes at
    all, or an empty table: all rows in shard 0.  All columns are kept, whatever their names; one that is already called
    ``shard_col`` is replaced.  Partition p of the result is shard p, sorted by key.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NULL_KEY).cast("bigint"))
    sizes = stored(docs.select(k.alias("k"), n_bytes().alias("n")), shared_dir(spark), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, least, -(-total // shard_bytes)) if total else 1
    ends = shard_ends(sizes, shards, total, tolerance=tolerance) if shards > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def place(value: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, value.to_numpy(), side="left").astype(np.int32))

    out = docs.drop(shard_col).withColumn(shard_col, place(k) if len(ends) else F.lit(0))
    return out.repartitionById(shards, F.col(f"`{shard_col}`")).sortWithinPartitions(F.col(f"`{shard_col}`"), F.col(f"`{key}`").asc_nulls_first())


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort(read(spark, sf_dir, "documents"))


def sql(shard_bytes: int = SHARD_BYTES, least: int = LEAST_SHARDS) -> str:
    return f"""
WITH sized AS (
  SELECT coalesce(doc_id, -9223372036854775808) k, sum(coalesce(strlen(text), 0))::BIGINT n FROM documents GROUP BY 1
), placed AS (
  SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen,
    (sum(n) OVER ())::BIGINT AS total, greatest(1, {least}, ceil((sum(n) OVER ())::DOUBLE / {shard_bytes}))::BIGINT AS shards
  FROM sized
)
SELECT d.*, (CASE WHEN total = 0 THEN 0 ELSE least(shards - 1, (seen * shards) // total) END)::INTEGER AS shard
FROM documents d JOIN placed p ON coalesce(d.doc_id, -9223372036854775808) = p.k
"""
