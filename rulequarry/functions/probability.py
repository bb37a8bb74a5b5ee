"""Distributions: shares, softmax, entropy, categorical draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """How often each value occurs, as a share of all rows: (value, share)."""
    return df.groupBy(value).agg(F.count("*").alias("__n")).select(value, (F.col("__n") / F.sum("__n").over(Window.partitionBy())).alias(out))


def softmax(df: DataFrame, q: str, temperature: float = 1.0, partition: Sequence[str] = (), out: str = "p") -> DataFrame:
    """Adds exp(q / T) over its sum, shifted by the greatest q so that nothing overflows."""
    w = Window.partitionBy(*partition)
    df = df.withColumn("__e", F.max(q).over(w)).withColumn("__e", F.exp((F.col(q) - F.col("__e")) / temperature))
    return df.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def entropy_bits(p: Column) -> Column:
    """Entropy of a column of probabilities; terms of 0 count 0."""
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def hash_coin(*parts: Column | str, seed: str) -> Column:
    """A uniform number in [0, 1) from the MD5 digest of ``seed`` and the parts: the same on every engine."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_key(*parts: Column | str, seed: str) -> Column:
    """The MD5 digest by which a reproducible shuffle sorts."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def categorical(df: DataFrame, weight: str, key: Sequence[str], coin: float) -> DataFrame:
    """The row in whose stretch of the running weight share ``coin`` falls; weights need not sum to 1."""
    w = Window.orderBy(*key)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy())
    return df.withColumn("__upto", upto).where(F.col("__upto") > coin).orderBy("__upto").limit(1).drop("__upto")
