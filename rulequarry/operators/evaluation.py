"""Evaluation of learned rankings: ranks, precision and regret at k, rank correlations, distributions, graph statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, scores: dict[str, str], key: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Adds a rank column per score: 1 is the greatest, ties in order of the key."""
    return df.withColumns({out: F.row_number().over(Window.partitionBy(*partition).orderBy(F.col(s).desc(), *key)) for s, out in scores.items()})


def cutoff(n: Column, share: float) -> Column:
    """How many are the top ``share``: at least one."""
    return F.greatest(F.lit(1), F.floor(n * share)).cast("bigint")


def precision_at(df: DataFrame, share: float, partition: Sequence[str], approx: str = "rank_approx", oracle: str = "rank_oracle") -> DataFrame:
    """(partition, k, precision): the share of the approximate top k that is in the oracle's."""
    sized = df.withColumn("k", cutoff(F.count("*").over(Window.partitionBy(*partition)), share))
    both = (F.col(approx) <= F.col("k")) & (F.col(oracle) <= F.col("k"))
    return sized.groupBy(*partition).agg(F.first("k").alias("k"), (F.sum(both.cast("int")) / F.first("k")).alias("precision"))


def regret_at(df: DataFrame, share: float, partition: Sequence[str], key: str, approx: str = "rank_approx", oracle: str = "rank_oracle") -> DataFrame:
    """(partition, k, regret): the share of the oracle's top k that the approximate top k misses."""
    sized = df.withColumn("k", cutoff(F.count("*").over(Window.partitionBy(*partition)), share))
    sizes = sized.groupBy(*partition).agg(F.first("k").alias("k"))
    top = sized.where(F.col(oracle) <= F.col("k")).select(*partition, key)
    missed = top.join(sized.where(F.col(approx) <= F.col("k")).select(*partition, key), [*partition, key], "left_anti")
    return sizes.join(missed.groupBy(*partition).agg(F.count("*").alias("m")), list(partition), "left").select(*partition, "k", (F.coalesce("m", F.lit(0)) / F.col("k")).alias("regret"))


def spearman(df: DataFrame, partition: Sequence[str], a: str = "rank_approx", b: str = "rank_oracle") -> DataFrame:
    return df.groupBy(*partition).agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("spearman"))


def kendall(df: DataFrame, partition: Sequence[str], key: str, a: str = "rank_approx", b: str = "rank_oracle") -> DataFrame:
    """Kendall's tau of two rankings without ties: concordant minus discordant pairs over all pairs of a partition."""
    left = df.select(*partition, F.col(key).alias("i"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    right = df.select(*partition, F.col(key).alias("j"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    on = F.expr("i < j")
    pairs = left.join(right, list(partition)).where(on) if partition else left.join(right, on)
    return pairs.groupBy(*partition).agg(F.avg(F.signum((F.col("a1") - F.col("a2")).cast("double")) * F.signum((F.col("b1") - F.col("b2")).cast("double"))).alias("tau"))


def cumulative(df: DataFrame, value: str, order: str, partition: Sequence[str] = (), out: str = "cumulative") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def unique_ratio(df: DataFrame, partition: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*partition).agg((100.0 * F.count_distinct(value) / F.count("*")).alias("unique_ratio"))


def spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """mean, population variance and the distances from the mean to both ends."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.abs(F.avg(value) - F.min(value)).alias("below"), F.abs(F.avg(value) - F.max(value)).alias("above"))


def ecdf(df: DataFrame, value: str, key: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Sorted values with i / n."""
    w = Window.partitionBy(*partition)
    return df.withColumn("share", F.row_number().over(w.orderBy(value, *key)) / F.count("*").over(w))


def weighted_cdf(df: DataFrame, score: str, weight: str) -> DataFrame:
    """(score, share): the running share of the weights in order of the score, one row per score."""
    per = df.groupBy(score).agg(F.sum(weight).alias("w"))
    return per.select(score, (F.sum("w").over(Window.orderBy(score)) / F.sum("w").over(Window.partitionBy())).alias("share"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n, upto): equal bins between the least and the greatest value; the greatest is in the last bin."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = df.crossJoin(F.broadcast(edge)).select(F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int").alias("bin"))  # one row
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def pairwise_accuracy(df: DataFrame, model: str, oracle: str, order: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The share of consecutive pairs (1st with 2nd, 3rd with 4th ...) in which model and oracle prefer the same rule."""
    numbered = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("pair", F.floor(F.col("rn") / 2))
    better = lambda s, *more: F.max_by(F.col("rn"), F.struct(F.col(s), *more))
    pairs = numbered.groupBy("pair").agg(F.count("*").alias("c"), better(model, (-F.col("rn")).alias("first")).alias("m"), better(oracle, *(F.col(t) for t in ties), (-F.col("rn")).alias("first")).alias("o")).where("c = 2")
    return pairs.agg(F.count("*").alias("pairs"), F.avg((F.col("m") == F.col("o")).cast("double")).alias("accuracy"))


def graph_statistics(nodes: DataFrame, edges: DataFrame, score: str, key: str = "rule_id") -> DataFrame:
    """nodes, edges, degrees, score differences and density of an undirected graph, in one row."""
    s = nodes.select(F.col(key), F.col(score))
    e = edges.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").withColumn("d", F.abs(F.col("sa") - F.col("sb")))
    degree = edges.select(F.col("a").alias(key)).union(edges.select(F.col("b"))).groupBy(key).agg(F.count("*").alias("deg"))
    degree = nodes.select(key).join(degree, key, "left").agg(F.count("*").alias("nodes"), F.avg(F.coalesce("deg", F.lit(0))).alias("degree_avg"), F.max(F.coalesce("deg", F.lit(0))).alias("degree_max"), F.min(F.coalesce("deg", F.lit(0))).alias("degree_min"))
    gap = e.agg(F.count("*").alias("edges"), F.avg("d").alias("diff_avg"), F.max("d").alias("diff_max"), F.min("d").alias("diff_min"))
    return degree.crossJoin(gap).withColumn("density", F.col("edges") / F.when(F.col("nodes") > 1, F.col("nodes") * (F.col("nodes") - 1) / 2))
