"""Selection of informative rule pairs.

Questions about the gap of one score are answered along the sorted scores, where the best pair is always one of
neighbours; only questions about a target certainty compare all pairs of a candidate pool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_pairs(pool: DataFrame, key: str, *columns: str) -> DataFrame:
    """(a, b) of every unordered pair, with the columns of both sides suffixed _a and _b."""
    left = pool.select(F.col(key).alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = pool.select(F.col(key).alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return left.join(right, F.col("a") < F.col("b"))


def closest_pair(pool: DataFrame, score: str, key: str = "rule_id") -> DataFrame:
    """The pair with the smallest difference of scores: neighbours in sorted order suffice.  (a, b, gap)."""
    w = Window.orderBy(score, key)
    near = pool.select(F.lag(key).over(w).alias("p"), F.col(key).alias("q"), (F.col(score) - F.lag(score).over(w)).alias("gap")).where("p is not null")
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "gap").orderBy("gap", "a", "b").limit(1)


def nearest_gaps(pool: DataFrame, score: str, key: str = "rule_id") -> DataFrame:
    """Each rule's distance to the nearest other score, and 1 minus it: (rule_id, gap, closeness)."""
    w = Window.orderBy(score, key)
    gap = F.least(F.col(score) - F.lag(score).over(w), F.lead(score).over(w) - F.col(score))
    return pool.select(key, gap.alias("gap")).withColumn("closeness", 1 - F.col("gap"))


def best_pair(pairs: DataFrame, by: Column, *, most: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pair with the least (or greatest) value; ties by (a, b)."""
    ranked = pairs.withColumn("value", by)
    return ranked.orderBy(F.col("value").desc() if most else F.col("value"), "a", "b").limit(1).select("a", "b", "value", *keep)


def target_pair(pool: DataFrame, score: str, certainty: Callable[[Column, Column], Column], target: float, key: str = "rule_id") -> DataFrame:
    """The pair whose certainty is closest to a target."""
    pairs = all_pairs(pool, key, score)
    return best_pair(pairs, F.abs(certainty(F.col(f"{score}_a"), F.col(f"{score}_b")) - F.lit(target)))


def unasked(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs that are not in ``asked`` (columns a, b)."""
    return pairs.join(asked.select("a", "b"), ["a", "b"], "left_anti")


def inconsistent_pair(asked: DataFrame, theta: Column) -> DataFrame:
    """Of the answered pairs (winner, loser, s_w, s_l) that the model ranks the other way round, the one of greatest theta."""
    wrong = asked.where("s_w < s_l").withColumn("value", theta)
    return wrong.orderBy(F.col("value").desc(), "winner", "loser").limit(1)


def against_history(pool: DataFrame, history: DataFrame, score: str, theta: Callable[[Column, Column], Column], key: str = "rule_id") -> DataFrame:
    """Each rule's greatest uncertainty against a short history (column ``h_score``); 0 without a history."""
    cross = pool.join(history.select("h_score"), how="left")
    return cross.groupBy(key).agg(F.coalesce(F.max(theta(F.col(score), F.col("h_score"))), F.lit(0.0)).alias("value"))
