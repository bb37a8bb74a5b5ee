"""Rules as rows: validity, identity, text form, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures


def is_valid(x: str = "x", y: str = "y") -> Column:
    """All frequencies positive, antecedent and consequent not empty."""
    return (F.col("fz") > 0) & (F.col("fx") > 0) & (F.col("fy") > 0) & (F.length(x) > 0) & F.col(y).isNotNull()


def is_nontrivial(n: str = "n") -> Column:
    """Frequencies strictly between none and all transactions."""
    ok = F.lit(True)
    for f in ("fx", "fy", "fz"):
        ok = ok & (F.col(f) > 0) & (F.col(f) < F.col(n))
    return ok


def text(x: str = "x", y: str = "y") -> Column:
    return F.concat(F.lit("["), F.array_join(F.split(x, ";"), "; "), F.lit("] => ["), F.col(y), F.lit("]"))


def with_measures(rules: DataFrame, names: Sequence[str], smooth: float = 0.0) -> DataFrame:
    table = measures.contingency(smooth=smooth)
    return rules.withColumns({name: measures.measure(name, table) for name in names})


def distinct_by_frequency(rules: DataFrame, most: int = 200) -> DataFrame:
    """One rule of those with equal (fx, fy, fz), the first by id; at most ``most``."""
    first = rules.withColumn("__k", F.row_number().over(Window.partitionBy("fx", "fy", "fz").orderBy("rule_id"))).where("__k = 1").drop("__k")
    return first.orderBy("rule_id").limit(most)


def top_k(rules: DataFrame, score: str, k: int, collapse: bool = False, key: str = "rule_id") -> DataFrame:
    """The k best rules by (score descending, id); ``collapse`` keeps one rule per score."""
    if collapse:
        rules = rules.withColumn("__k", F.row_number().over(Window.partitionBy(score).orderBy(key))).where("__k = 1").drop("__k")
    return rules.orderBy(F.col(score).desc(), key).limit(k)


def neighbours(rules: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, between rules whose antecedents differ by one item and whose consequents agree or not.

    Dropping each item in turn gives keys on which the larger rule meets the smaller one by an equality join.
    """
    sets = rules.select("rule_id", F.when(F.length("x") > 0, F.split("x", ";")).otherwise(F.array().cast("array<string>")).alias("s"))
    less = sets.select(F.col("rule_id").alias("large"), F.explode(F.transform("s", lambda i: F.array_join(F.array_remove("s", i), ";"))).alias("key"))
    small = sets.select(F.col("rule_id").alias("small"), F.array_join("s", ";").alias("key"))
    edge = less.join(small, "key").where("large <> small")
    return edge.select(F.least("large", "small").alias("a"), F.greatest("large", "small").alias("b")).distinct()
