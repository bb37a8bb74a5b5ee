"""What the queries share: their registry, common inputs, and the same inputs as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, scores
from ..operators import mining, rules, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.order_items(spark, sf_dir)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions with their items in one row."""
    return transactions.order_baskets(spark, sf_dir)


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the number of transactions."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-item rules with all frequencies."""
    return mining.one_item_rules(held(spark, sf_dir), total(spark, sf_dir))


ALL = list(measures.MEASURES)
FIVE = ["lift", "confidence", "support", "yuleQ", "kruskal"]
SMOOTH = 0.01


def measured(spark: SparkSession, sf_dir: str, smooth: float = SMOOTH, names: Sequence[str] = ALL) -> DataFrame:
    return rules.with_measures(one(spark, sf_dir), names, smooth)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the learned-like score ``a`` (mean of five measures) and the oracle's ``o`` (phi), to nine digits."""
    a = scores.linear(FIVE, [0.2] * 5)
    df = measured(spark, sf_dir)
    return df.select("rule_id", "x", "y", "fx", "fy", "fz", "n", *ALL, F.round(a, 9).alias("a"), F.round(scores.phi_score(), 9).alias("o"))


TX = """tx AS (
  SELECT o_orderkey AS tid, 'brand=' || p_brand AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  UNION SELECT o_orderkey, 'type=' || p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  UNION SELECT o_orderkey, 'prio=' || o_orderpriority FROM orders
  UNION SELECT o_orderkey, 'seg=' || c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey
  UNION SELECT o_orderkey, 'status=' || o_orderstatus FROM orders
), freq AS (SELECT item, count(*) AS f FROM tx GROUP BY item)"""

RULES = TX + """, r AS (
  SELECT a.item || '=>' || b.item AS rule_id, a.item AS x, b.item AS y, any_value(p.f) AS fx, any_value(q.f) AS fy, count(*) AS fz, (SELECT count(*) FROM orders) AS n
  FROM tx a JOIN tx b ON a.tid = b.tid JOIN freq p ON p.item = a.item JOIN freq q ON q.item = b.item
  WHERE a.item NOT LIKE 'status=%' AND b.item LIKE 'status=%' GROUP BY a.item, b.item
)"""


def measures_sql(smooth: float = SMOOTH, source: str = "r") -> str:
    s = f"{smooth:e}"
    return f"""t AS (
  SELECT rule_id, x, y, fx, fy, fz, n, fz::DOUBLE + {s} AS n11, fx::DOUBLE - fz + {s} AS n10, fy::DOUBLE - fz + {s} AS n01, n::DOUBLE - fx - fy + fz + {s} AS n00,
    fx::DOUBLE + 2 * {s} AS n1x, fy::DOUBLE + 2 * {s} AS nx1, n::DOUBLE - fx + 2 * {s} AS n0x, n::DOUBLE - fy + 2 * {s} AS nx0, n::DOUBLE + 4 * {s} AS nn FROM {source}
), t2 AS (SELECT *, n11 * n00 / nullif(n10 * n01, 0) AS odds FROM t
), m AS (
  SELECT rule_id, x, y, fx, fy, fz, n, n11 / nullif(n1x, 0) AS confidence, nn * n11 / nullif(n1x * nx1, 0) AS lift, n11 / nullif(sqrt(n1x * nx1), 0) AS cosine,
    (nn * n11 - n1x * nx1) / nullif(sqrt(n1x * nx1 * n0x * nx0), 0) AS phi,
    (greatest(n11, n10) + greatest(n01, n00) - greatest(nx1, nx0)) / nullif(nn - greatest(nx1, nx0), 0) AS kruskal,
    (odds - 1) / nullif(odds + 1, 0) AS "yuleQ", n11 / nullif(n1x, 0) - nx1 / nullif(nn, 0) AS pavillon,
    greatest((n11 / nullif(n1x, 0) - nx1 / nn) / nullif(1 - nx1 / nn, 0), (n11 / nullif(nx1, 0) - n1x / nn) / nullif(1 - n1x / nn, 0)) AS certainty,
    n11 / nullif(nn, 0) AS support, 1 - n11 / nullif(nn, 0) AS revsup, odds FROM t2
)"""


MEASURED = RULES + ", " + measures_sql()
SCORED = MEASURED + """, s AS (
  SELECT m.*, round(0.0 + lift * 2e-1 + confidence * 2e-1 + support * 2e-1 + "yuleQ" * 2e-1 + kruskal * 2e-1, 9) AS a,
    round(((n + 4e-6) * (fz + 1e-6) - (fx + 2e-6) * (fy + 2e-6)) / nullif(sqrt((fx + 2e-6) * (fy + 2e-6) * (n - fx + 2e-6) * (n - fy + 2e-6)), 0), 9) AS o FROM m
)"""


def round_sql(names: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in names)
