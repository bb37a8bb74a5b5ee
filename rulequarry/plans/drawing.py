"""Samplers, folds, grids and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining, rules, sampling
from ..sources import files
from .base import MEASURED, RULES, TX, held, measured, one, query, r6, table, total


@query("SELECT o_orderkey AS tid, (('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM orders")
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.kfold(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid")), ["tid"], 5)


@query("WITH f AS (SELECT ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5 AS own FROM orders) SELECT r::INTEGER AS fold, CASE WHEN own = r THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM f CROSS JOIN range(5) t(r) GROUP BY ALL")
def train_test_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_test(kfold_split(spark, sf_dir), 5).groupBy("fold", "split").agg(F.count("*").alias("n"))


RANDOM = "WITH " + TX + """, o AS (SELECT DISTINCT tid FROM tx), picked AS (SELECT tid FROM o ORDER BY md5('1|' || tid), tid LIMIT 60),
own AS (SELECT tid, item FROM tx SEMI JOIN picked USING (tid)),
xs AS (SELECT tid, string_agg(item, ';' ORDER BY item) AS x, list(item) AS items FROM own WHERE item NOT LIKE 'status=%' AND substr(md5('1|' || tid || '|' || item), 1, 8) < '80000000' GROUP BY tid),
ys AS (SELECT tid, arg_min(item, md5('1|' || tid || '|' || item)) AS y FROM own WHERE item LIKE 'status=%' GROUP BY tid),
cand AS (SELECT DISTINCT x, y, items FROM xs JOIN ys USING (tid)), c2 AS (SELECT x, y, any_value(items) AS items FROM cand GROUP BY x, y),
b AS (SELECT tid, list(item) AS all_ FROM tx GROUP BY tid),
f AS (SELECT x, y, count(*) FILTER (WHERE list_has_all(all_, items)) AS fx, count(*) FILTER (WHERE list_contains(all_, y)) AS fy, count(*) FILTER (WHERE list_has_all(all_, items) AND list_contains(all_, y)) AS fz FROM c2 CROSS JOIN b GROUP BY x, y)
SELECT x || '=>' || y AS rule_id, fx, fy, fz FROM f WHERE least(fx, fy, fz) > 0 AND greatest(fx, fy, fz) < (SELECT count(*) FROM orders) ORDER BY 1 LIMIT 20"""


@query(RANDOM)
def random_valid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read off random transactions, with their frequencies, if these are neither none nor all."""
    t = files.kept(held(spark, sf_dir))  # three passes over it
    found = files.with_frequencies(sampling.random_rules(t, 60), t).crossJoin(F.broadcast(total(spark, sf_dir)))  # one row
    return found.where(rules.is_nontrivial()).select("rule_id", "fx", "fy", "fz").orderBy("rule_id").limit(20)


@query("WITH " + RULES + " SELECT rule_id FROM r ORDER BY md5('9|' || rule_id), rule_id LIMIT 25")
def hash_sampled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(one(spark, sf_dir).select("rule_id"), 25, "9")


@query("SELECT round(1.0 + i * 0.5, 6)::DOUBLE AS v0, round(-1.0 + j * 0.5, 6)::DOUBLE AS v1 FROM range(5) a(i) CROSS JOIN range(5) b(j)")
def alternatives_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.grid([1.0, -1.0], [3.0, 1.0], 25, spark).select(r6(F.col("v")[0]).alias("v0"), r6(F.col("v")[1]).alias("v1"))


def _walkable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return held(spark, sf_dir), table(spark, sf_dir, "orders").count()


@query()
def smas_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _walkable(spark, sf_dir)
    return sampling.smas(found, n).select("x", "y", r6("score").alias("score"))


@query()
def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _walkable(spark, sf_dir)
    return sampling.smas(found, n, halve=True, seed="2").select("x", "y", r6("score").alias("score"))


@query()
def random_grown_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _walkable(spark, sf_dir)
    return sampling.random_sample(found, n)


@query()
def gibbs_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _walkable(spark, sf_dir)
    return sampling.gibbs(found, n)


@query()
def mmas_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _walkable(spark, sf_dir)
    return sampling.mmas(found, n).select("a", "b", r6("uncertainty").alias("uncertainty"))



@query("WITH " + RULES + " SELECT '{' || x || '}' AS antecedent, '{' || y || '}' AS consequent, fx AS \"freqX\", fy AS \"freqY\", fz AS \"freqZ\" FROM r")
def mined_rules_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined rules in the form in which they are written."""
    return files.rule_columns(one(spark, sf_dir))


@query("WITH " + RULES + " SELECT '{\"antecedent\":[\"' || x || '\"],\"consequent\":\"' || y || '\",\"fx\":' || fx || ',\"fy\":' || fy || ',\"fz\":' || fz || '}' AS json FROM r")
def rule_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rule_json(one(spark, sf_dir))


@query("WITH " + RULES + " SELECT rule_id, fx, fy, fz FROM r")
def recounted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of given rules counted anew through item-set covers."""
    t = files.kept(held(spark, sf_dir))  # the rules are mined on it, then counted
    return files.with_frequencies(mining.one_item_rules(t, total(spark, sf_dir)).select("x", "y"), t).select("rule_id", "fx", "fy", "fz")


@query("WITH " + MEASURED + " SELECT '[' || x || '] => [' || y || ']' AS \"Rule\", round(confidence, 6) + 0.0 AS confidence, round(lift, 6) + 0.0 AS lift FROM m ORDER BY round(confidence, 9) DESC, rule_id LIMIT 50")
def sample_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.top_k(measured(spark, sf_dir).withColumn("k", F.round("confidence", 9)), "k", 50)
    return df.select(rules.text().alias("Rule"), r6("confidence").alias("confidence"), r6("lift").alias("lift"))
