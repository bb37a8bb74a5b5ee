"""Files written and read again: every sink with the source that belongs to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..sources import files
from .base import MEASURED, RULES, measured, one, query, r6, table

FLAGS = """flags AS (SELECT p_partkey AS k, list_filter([CASE WHEN p_size > 25 THEN '1' END, CASE WHEN p_retailprice > 1000 THEN '2' END, CASE WHEN p_brand < 'Brand#3' THEN '3' END,
  (3 + (SELECT count(DISTINCT q.p_type) FROM part q WHERE q.p_type <= part.p_type))::VARCHAR], lambda x: x IS NOT NULL) AS items FROM part)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, items): parts as lines of column numbers."""
    part = table(spark, sf_dir, "part")
    columns = part.select(F.col("p_partkey").alias("k"), (F.col("p_size") > 25).cast("int").alias("large"), (F.col("p_retailprice") > 1000).cast("int").alias("dear"), (F.col("p_brand") < "Brand#3").cast("int").alias("early"), F.col("p_type").alias("class"))
    return files.encode_onehot(columns, "class", keep=("k",))


@query("WITH " + FLAGS + " SELECT k, array_to_string(items, ' ') AS line FROM flags")
def encode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and a class column as lines of column numbers."""
    return flags(spark, sf_dir).select("k", F.array_join("items", " ").alias("line"))


@query("WITH " + FLAGS + " SELECT array_to_string(items, ' ') AS line, count(*) AS n FROM flags GROUP BY 1")
def dat_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as a text file of lines."""
    path = files.work_dir(spark)
    files.write_dat(flags(spark, sf_dir), path)
    return files.read_dat(spark, path).groupBy(F.array_join("items", " ").alias("line")).agg(F.count("*").alias("n"))


@query("WITH " + FLAGS + """, own AS (SELECT items, (('0x' || substr(md5('42|' || k), 1, 8))::BIGINT % 4)::INTEGER AS own FROM flags)
SELECT r::INTEGER AS fold, CASE WHEN own = r THEN 'test' ELSE 'train' END AS split, array_to_string(items, ' ') AS line, count(*) AS n FROM own CROSS JOIN range(4) t(r) GROUP BY ALL""")
def folds_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test parts of four folds, a folder each."""
    path = files.work_dir(spark)
    files.write_folds(sampling.train_test(sampling.kfold(flags(spark, sf_dir), ["k"], 4), 4), path)
    return files.read_folds(spark, path).groupBy("fold", "split", F.array_join("items", " ").alias("line")).agg(F.count("*").alias("n"))


@query("WITH " + FLAGS + " SELECT array_to_string(items, ' ') AS line, count(*) AS n FROM flags WHERE ('0x' || substr(md5('42|' || k), 1, 8))::BIGINT % 4 = 2 GROUP BY 1")
def one_split_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold's test part alone: only its folder is read."""
    path = files.work_dir(spark)
    files.write_folds(sampling.train_test(sampling.kfold(flags(spark, sf_dir), ["k"], 4), 4), path)
    return files.read_folds(spark, path, "test").where("fold = 2").groupBy(F.array_join("items", " ").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey || ' ' || n_name || ' ' || n_regionkey AS line FROM nation")
def csv_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV table turned into lines of its values."""
    path = files.work_dir(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(f"{path}/csv", header=True)
    files.csv_to_dat(spark, f"{path}/csv", f"{path}/dat")
    return spark.read.text(f"{path}/dat").select(F.col("value").alias("line"))


@query("WITH " + RULES + " SELECT x, y FROM r")
def mined_rules_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.work_dir(spark)
    files.write_mined_rules(one(spark, sf_dir), path)
    return files.read_mined_rules(spark, path)


@query("WITH " + RULES + " SELECT [x] AS antecedent, y AS consequent, fx, fy, fz FROM r")
def rule_json_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.work_dir(spark)
    files.write_rule_json(one(spark, sf_dir), path)
    return spark.read.schema("antecedent array<string>, consequent string, fx bigint, fy bigint, fz bigint").json(path)


@query("WITH " + MEASURED + " SELECT i::INTEGER AS iteration, 'd' AS dataset, i::INTEGER % 2 AS fold, 'one' AS algorithm, 'lift' AS oracle, round(avg(lift) * i, 6) + 0.0 AS score, round(min(confidence), 6) + 0.0 AS confidence FROM m CROSS JOIN range(4) t(i) GROUP BY i")
def score_log_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of scores, one append an iteration from 0 on, read back with its folders as columns."""
    path = files.work_dir(spark)
    mean = files.kept(measured(spark, sf_dir).agg(F.avg("lift").alias("lift"), F.min("confidence").alias("confidence")))  # mined once, logged four times
    for i in range(4):
        row = mean.select(F.lit("d").alias("dataset"), F.lit(i % 2).alias("fold"), F.lit("one").alias("algorithm"), F.lit("lift").alias("oracle"), F.lit(i).alias("iteration"), r6(F.col("lift") * i).alias("score"), r6("confidence").alias("confidence"))
        files.append_log(row, path)
    return files.read_log(spark, path).select("iteration", "dataset", F.col("fold").cast("int").alias("fold"), "algorithm", "oracle", "score", "confidence")


@query("SELECT i::INTEGER AS iteration, round((SELECT count(*) FILTER (WHERE o_orderkey % 10 < i) / count(*) FROM orders), 6) + 0.0 AS accuracy FROM range(10) t(i)")
def accuracy_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.work_dir(spark)
    orders = table(spark, sf_dir, "orders").crossJoin(spark.range(10).select(F.col("id").cast("int").alias("iteration")))
    files.write_accuracy(orders.groupBy("iteration").agg(r6(F.avg((F.col("o_orderkey") % 10 < F.col("iteration")).cast("int"))).alias("accuracy")), path)
    return spark.read.schema("iteration int, accuracy double").csv(path, header=True)


@query("WITH " + MEASURED + " SELECT '[' || x || '] => [' || y || ']' AS \"Rule\", round(confidence, 6) + 0.0 AS confidence, round(lift, 6) + 0.0 AS lift, round(lift, 6) + 0.0 AS \"scoreApprox\" FROM m")
def sample_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampler's log, whose fields are told apart from the right: a rule may hold the separator."""
    path = files.work_dir(spark)
    df = measured(spark, sf_dir).withColumns({"confidence": r6("confidence"), "lift": r6("lift")})
    files.write_sample(df, ["confidence", "lift"], "lift", path)
    return files.read_sample(spark, path, ["confidence", "lift"])


@query("""SELECT (n_nationkey + 1)::BIGINT AS alternative, [n_nationkey / 2.0, n_regionkey + 0.0]::DOUBLE[] AS v, 2::INTEGER AS additivity, 'gls' AS approach FROM nation""")
def preferences_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives and preferences as one JSON object, as a solver of capacities takes them."""
    path = files.work_dir(spark)
    nation = table(spark, sf_dir, "nation")
    alternatives = nation.select(F.col("n_nationkey").alias("id"), F.array(F.col("n_nationkey") / 2.0, F.col("n_regionkey") + F.lit(0.0)).alias("v"))
    preferences = nation.where("n_nationkey > 0").select(F.col("n_nationkey").alias("winner"), (F.col("n_nationkey") - 1).alias("loser"))
    files.write_preferences_json(alternatives, preferences, path, delta=0.05)
    back = files.read_preferences_json(spark, path)
    told = back.where(F.size("preferences") == F.size("alternatives") - 1)
    return told.select(F.posexplode("alternatives").alias("i", "v"), "kAdditivity", "approachType").select((F.col("i") + 1).cast("bigint").alias("alternative"), "v", F.col("kAdditivity").alias("additivity"), F.col("approachType").alias("approach"))
