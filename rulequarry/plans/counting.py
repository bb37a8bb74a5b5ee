"""Counting, covers, mining and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures, scores
from ..operators import mining, rules, transactions
from .base import ALL, FIVE, MEASURED, RULES, SCORED, SMOOTH, TX, held, measured, measures_sql, one, query, r6, round_sql, scored, table, total, tx

SETS = [("s1", ["prio=1-URGENT"]), ("s2", ["seg=BUILDING", "status=F"]), ("s3", ["prio=1-URGENT", "seg=BUILDING", "status=O"]), ("s4", ["no=such"]), ("s5", ["status=F", "status=O"])]
SETS_SQL = "sets(set_id, items) AS (VALUES " + ", ".join(f"('{i}', [{', '.join(repr(x) for x in items)}])" for i, items in SETS) + ")"


def _sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SETS, "set_id string, items array<string>")


@query("WITH " + RULES + ", " + measures_sql(0.0) + " SELECT rule_id, x, y, fx, fy, fz, round(confidence, 6) + 0.0 AS confidence, round(lift, 6) + 0.0 AS lift FROM m ORDER BY round(lift, 9) DESC, rule_id LIMIT 20")
def top_rules_by_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_measures(one(spark, sf_dir), ["confidence", "lift"])
    top = rules.top_k(df.withColumn("key", F.round("lift", 9)), "key", 20)
    return top.select("rule_id", "x", "y", "fx", "fy", "fz", r6("confidence").alias("confidence"), r6("lift").alias("lift"))


@query("WITH " + TX + " SELECT item, f, round(f::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM freq")
def item_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.item_frequency(tx(spark, sf_dir)).crossJoin(F.broadcast(total(spark, sf_dir))).select("item", "f", F.round(F.col("f") / F.col("n"), 6).alias("share"))


@query("WITH " + TX + " SELECT item FROM freq WHERE item NOT LIKE 'status=%'")
def antecedent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx(spark, sf_dir)
    return transactions.antecedent_items(t, t.where(transactions.is_class()).select("item").distinct())


@query("WITH " + TX + " SELECT DISTINCT item FROM tx WHERE item LIKE 'status=%'")
def class_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).where(transactions.is_class()).select("item").distinct()


@query("WITH " + TX + ", " + SETS_SQL + """, i AS (SELECT set_id, len(items) AS k, unnest(items) AS item FROM sets)
SELECT set_id, tid FROM i JOIN tx USING (item) GROUP BY set_id, tid, k HAVING count(*) = k""")
def itemset_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.itemset_covers(_sets(spark), held(spark, sf_dir))


COVER_SIZE = "WITH " + TX + ", " + SETS_SQL + """, i AS (SELECT set_id, len(items) AS k, unnest(items) AS item FROM sets),
c AS (SELECT set_id, tid FROM i JOIN tx USING (item) GROUP BY set_id, tid, k HAVING count(*) = k)
SELECT set_id, count(tid) AS f FROM sets LEFT JOIN c USING (set_id) GROUP BY set_id"""


@query(COVER_SIZE)
def itemset_cover_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.cover_sizes(_sets(spark), held(spark, sf_dir))


@query(COVER_SIZE)
def itemset_cover_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sizes by AND over packed covers; order keys serve as row positions, and orders of one bucket meet in one task."""
    rows = transactions.order_baskets(spark, sf_dir, F.bitmap_bucket_number("tid"))
    packed = transactions.packed_covers(rows.select(F.col("tid").alias("pos"), F.col("block").alias("bucket"), F.explode("items").alias("item")))
    return transactions.packed_itemset_sizes(_sets(spark), packed)


@query("WITH " + TX + """ SELECT 's2+' AS set_id, count(*) AS f FROM (SELECT tid FROM tx WHERE item IN ('seg=BUILDING', 'status=F', 'prio=5-LOW') GROUP BY tid HAVING count(*) = 3)""")
def cover_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover after one more item: a semi join with the item's own cover."""
    t = tx(spark, sf_dir)
    base = transactions.itemset_covers(spark.createDataFrame([("s2+", ["seg=BUILDING", "status=F"])], "set_id string, items array<string>"), t)
    wider = transactions.extend_cover(base, t, "prio=5-LOW")
    return spark.createDataFrame([("s2+",)], "set_id string").join(wider.groupBy("set_id").agg(F.count("*").alias("f")), "set_id", "left").select("set_id", F.coalesce("f", F.lit(0)).alias("f"))


@query("WITH " + TX + """, b AS (SELECT tid, list(item) AS items FROM tx GROUP BY tid)
SELECT tid FROM b WHERE list_has_all(items, ['seg=BUILDING', 'status=F'])""")
def containment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive recount of a cover: a scan over whole transactions."""
    return held(spark, sf_dir).where(transactions.contains_all("items", ["seg=BUILDING", "status=F"])).select("tid")


@query("WITH " + TX + " SELECT tid, len(list(item)) AS size, string_agg(item, ';' ORDER BY item) AS items FROM tx GROUP BY tid")
def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).select("tid", F.size("items").cast("bigint").alias("size"), F.array_join("items", ";").alias("items"))


@query("WITH RECURSIVE " + TX + """, e AS (SELECT DISTINCT a.item AS i, b.item AS j FROM tx a JOIN tx b USING (tid)),
c AS (SELECT item AS i, item AS root FROM freq UNION SELECT e.j, c.root FROM c JOIN e ON e.i = c.i)
SELECT i AS item, min(root) AS component FROM c GROUP BY i""")
def item_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.item_components(held(spark, sf_dir))


@query("WITH " + RULES + " SELECT rule_id, x, y, fx, fy, fz, n FROM r")
def rule_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).select("rule_id", "x", "y", "fx", "fy", "fz", "n")


@query("WITH " + RULES + " SELECT rule_id FROM r WHERE fz > 0 AND fx > 0 AND fy > 0 AND x <> '' AND fz < n AND fx < n AND fy < n")
def valid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).where(rules.is_valid() & rules.is_nontrivial()).select("rule_id")


@query("WITH " + RULES + " SELECT rule_id, '[' || replace(x, ';', '; ') || '] => [' || y || ']' AS text FROM r")
def rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).select("rule_id", rules.text().alias("text"))


@query("WITH " + RULES + ", d AS (SELECT *, row_number() OVER (PARTITION BY fx, fy, fz ORDER BY rule_id) AS k FROM r) SELECT rule_id, fx, fy, fz FROM d WHERE k = 1 ORDER BY rule_id LIMIT 200")
def distinct_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.distinct_by_frequency(one(spark, sf_dir)).select("rule_id", "fx", "fy", "fz")


def _mine_sql(size: int, least: int, confidence: float) -> str:
    xs = [f"a{i}.item" for i in range(size)]
    joins = " ".join(f"JOIN tx a{i} ON a{i}.tid = a0.tid AND a{i}.item > a{i - 1}.item AND a{i}.item NOT LIKE 'status=%'" for i in range(1, size))
    x = " || ';' || ".join(xs)
    return f"""WITH {TX}, sets AS (
  SELECT a0.tid, {x} AS x FROM tx a0 {joins} WHERE a0.item NOT LIKE 'status=%'
), fx AS (SELECT x, count(*) AS fx FROM sets GROUP BY x), joint AS (
  SELECT x, item AS y, count(*) AS fz FROM sets JOIN tx USING (tid) WHERE item LIKE 'status=%' GROUP BY x, item
)
SELECT x || '=>' || y AS rule_id, x, y, fx, f AS fy, fz FROM joint JOIN fx USING (x) JOIN freq ON item = y WHERE fz >= {least} AND fz * 100.0 >= fx * {confidence:e}"""


@query(_mine_sql(1, 10, 1.0))
def mine_rules_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mine(held(spark, sf_dir), least=10, confidence=1.0, most=1).drop("size")


@query(_mine_sql(2, 10, 1.0))
def mine_rules_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mine(held(spark, sf_dir), least=10, confidence=1.0, most=2).where("size = 2").drop("size")


@query(_mine_sql(3, 20, 30.0))
def mine_rules_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mine(held(spark, sf_dir), least=20, confidence=30.0, most=3).where("size = 3").drop("size")


@query()
def mine_rules_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbounded antecedents by FP-growth, for comparison with the level-wise miner."""
    return mining.growth_rules(held(spark, sf_dir), 0.01, 0.3).select("x", "y", r6("confidence").alias("confidence"), r6("support").alias("support"))


@query("""WITH ev AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS tid, event_type, value FROM events),
tx AS (SELECT DISTINCT tid, 'event=' || event_type AS item FROM ev UNION SELECT tid, CASE WHEN round(sum(value), 6) >= 100 THEN 'spend=hi' ELSE 'spend=lo' END FROM ev GROUP BY tid),
f AS (SELECT item, count(*) AS f FROM tx GROUP BY item)
SELECT a.item AS x, b.item AS y, any_value(p.f) AS fx, any_value(q.f) AS fy, count(*) AS fz FROM tx a JOIN tx b USING (tid) JOIN f p ON p.item = a.item JOIN f q ON q.item = b.item
WHERE a.item LIKE 'event=%' AND b.item LIKE 'spend=%' GROUP BY a.item, b.item""")
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a second kind of transactions: a user's day of events and its spending class."""
    t = transactions.event_items(spark, sf_dir)
    return mining.mine(t, transactions.is_class(prefix="spend="), most=1).select("x", "y", "fx", "fy", "fz")


@query("WITH " + RULES + ", " + measures_sql(0.0) + " SELECT rule_id, " + round_sql(ALL) + " FROM m")
def measures_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, 0.0).select("rule_id", *(r6(c).alias(c) for c in ALL))


@query("WITH " + MEASURED + " SELECT rule_id, " + round_sql(ALL) + " FROM m")
def measures_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", *(r6(c).alias(c) for c in ALL))


for _name in ALL:

    def _measure(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return measured(spark, sf_dir, names=[name]).select("rule_id", r6(name).alias("value"))

    query("WITH " + MEASURED + f' SELECT rule_id, round("{_name}", 6) + 0.0 AS value FROM m', f"measure_{_name}")(_measure)


@query("WITH " + MEASURED + " SELECT rule_id, round(odds, 6) + 0.0 AS odds FROM m")
def odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).select("rule_id", r6(measures.odds_ratio(measures.contingency(smooth=SMOOTH))).alias("odds"))


@query("WITH " + MEASURED + """, e AS (SELECT * FROM m UNION ALL SELECT 'empty:' || y, '', y, 0, fy, 0, n, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT y, fy, n FROM m))
SELECT rule_id, """ + ", ".join(f'round(CASE WHEN x = \'\' THEN 0 ELSE "{c}" END, 6) + 0.0 AS "{c}"' for c in ALL) + " FROM e")
def rule_vector_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of measures, zeros for a rule without an antecedent."""
    df = one(spark, sf_dir)
    bare = df.select("y", "fy", "n").distinct().select(F.concat(F.lit("empty:"), "y").alias("rule_id"), F.lit("").alias("x"), "y", F.lit(0).cast("bigint").alias("fx"), "fy", F.lit(0).cast("bigint").alias("fz"), "n")
    v = df.unionByName(bare).select("rule_id", measures.vector(ALL, SMOOTH).alias("v"))
    return v.select("rule_id", *(r6(F.col("v")[i]).alias(c) for i, c in enumerate(ALL)))


@query("WITH " + MEASURED + " SELECT DISTINCT round(confidence, 3) + 0.0 AS c, round(lift, 3) + 0.0 AS l, round(support, 3) + 0.0 AS s FROM m")
def distinct_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select(r6("confidence", 3).alias("c"), r6("lift", 3).alias("l"), r6("support", 3).alias("s")).distinct()


@query("WITH " + MEASURED + " SELECT count(*) AS n, sum((phi < -1 OR phi > 1)::INT)::BIGINT AS phi_out, sum((pavillon < -0.5 OR pavillon > 1)::INT)::BIGINT AS pavillon_out, sum((lift < 0)::INT)::BIGINT AS lift_out FROM m")
def measure_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda c: F.sum((~measures.in_range(c, c, 0.0)).cast("bigint")).alias(f"{c}_out")
    return measured(spark, sf_dir).agg(F.count("*").alias("n"), out("phi"), out("pavillon"), out("lift"))


@query("WITH " + MEASURED + """, v AS (SELECT rule_id, unnest(['confidence', 'cosine', 'support']) AS name, unnest([confidence, cosine, support]) AS v FROM m)
SELECT rule_id, string_agg(name, ',' ORDER BY v, name) AS ascending FROM v GROUP BY rule_id""")
def sorted_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of three measures in ascending order of their values."""
    line = F.array_sort(F.array(*(F.struct(F.col(c).alias("v"), F.lit(c).alias("c")) for c in ("confidence", "cosine", "support"))))
    return measured(spark, sf_dir).select("rule_id", F.array_join(F.transform(line, lambda e: e["c"]), ",").alias("ascending"))


@query("WITH " + RULES + """, k AS (SELECT rule_id, x, y, fx::DOUBLE + fy + fz AS t FROM r) SELECT rule_id, round((t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()), 6) + 0.0 AS score FROM k""")
def search_space_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = one(spark, sf_dir).select("rule_id", (F.col("fx") + F.col("fy") + F.col("fz")).cast("double").alias("t"))
    edge = df.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return df.crossJoin(F.broadcast(edge)).select("rule_id", r6((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))  # one row


@query("WITH " + SCORED + " SELECT rule_id, round(a, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rule_id) AS k FROM s) WHERE k = 1 ORDER BY a DESC, rule_id LIMIT 10")
def top_k_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rules, one per score."""
    return rules.top_k(scored(spark, sf_dir), "a", 10, collapse=True).select("rule_id", r6("a").alias("score"))
