"""Pair selection, oracles, evaluation of rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import certainty
from ..operators import evaluation as ev
from ..operators import learning, rules
from ..operators import pairs as pair_ops
from .base import RULES, SCORED, measured, one, query, r6, scored, table
from .scoring import PAIRS, THETA_SQL, all_pairs

NEAR = SCORED + ", w AS (SELECT rule_id, a, lag(rule_id) OVER (ORDER BY a, rule_id) AS p, a - lag(a) OVER (ORDER BY a, rule_id) AS gap, lead(a) OVER (ORDER BY a, rule_id) - a AS next FROM s)"


@query("WITH " + NEAR + " SELECT least(p, rule_id) AS a, greatest(p, rule_id) AS b, round(gap, 6) + 0.0 AS gap FROM w WHERE p IS NOT NULL ORDER BY w.gap, 1, 2 LIMIT 1")
def closest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair whose scores are closest, found along the sorted scores."""
    return pair_ops.closest_pair(scored(spark, sf_dir), "a").select("a", "b", r6("gap").alias("gap"))


@query("WITH " + NEAR + " SELECT rule_id, round(least(gap, next), 6) + 0.0 AS gap, round(1 - least(gap, next), 6) + 0.0 AS closeness FROM w")
def nearest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ops.nearest_gaps(scored(spark, sf_dir), "a").select("rule_id", r6("gap").alias("gap"), r6("closeness").alias("closeness"))


@query("WITH " + SCORED + """, k AS (SELECT rule_id, a, lift, confidence, support FROM s ORDER BY md5('7|' || rule_id), rule_id LIMIT 50)
SELECT l.rule_id AS a, q.rule_id AS b, round(round(abs(l.a - q.a) / nullif(abs(l.lift - q.lift) + abs(l.confidence - q.confidence) + abs(l.support - q.support), 0), 9), 6) + 0.0 AS value
FROM k l JOIN k q ON l.rule_id < q.rule_id ORDER BY round(abs(l.a - q.a) / nullif(abs(l.lift - q.lift) + abs(l.confidence - q.confidence) + abs(l.support - q.support), 0), 9) NULLS LAST, 1, 2 LIMIT 1""")
def min_gap_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 50 rules picked by digest, the pair with the least score gap per distance of measures."""
    from ..operators.sampling import hash_sample

    pool = hash_sample(scored(spark, sf_dir).select("rule_id", "a", "lift", "confidence", "support"), 50, "7")
    both = pair_ops.all_pairs(pool.withColumnRenamed("a", "s"), "rule_id", "s", "lift", "confidence", "support")
    gap = lambda c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    away = gap("lift") + gap("confidence") + gap("support")
    ranked = both.withColumn("value", F.round(gap("s") / F.when(away != 0, away), 9)).where("value is not null")
    return ranked.orderBy("value", "a", "b").limit(1).select("a", "b", r6("value").alias("value"))


@query("WITH " + PAIRS + f" SELECT a, b, round(abs(({THETA_SQL['certainty_affine']}) - 3e-1), 6) + 0.0 AS value FROM p ORDER BY round(abs(({THETA_SQL['certainty_affine']}) - 3e-1), 9), a, b LIMIT 1")
def safe_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair whose certainty is nearest to a threshold."""
    df = all_pairs(spark, sf_dir)
    best = pair_ops.best_pair(df, F.round(F.abs(certainty.score_difference(F.col("s0"), F.col("s1")) - 0.3), 9))
    return best.select("a", "b", r6("value").alias("value"))


@query("WITH " + PAIRS + f", u AS (SELECT a, b, round(1 - abs(1 - 2 * ({THETA_SQL['certainty_logistic']})), 9) AS u FROM p) SELECT a, b, round(u, 6) + 0.0 AS uncertainty FROM u ORDER BY u DESC, a, b LIMIT 10")
def most_uncertain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.round(certainty.uncertainty(certainty.bradley_terry(F.col("s0"), F.col("s1"))), 9)
    return all_pairs(spark, sf_dir).select("a", "b", u.alias("u")).orderBy(F.col("u").desc(), "a", "b").limit(10).select("a", "b", r6("u").alias("uncertainty"))


ASKED = SCORED + """, k AS (SELECT rule_id, a, o FROM s ORDER BY rule_id LIMIT 40), q AS (SELECT l.rule_id AS i, r2.rule_id AS j, l.a AS ai, r2.a AS aj, l.o AS oi, r2.o AS oj FROM k l JOIN k r2 ON l.rule_id < r2.rule_id),
asked AS (SELECT CASE WHEN oi >= oj THEN i ELSE j END AS winner, CASE WHEN oi >= oj THEN j ELSE i END AS loser, CASE WHEN oi >= oj THEN ai ELSE aj END AS s_w, CASE WHEN oi >= oj THEN aj ELSE ai END AS s_l FROM q)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the first 40 rules as answered by the oracle, with the model's scores."""
    pool = scored(spark, sf_dir).select("rule_id", "a", "o").orderBy("rule_id").limit(40)
    both = pair_ops.all_pairs(pool.withColumnsRenamed({"a": "m"}), "rule_id", "m", "o")
    first = F.col("o_a") >= F.col("o_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(pick("a", "b").alias("winner"), pick("b", "a").alias("loser"), pick("m_a", "m_b").alias("s_w"), pick("m_b", "m_a").alias("s_l"))


@query("WITH " + ASKED + " SELECT winner, loser, round(1 / (1 + exp(s_l - s_w)), 6) + 0.0 AS value FROM asked WHERE s_w < s_l ORDER BY round(1 / (1 + exp(s_l - s_w)), 9) DESC, winner, loser LIMIT 1")
def most_inconsistent_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair_ops.inconsistent_pair(_asked(spark, sf_dir), F.round(certainty.bradley_terry(F.col("s_w"), F.col("s_l")), 9))
    return found.select("winner", "loser", r6("value").alias("value"))


@query("WITH " + ASKED + " SELECT count(*) AS pairs, count(*) FILTER (WHERE s_w <> s_l) AS untied, round(avg((s_w > s_l)::INT::DOUBLE), 6) AS agreement FROM asked")
def oracle_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).agg(F.count("*").alias("pairs"), F.count(F.when(F.col("s_w") != F.col("s_l"), 1)).alias("untied"), F.round(F.avg((F.col("s_w") > F.col("s_l")).cast("double")), 6).alias("agreement"))


@query("WITH " + PAIRS + ", asked AS (SELECT a, b FROM p WHERE a LIKE 'brand=%') SELECT a, b FROM p ANTI JOIN asked USING (a, b)")
def unasked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = all_pairs(spark, sf_dir)
    return pair_ops.unasked(p.select("a", "b"), p.where("a like 'brand=%'"))


@query("WITH " + SCORED + f""", h AS (SELECT a AS h FROM s ORDER BY rule_id LIMIT 10), x AS (SELECT rule_id, a AS s0, h AS s1 FROM s CROSS JOIN h)
SELECT rule_id, round(max(1 - abs(1 - 2 * ({THETA_SQL['certainty_affine']}))), 6) + 0.0 AS value FROM x GROUP BY rule_id""")
def uncertainty_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's greatest uncertainty against ten remembered rules."""
    df = scored(spark, sf_dir).select("rule_id", "a")
    history = df.orderBy("rule_id").limit(10).select(F.col("a").alias("h_score"))
    theta = lambda a, b: certainty.uncertainty(certainty.score_difference(a, b))
    return pair_ops.against_history(df, F.broadcast(history), "a", theta).select("rule_id", r6("value").alias("value"))  # ten rows


@query("WITH " + PAIRS.replace("l.a AS s0, q.a AS s1", "l.o AS s0, q.o AS s1") + " SELECT a, b, -sign(s0 - s1)::INTEGER AS c FROM p")
def oracle_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pair_ops.all_pairs(scored(spark, sf_dir).select("rule_id", "o"), "rule_id", "o")
    return df.select("a", "b", learning.compare(F.col("o_a"), F.col("o_b")).alias("c"))


@query("WITH " + ASKED.replace("LIMIT 40", "LIMIT 12") + ", v AS (SELECT rule_id, dense_rank() OVER (ORDER BY round(confidence, 6), round(lift, 6), round(support, 6)) AS no FROM s) SELECT x.no AS a, y.no AS b, 1e-6 AS delta FROM asked JOIN v x ON x.rule_id = winner JOIN v y ON y.rule_id = loser")
def preference_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    pool = df.select("rule_id", "a", "o").orderBy("rule_id").limit(12)
    both = pair_ops.all_pairs(pool.withColumnRenamed("a", "m"), "rule_id", "m", "o")
    answers = learning.answer(both, "o")
    vectors = df.select("rule_id", F.array(F.round("confidence", 6), F.round("lift", 6), F.round("support", 6)).alias("v"))
    return learning.preference_table(answers, vectors, 1e-6).select(F.col("a").cast("bigint"), F.col("b").cast("bigint"), "delta")


RANKED = SCORED + ", k AS (SELECT rule_id, y, fz, a, o, row_number() OVER (PARTITION BY y ORDER BY a DESC, rule_id) AS ra, row_number() OVER (PARTITION BY y ORDER BY o DESC, rule_id) AS ro, count(*) OVER (PARTITION BY y) AS n FROM s)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ranks(scored(spark, sf_dir).select("rule_id", "y", "fz", "a", "o"), {"a": "rank_approx", "o": "rank_oracle"}, ["rule_id"], ["y"])


@query("WITH " + RANKED + " SELECT rule_id, y, ra AS rank_approx, ro AS rank_oracle FROM k")
def rank_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("rule_id", "y", F.col("rank_approx").cast("bigint"), F.col("rank_oracle").cast("bigint"))


def _precision_sql(share: str) -> str:
    return "WITH " + RANKED + f", c AS (SELECT *, greatest(1, floor(n * {share}::DOUBLE))::BIGINT AS kk FROM k) SELECT y, any_value(kk) AS k, round(sum((ra <= kk AND ro <= kk)::INT)::DOUBLE / any_value(kk), 6) AS precision FROM c GROUP BY y"


@query(_precision_sql("0.1"))
def precision_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.precision_at(_ranked(spark, sf_dir), 0.1, ["y"]).select("y", "k", F.round("precision", 6).alias("precision"))


@query(_precision_sql("0.01"))
def precision_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.precision_at(_ranked(spark, sf_dir), 0.01, ["y"]).select("y", "k", F.round("precision", 6).alias("precision"))


@query("WITH " + RANKED + ", c AS (SELECT *, greatest(1, floor(n * 0.1::DOUBLE))::BIGINT AS kk FROM k) SELECT y, any_value(kk) AS k, round(sum((ro <= kk AND ra > kk)::INT)::DOUBLE / any_value(kk), 6) AS regret FROM c GROUP BY y")
def regret_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.regret_at(_ranked(spark, sf_dir), 0.1, ["y"], "rule_id").select("y", "k", F.round("regret", 6).alias("regret"))


@query("WITH " + RANKED + " SELECT y, round(corr(ra, ro), 6) AS spearman FROM k GROUP BY y")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.spearman(_ranked(spark, sf_dir), ["y"]).select("y", F.round("spearman", 6).alias("spearman"))


@query("WITH " + RANKED + " SELECT p.y, round(avg(sign(p.ra - q.ra) * sign(p.ro - q.ro)), 6) AS tau FROM k p JOIN k q ON p.y = q.y AND p.rule_id < q.rule_id GROUP BY p.y")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.kendall(_ranked(spark, sf_dir), ["y"], "rule_id").select("y", F.round("tau", 6).alias("tau"))


@query("WITH " + RANKED + ", g AS (SELECT y, n, unnest(range(1, n + 1)) AS k FROM (SELECT DISTINCT y, n FROM k)), p AS (SELECT g.y, g.k, avg((k.ra <= g.k AND k.ro <= g.k)::INT) * any_value(g.n) / g.k AS p FROM g JOIN k ON k.y = g.y GROUP BY g.y, g.k) SELECT y, k, round(sum(p) OVER (PARTITION BY y ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM p")
def cumulative_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at every k, summed up from the top."""
    both = F.greatest("rank_approx", "rank_oracle").alias("k")
    w = Window.partitionBy("y").orderBy("k")
    hits = _ranked(spark, sf_dir).select("y", both).groupBy("y", "k").agg(F.count("*").alias("c"))
    every = _ranked(spark, sf_dir).select("y", F.col("rank_approx").alias("k"))
    df = every.join(hits, ["y", "k"], "left").withColumn("p", F.sum(F.coalesce("c", F.lit(0))).over(w) / F.col("k"))
    return ev.cumulative(df, "p", "k", ["y"]).select("y", F.col("k").cast("bigint").alias("k"), F.round("cumulative", 6).alias("cumulative"))


@query("WITH " + SCORED + " SELECT y, round(100.0::DOUBLE * count(DISTINCT round(a, 2)) / count(*), 6) AS unique_ratio FROM s GROUP BY y")
def unique_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unique_ratio(scored(spark, sf_dir).withColumn("v", F.round("a", 2)), ["y"], "v").select("y", F.round("unique_ratio", 6).alias("unique_ratio"))


@query("WITH " + SCORED + """, o AS (SELECT *, row_number() OVER (ORDER BY md5('5|' || rule_id), rule_id) - 1 AS rn FROM s), p AS (
  SELECT l.rn, CASE WHEN l.a >= r2.a THEN 0 ELSE 1 END AS m, CASE WHEN l.o > r2.o OR (l.o = r2.o AND (l.fz > r2.fz OR (l.fz = r2.fz AND l.rule_id >= r2.rule_id))) THEN 0 ELSE 1 END AS w FROM o l JOIN o r2 ON r2.rn = l.rn + 1 WHERE l.rn % 2 = 0)
SELECT count(*) AS pairs, round(avg((m = w)::INT::DOUBLE), 6) AS accuracy FROM p""")
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumn("h", F.md5(F.concat(F.lit("5|"), "rule_id")))
    return ev.pairwise_accuracy(df, "a", "o", ["h", "rule_id"], ["fz", "rule_id"]).select("pairs", F.round("accuracy", 6).alias("accuracy"))


BEST = "b AS (SELECT event_type, user_id % 10 AS fold, max(value) AS best, count(*)::DOUBLE AS n FROM events GROUP BY ALL)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("fold")).agg(F.max("value").alias("best"), F.count("*").cast("double").alias("n"))


@query("WITH " + BEST + " SELECT event_type, round(avg(best), 6) AS mean, round(var_pop(best), 6) AS variance, round(abs(avg(best) - min(best)), 6) AS below, round(abs(avg(best) - max(best)), 6) AS above FROM b GROUP BY event_type")
def best_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the best value, then mean and spread over runs."""
    return ev.spread(_files(spark, sf_dir), "best", ["event_type"]).select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "below", "above")))


@query("WITH " + BEST + " SELECT event_type, round(avg(n), 6) AS mean, round(var_pop(n), 6) AS variance, round(abs(avg(n) - min(n)), 6) AS below, round(abs(avg(n) - max(n)), 6) AS above FROM b GROUP BY event_type")
def sample_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.spread(_files(spark, sf_dir), "n", ["event_type"]).select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "below", "above")))


@query("WITH " + BEST + " SELECT fold, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS band FROM b GROUP BY fold")
def fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("fold").agg(F.round(F.avg("best"), 6).alias("mean"), F.round(F.stddev_pop("best"), 6).alias("band"))


@query("WITH " + BEST + " SELECT fold, " + ", ".join(f"round(avg(best) FILTER (WHERE event_type = '{t}'), 6) AS \"{t}\"" for t in ("click", "purchase", "view")) + " FROM b GROUP BY fold")
def mean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means as a table of fold by kind."""
    return _files(spark, sf_dir).groupBy("fold").pivot("event_type", ["click", "purchase", "view"]).agg(F.round(F.avg("best"), 6))


@query("WITH " + SCORED + " SELECT rule_id, round(row_number() OVER (PARTITION BY y ORDER BY a, rule_id)::DOUBLE / count(*) OVER (PARTITION BY y), 6) AS share FROM s")
def score_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ecdf(scored(spark, sf_dir), "a", ["rule_id"], ["y"]).select("rule_id", F.round("share", 6).alias("share"))


@query("WITH " + SCORED + ", w AS (SELECT round(a, 2) AS score, sum(fz) AS w FROM s GROUP BY 1) SELECT score, round(sum(w) OVER (ORDER BY score)::DOUBLE / sum(w) OVER (), 6) AS share FROM w")
def weighted_score_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.weighted_cdf(scored(spark, sf_dir).withColumn("score", F.round("a", 2)), "score", "fz").select("score", F.round("share", 6).alias("share"))


@query("WITH " + SCORED + ", e AS (SELECT *, min(a) OVER () AS lo, max(a) OVER () AS hi FROM s), b AS (SELECT least(floor((a - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM e GROUP BY 1) SELECT bin, n, (sum(n) OVER (ORDER BY bin))::BIGINT AS upto FROM b")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(scored(spark, sf_dir), "a").select("bin", "n", F.col("upto").cast("bigint").alias("upto"))



GRAPH = "WITH " + RULES + """, f2 AS (
  SELECT a.item || ';' || b.item AS x, count(*) AS fx, count(*) FILTER (WHERE c.item IS NOT NULL) AS fz FROM tx a JOIN tx b ON a.tid = b.tid AND a.item < b.item AND b.item NOT LIKE 'status=%' AND a.item NOT LIKE 'status=%'
  LEFT JOIN tx c ON c.tid = a.tid AND c.item = 'status=F' WHERE a.item LIKE 'prio=%' OR a.item LIKE 'seg=%' GROUP BY 1
), pool AS (
  SELECT x || '=>status=F' AS rule_id, x, (fx + fz)::DOUBLE AS score FROM f2 WHERE fz > 0 UNION ALL SELECT rule_id, x, (fx + fz)::DOUBLE FROM r WHERE y = 'status=F'
), e AS (
  SELECT p.rule_id AS a, q.rule_id AS b, abs(p.score - q.score) AS d FROM pool p JOIN pool q ON NOT contains(q.x, ';') AND contains(p.x, ';') AND list_contains(string_split(p.x, ';'), q.x)
), deg AS (SELECT rule_id, (SELECT count(*) FROM e WHERE e.a = pool.rule_id OR e.b = pool.rule_id) AS deg FROM pool)
SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, round(avg(deg), 6) AS degree_avg, max(deg) AS degree_max, min(deg) AS degree_min, (SELECT round(avg(d), 6) FROM e) AS diff_avg, (SELECT max(d) FROM e) AS diff_max, (SELECT min(d) FROM e) AS diff_min,
  round((SELECT count(*) FROM e)::DOUBLE / (count(*) * (count(*) - 1) / 2), 6) AS density FROM deg"""


@query(GRAPH)
def rule_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of rules for one class whose antecedents differ by one item."""
    from ..operators import mining
    from ..sources.files import kept
    from .base import held

    found = mining.mine(held(spark, sf_dir), most=2).where("y = 'status=F'")
    keep = (F.col("size") == 1) | F.col("x").startswith("prio=") | F.col("x").startswith("seg=")
    pool = found.where(keep).select("rule_id", "x", (F.col("fx") + F.col("fz")).cast("double").alias("score"))
    pool = kept(pool)  # the graph is walked several times
    stats = ev.graph_statistics(pool, rules.neighbours(pool), "score")
    return stats.select("nodes", "edges", F.round("degree_avg", 6).alias("degree_avg"), "degree_max", "degree_min", F.round("diff_avg", 6).alias("diff_avg"), "diff_max", "diff_min", F.round("density", 6).alias("density"))


@query("WITH " + RULES + ", l AS (SELECT rule_id, length(x)::DOUBLE AS l, y FROM r), m AS (SELECT y, avg(l) AS m FROM l GROUP BY y) SELECT round(avg(m), 6) AS average FROM m")
def average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each class's mean antecedent length."""
    return one(spark, sf_dir).groupBy("y").agg(F.avg(F.length("x").cast("double")).alias("m")).agg(F.round(F.avg("m"), 6).alias("average"))


def _pool(spark: SparkSession, sf_dir: str, n: int = 40) -> list[tuple[str, np.ndarray, float]]:
    names = ["confidence", "cosine", "support", "kruskal", "revsup"]
    rows = measured(spark, sf_dir).select("rule_id", *names, "phi").orderBy("rule_id").limit(n).collect()  # n rows
    return [(r.rule_id, np.array([r[c] for c in names]), r.phi) for r in rows]


@query()
def ranknet_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights learned from all comparisons of forty rules."""
    pool = sorted(_pool(spark, sf_dir), key=lambda p: -p[2])
    pairs = [(a[1], b[1]) for i, a in enumerate(pool) for b in pool[i + 1 :]]
    model = learning.ranknet(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), epochs=20)
    return spark.createDataFrame(list(enumerate(model.weights)), "criterion int, weight double").select("criterion", r6("weight").alias("weight"))


@query()
def choquet_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moebius masses of a 2-additive capacity learned from the same comparisons."""
    pool = sorted(_pool(spark, sf_dir), key=lambda p: -p[2])
    pairs = [(a[1], b[1]) for i, a in enumerate(pool) for b in pool[i + 1 :]]
    model = learning.choquet_fit(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), rounds=500)
    rows = [(";".join(map(str, s)), float(m)) for s, m in sorted(model.masses.items())]
    return spark.createDataFrame(rows, "subset string, mass double").select("subset", r6("mass").alias("mass"))


def _curve(spark: SparkSession, pool: list, select, fit, flip=None, iterations: int = 20) -> DataFrame:
    rows: list[tuple[int, float]] = []
    vectors, truth = np.array([p[1] for p in pool]), np.array([p[2] for p in pool])

    def observe(step: learning.Step) -> None:
        s = learning.value(step.model, vectors)
        i, j = np.triu_indices(len(pool), 1)
        rows.append((step.iteration, float(((s[i] > s[j]) == (truth[i] > truth[j])).mean())))

    learning.active_learning(pool, select, fit, iterations=iterations, observers=[observe], flip=flip)
    return spark.createDataFrame(rows, "iteration int, accuracy double").select("iteration", r6("accuracy").alias("accuracy"))


@query()
def active_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by iteration: ask about the closest pair, refit the Choquet integral."""
    pool = _pool(spark, sf_dir)
    return _curve(spark, pool, learning.uncertain_selector(pool), lambda w, l: learning.choquet_fit(w, l, rounds=200))


@query()
def noisy_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by iteration with a noisy oracle: explore near a falling threshold or correct contradictions."""
    pool = _pool(spark, sf_dir)
    rng = np.random.default_rng(3)
    return _curve(spark, pool, learning.noisy_selector(pool, 20), learning.ranknet, flip=lambda i, j, t: rng.random() < 0.5 * np.exp(-5 * abs(pool[i][2] - pool[j][2])))
