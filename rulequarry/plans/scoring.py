"""Normalizers, score functions, certainties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import certainty, measures, normalize, probability, scores
from ..operators import pairs as pair_ops
from .base import ALL, FIVE, MEASURED, RULES, SCORED, SMOOTH, measured, one, query, r6, round_sql, scored, table

COLUMNS = ["quantity", "price", "discount"]
LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem)"
STATS = ", ".join(
    f"min({c}) OVER () AS {c}_min, max({c}) OVER () AS {c}_max, avg({c}) OVER () AS {c}_avg, stddev_pop({c}) OVER () AS {c}_std, max(abs({c})) OVER () AS {c}_abs, "
    f"max(CASE WHEN {c} = 0 THEN 1 ELSE greatest(0, floor(log10(abs(nullif({c}, 0)))) + 1) END) OVER () AS {c}_dig" for c in COLUMNS)
FORMS = {
    "MIN_MAX_SCALING": "CASE WHEN {c}_max <> {c}_min THEN ({c} - {c}_min) / ({c}_max - {c}_min) ELSE 0 END",
    "MEAN_NORMALIZATION": "CASE WHEN {c}_max <> {c}_min THEN ({c} - {c}_avg) / ({c}_max - {c}_min) ELSE 0 END",
    "MAX_ABSOLUTE_SCALING": "CASE WHEN {c}_abs <> 0 THEN {c} / {c}_abs ELSE 0 END",
    "DECIMAL_SCALING": "{c} / pow(10.0::DOUBLE, {c}_dig)",
    "TANH_ESTIMATOR": "CASE WHEN {c}_std <> 0 THEN 5e-1 * tanh(1e-2 * ({c} - {c}_avg) / {c}_std) + 5e-1 ELSE 5e-1 END",
    "Z_NORMALIZATION": "CASE WHEN {c}_std <> 0 THEN ({c} - {c}_avg) / {c}_std ELSE 0 END",
    "NO_NORMALIZATION": "{c}",
}
SHORT = {"MIN_MAX_SCALING": "norm_minmax", "MEAN_NORMALIZATION": "norm_mean", "MAX_ABSOLUTE_SCALING": "norm_maxabs", "DECIMAL_SCALING": "norm_decimal", "TANH_ESTIMATOR": "norm_tanh", "Z_NORMALIZATION": "norm_zscore", "NO_NORMALIZATION": "norm_none"}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("k", "ln", *(r6(c, digits).alias(c) for c in COLUMNS))


for _method, _form in FORMS.items():

    def _norm(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return _rounded(normalize.normalize(_lines(spark, sf_dir), COLUMNS, method), 9 if method == "DECIMAL_SCALING" else 6)

    _digits = 9 if _method == "DECIMAL_SCALING" else 6
    query(f"WITH {LINES}, w AS (SELECT *, {STATS} FROM l) SELECT k, ln, " + ", ".join(f"round({_form.format(c=c)}, {_digits}) + 0.0 AS {c}" for c in COLUMNS) + " FROM w", SHORT[_method])(_norm)


@query(f"WITH {LINES}, w AS (SELECT *, " + ", ".join(f"(SELECT quantile_cont({c}, 0.5) FROM l) AS {c}_med" for c in COLUMNS) + " FROM l) SELECT k, ln, " + ", ".join(f"round(CASE WHEN {c}_med <> 0 THEN {c} / {c}_med ELSE 0 END, 6) + 0.0 AS {c}" for c in COLUMNS) + " FROM w")
def norm_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize.normalize(_lines(spark, sf_dir), COLUMNS, "MEDIAN_NORMALIZATION"))


@query(f"WITH {LINES} SELECT k, ln, " + ", ".join(f"round(cume_dist() OVER (ORDER BY {c}), 6) + 0.0 AS {c}" for c in COLUMNS) + " FROM l")
def norm_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize.normalize(_lines(spark, sf_dir), COLUMNS, "EMPIRICAL_CDF"))


@query()
def norm_ecdf_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empirical distribution function from a mergeable sketch, for streams and very large inputs."""
    return _rounded(normalize.normalize(_lines(spark, sf_dir), COLUMNS, "EMPIRICAL_CDF", exact=False))


@query("""SELECT event_id, round(CASE WHEN max(value) OVER w <> min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) + 0.0 AS value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def norm_running_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value scaled by what its user has shown so far."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return normalize.running(events, ["value"], "MIN_MAX_SCALING", ["ts", "event_id"], ["user_id"]).select("event_id", r6("value").alias("value"))


@query("WITH " + MEASURED + ', b AS (SELECT *, min(lift) OVER (PARTITION BY y) AS lo, max(lift) OVER (PARTITION BY y) AS hi FROM m) SELECT rule_id, round(CASE WHEN hi <> lo THEN (lift - lo) / (hi - lo) ELSE lift END, 6) + 0.0 AS lift FROM b')
def norm_ideal_nadir(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("y")
    return measured(spark, sf_dir).select("rule_id", r6(normalize.ideal_nadir(F.col("lift"), F.min("lift").over(w), F.max("lift").over(w))).alias("lift"))


@query("WITH " + LINES + """ SELECT count(quantity) AS n, round(sum(quantity), 2) AS s, round(sum(quantity * quantity), 2) AS ss, min(quantity) AS lo, max(quantity) AS hi,
max(CASE WHEN quantity = 0 THEN 1 ELSE greatest(0, floor(log10(abs(nullif(quantity, 0)))) + 1) END)::BIGINT AS digits, round(stddev_pop(quantity), 6) AS std FROM l""")
def norm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = normalize.statistics("quantity")
    return _lines(spark, sf_dir).agg(s["count"].alias("n"), F.round(s["sum"], 2).alias("s"), F.round(s["sum_sq"], 2).alias("ss"), s["min"].alias("lo"), s["max"].alias("hi"), s["digits"].cast("bigint").alias("digits"), F.round(s["std"], 6).alias("std"))


WEIGHTS = [0.4, 0.3, 0.15, 0.1, 0.05]
LEX = scores.lexmin_weights(5, 0.01)
# a 2-additive capacity: masses of singles and of two pairs, one of them negative
MASSES: scores.Mobius = {(0,): 0.2, (1,): 0.3, (2,): 0.15, (3,): 0.25, (4,): 0.1, (0, 1): -0.1, (2, 3): 0.1}
UNIT = ["confidence", "cosine", "support", "kruskal", "revsup"]


def _sum_sql(names: list[str], weights: list[float]) -> str:
    return "0.0 + " + " + ".join(f'"{c}" * {w!r}::DOUBLE' for c, w in zip(names, weights))


@query("WITH " + MEASURED + f" SELECT rule_id, round({_sum_sql(FIVE, [1.0] * 5)}, 6) + 0.0 AS score FROM m")
def score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", r6(scores.linear(FIVE)).alias("score"))


@query("WITH " + MEASURED + f" SELECT rule_id, round({_sum_sql(FIVE, WEIGHTS)}, 6) + 0.0 AS score FROM m")
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", r6(scores.linear(FIVE, WEIGHTS)).alias("score"))


@query("WITH " + MEASURED + f" SELECT rule_id, round({_sum_sql(FIVE, WEIGHTS)}, 6) + 0.0 AS score FROM m")
def score_owa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by position in the order given."""
    return measured(spark, sf_dir).select("rule_id", r6(scores.owa(FIVE, WEIGHTS)).alias("score"))


@query("WITH " + MEASURED + ', v AS (SELECT rule_id, list_sort([lift, confidence, support, "yuleQ", kruskal]) AS v FROM m) SELECT rule_id, round(' + " + ".join(f"v[{i + 1}] * {w!r}::DOUBLE" for i, w in enumerate(WEIGHTS)) + ", 6) + 0.0 AS score FROM v")
def score_owa_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", r6(scores.owa(FIVE, WEIGHTS, ordered=True)).alias("score"))


@query("WITH " + MEASURED + f" SELECT rule_id, round({_sum_sql(FIVE, LEX)}, 6) + 0.0 AS score FROM m")
def score_lexmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", r6(scores.get_score_function("lexmin", delta=0.01)(FIVE)).alias("score"))


@query("WITH " + SCORED + " SELECT rule_id, round(o, 6) + 0.0 AS score FROM s")
def score_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).select("rule_id", r6(scores.phi_score()).alias("score"))


def _mobius_sql() -> str:
    terms = []
    for s, m in sorted(MASSES.items(), key=lambda e: (len(e[0]), e[0])):
        low = f'"{UNIT[s[0]]}"' if len(s) == 1 else "least(" + ", ".join(f'"{UNIT[i]}"' for i in s) + ")"
        terms.append(f"{m!r}::DOUBLE * {low}")
    return " + ".join(terms)


@query("WITH " + MEASURED + f" SELECT rule_id, round({_mobius_sql()}, 6) + 0.0 AS score FROM m")
def score_mobius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", r6(scores.choquet_mobius(UNIT, MASSES)).alias("score"))


@query("WITH " + MEASURED + f" SELECT rule_id, round({_mobius_sql()}, 6) + 0.0 AS score FROM m")
def score_choquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same integral from the capacity instead of its Moebius masses."""
    return measured(spark, sf_dir).select("rule_id", r6(scores.choquet(UNIT, scores.capacity_of(MASSES, 5))).alias("score"))


@query("WITH " + MEASURED + """, v AS (SELECT rule_id, list_sort([confidence, cosine, support]) AS v FROM m)
SELECT rule_id, round(v[1] + (v[2] - v[1]) / 6 + (v[3] - v[2]) / 6, 6) + 0.0 AS score FROM v""")
def score_choquet_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("rule_id", r6(scores.choquet(["confidence", "cosine", "support"], scores.equal_capacity(3))).alias("score"))


@query("WITH mass(s, m) AS (VALUES " + ", ".join(f"({list(s)}, {m!r}::DOUBLE)" for s, m in MASSES.items()) + "), e AS (SELECT unnest(s) AS i, m / len(s) AS p FROM mass) SELECT i::INTEGER AS criterion, round(sum(p), 6) + 0.0 AS shapley FROM e GROUP BY i")
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, v) for i, v in enumerate(scores.shapley(MASSES, 5))]
    return spark.createDataFrame(rows, "criterion int, v double").select("criterion", r6("v").alias("shapley"))


@query("WITH mass(s, m) AS (VALUES " + ", ".join(f"({list(s)}, {m!r}::DOUBLE)" for s, m in MASSES.items() if len(s) == 2) + ") SELECT s[1]::INTEGER AS i, s[2]::INTEGER AS j, round(m, 6) + 0.0 AS interaction FROM mass")
def interaction_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = scores.interaction(MASSES, 5)
    rows = [(i, j, full[i][j]) for i in range(5) for j in range(i + 1, 5) if full[i][j]]
    return spark.createDataFrame(rows, "i int, j int, v double").select("i", "j", r6("v").alias("interaction"))


@query("WITH mass(s, m) AS (VALUES " + ", ".join(f"({sum(1 << i for i in s)}, {m!r}::DOUBLE)" for s, m in MASSES.items()) + ") SELECT b.r::BIGINT AS mask, round(coalesce(sum(CASE WHEN (mass.s & b.r::INTEGER) = mass.s THEN m END), 0), 6) + 0.0 AS capacity FROM range(32) b(r) CROSS JOIN mass GROUP BY b.r")
def capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capacity of every subset: a join of subsets with the masses that they contain."""
    mass = spark.createDataFrame([(sum(1 << i for i in s), m) for s, m in MASSES.items()], "s bigint, m double")
    sets = spark.range(32).withColumnRenamed("id", "mask")
    both = sets.join(F.broadcast(mass), F.col("s").bitwiseAND(F.col("mask")) == F.col("s"), "left")  # one row per mass
    return both.groupBy("mask").agg(r6(F.coalesce(F.sum("m"), F.lit(0.0))).alias("capacity"))


@query("SELECT r::BIGINT AS mask, (row_number() OVER (ORDER BY bit_count(r), " + ", ".join(f"(r >> {i}) & 1 DESC" for i in range(4)) + "))::BIGINT AS place FROM range(16) t(r)")
def subset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets by size, then lexicographically by their members."""
    bit = [F.shiftright("mask", i).bitwiseAND(F.lit(1)) for i in range(4)]
    w = Window.orderBy(F.bit_count("mask"), *(b.desc() for b in bit))
    return spark.range(16).withColumnRenamed("id", "mask").select("mask", F.row_number().over(w).cast("bigint").alias("place"))


@query("WITH " + MEASURED + ", g AS (SELECT *, greatest(1.0, max(abs(lift)) OVER ()) AS ml, greatest(1.0, max(abs(confidence)) OVER ()) AS mc, greatest(1.0, max(abs(support)) OVER ()) AS ms FROM m) SELECT rule_id, round(0.0 + lift / ml * 5e-1 + confidence / mc * 3e-1 + support / ms * 2e-1, 6) + 0.0 AS score FROM g")
def score_normalized_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measured(spark, sf_dir)
    names = ["lift", "confidence", "support"]
    most = df.agg(*(F.greatest(F.lit(1.0), F.max(F.abs(c))).alias(f"m_{c}") for c in names))
    return df.crossJoin(F.broadcast(most)).select("rule_id", r6(scores.normalized_linear(names, [f"m_{c}" for c in names], [0.5, 0.3, 0.2])).alias("score"))  # one row


@query("WITH " + SCORED + " SELECT rule_id, round(CASE WHEN fz > 0 AND fz < n AND fx < n AND fy < n AND fz >= 200 THEN a ELSE 0 END, 6) + 0.0 AS score FROM s")
def score_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import rules

    return scored(spark, sf_dir).select("rule_id", r6(scores.valid_score(F.col("a"), rules.is_nontrivial() & (F.col("fz") >= 200))).alias("score"))


@query("WITH " + RULES + " SELECT rule_id, round(fy::DOUBLE / n, 6) + 0.0 AS g FROM r")
def score_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).select("rule_id", r6(scores.share_of_class()).alias("g"))


PAIRS = SCORED + ", p AS (SELECT l.rule_id AS a, q.rule_id AS b, l.a AS s0, q.a AS s1 FROM s l JOIN s q ON l.rule_id < q.rule_id)"
CDF = """(CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END)"""


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 2.316419e-1 * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / {2.5066282746310002!r}::DOUBLE * (3.19381530e-1 * {t} - 3.56563782e-1 * {t} * {t} + 1.781477937e0 * {t} * {t} * {t} - 1.821255978e0 * {t} * {t} * {t} * {t} + 1.330274429e0 * {t} * {t} * {t} * {t} * {t}))"
    return CDF.format(x=f"({x})", t=tail)


THETA_SQL = {"certainty_affine": "9.99e-1 * ((s0 - s1) / 2 + 5e-1) + 1e-3", "certainty_logistic": "1 / (1 + exp(s1 - s0))", "certainty_cdf": cdf_sql("s0 - s1"), "certainty_steep": "1 / (1 + exp(10.0::DOUBLE * (s1 - s0)))"}
THETA = {"certainty_affine": certainty.score_difference, "certainty_logistic": certainty.bradley_terry, "certainty_cdf": certainty.thurstone, "certainty_steep": certainty.steep_logistic}


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pair_ops.all_pairs(scored(spark, sf_dir).select("rule_id", F.col("a").alias("s")), "rule_id", "s")
    return df.select("a", "b", F.col("s_a").alias("s0"), F.col("s_b").alias("s1"))


for _name, _theta in THETA.items():

    def _pairs(spark: SparkSession, sf_dir: str, theta=_theta) -> DataFrame:
        return all_pairs(spark, sf_dir).select("a", "b", r6(theta(F.col("s0"), F.col("s1"))).alias("theta"))

    query("WITH " + PAIRS + f" SELECT a, b, round({THETA_SQL[_name]}, 6) + 0.0 AS theta FROM p", _name)(_pairs)


@query("WITH " + PAIRS + f" SELECT a, b, round(1 - abs(1 - 2 * ({THETA_SQL['certainty_logistic']})), 6) + 0.0 AS uncertainty FROM p")
def pair_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir).select("a", "b", r6(certainty.uncertainty(certainty.bradley_terry(F.col("s0"), F.col("s1")))).alias("uncertainty"))


@query("WITH " + PAIRS + f" SELECT a, b, round(5e-1 * exp(-5.0::DOUBLE * (1 - abs(1 - 2 * ({THETA_SQL['certainty_affine']})))), 6) + 0.0 AS sigma FROM p")
def noise_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A human-like oracle's chance of a wrong answer, for every pair."""
    from ..operators.learning import human_error

    return all_pairs(spark, sf_dir).select("a", "b", r6(human_error(F.col("s0"), F.col("s1"), 5.0)).alias("sigma"))


@query("WITH " + PAIRS + f" SELECT a, b, round({cdf_sql('-abs(s0 - s1) / 2e-1')}, 6) + 0.0 AS sigma FROM p")
def noise_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.learning import gaussian_error

    return all_pairs(spark, sf_dir).select("a", "b", r6(gaussian_error(F.col("s0"), F.col("s1"), 0.2)).alias("sigma"))


@query("SELECT t::BIGINT AS t, round(5e-1 * exp(-4 * least(t, 50)::DOUBLE / 50), 6) + 0.0 AS threshold FROM range(61) r(t)")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(61).select(F.col("id").alias("t"), r6(certainty.adaptive_threshold(F.col("id").cast("double"), 50.0)).alias("threshold"))


@query("SELECT event_type, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.shares(table(spark, sf_dir, "events"), "event_type").select("event_type", F.round("share", 6).alias("share"))


@query("WITH c AS (SELECT event_type, count(*)::DOUBLE / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type) SELECT round(-sum(p * log2(p)), 6) AS bits FROM c")
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.shares(table(spark, sf_dir, "events"), "event_type").agg(F.round(probability.entropy_bits(F.col("share")), 6).alias("bits"))


@query("WITH " + SCORED + ", e AS (SELECT rule_id, y, exp((a - max(a) OVER (PARTITION BY y)) / 5e-1) AS e FROM s) SELECT rule_id, round(e / sum(e) OVER (PARTITION BY y), 6) + 0.0 AS p FROM e")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.softmax(scored(spark, sf_dir), "a", 0.5, ["y"]).select("rule_id", r6("p").alias("p"))


@query("WITH " + RULES + ", c AS (SELECT rule_id, sum(fz) OVER (ORDER BY rule_id ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(fz) OVER () AS upto FROM r) SELECT rule_id FROM c WHERE upto > 4.2e-1 ORDER BY upto LIMIT 1")
def categorical_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw with probabilities in proportion to fz, for a given uniform number."""
    return probability.categorical(one(spark, sf_dir), "fz", ["rule_id"], 0.42).select("rule_id")
