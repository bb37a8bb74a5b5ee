"""Rules, measures, scores, learners and files on small hand-made inputs."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulequarry.functions import certainty, measures, normalize, scores
from rulequarry.operators import evaluation, learning, mining, pairs, rules, sampling, transactions
from rulequarry.sources import files
from rulequarry.streaming import running

# rows of a small data set of flowers by how often they occur; 12 and 13 are the classes
FLOWERS = {(1, 5, 6, 9, 12): 43, (1, 4, 6, 9, 12): 2, (2, 5, 6, 9, 12): 5, (2, 5, 7, 10, 13): 12, (2, 5, 8, 10, 13): 2, (2, 4, 7, 10, 13): 26, (1, 4, 7, 10, 13): 5, (2, 5, 8, 11, 13): 1, (2, 4, 8, 10, 13): 3, (1, 5, 7, 10, 13): 1, (2, 5, 8, 11, 12): 21, (2, 4, 8, 11, 12): 13, (3, 5, 8, 11, 12): 7, (1, 4, 7, 10, 12): 1, (3, 4, 8, 11, 12): 4, (2, 4, 8, 10, 12): 3, (3, 5, 8, 10, 12): 1}
SMALL = [(0, ["1", "2", "3", "4"]), (1, ["1", "2", "5"]), (2, ["9", "1"])]


@pytest.fixture(scope="module")
def flowers(spark):
    lines = [list(map(str, row)) for row, n in FLOWERS.items() for _ in range(n)]
    return transactions.from_arrays(spark.createDataFrame(list(enumerate(lines)), "tid long, items array<string>"))


@pytest.fixture(scope="module")
def small(spark):
    return transactions.from_arrays(spark.createDataFrame(SMALL, "tid long, items array<string>"))


def test_miner_finds_every_rule(flowers):
    found = mining.mine(flowers, F.col("item").isin("12", "13"), least=1, confidence=1.0, most=None).collect()
    assert len(found) == 141
    assert sum(r.y == "12" for r in found) == 86 and sum(r.y == "13" for r in found) == 55
    data = [(set(map(str, row)), n) for row, n in FLOWERS.items()]
    for r in found:
        x = set(r.x.split(";"))
        fx, fy, fz = (sum(n for row, n in data if s <= row) for s in (x, {r.y}, x | {r.y}))
        assert (r.fx, r.fy, r.fz) == (fx, fy, fz)


def test_level_wise_and_growth_agree(flowers):
    level = mining.mine(flowers, F.col("item").isin("12", "13"), least=15, confidence=50, most=None)
    growth = mining.growth_rules(flowers.withColumn("item", F.when(F.col("item").isin("12", "13"), F.concat(F.lit("status="), "item")).otherwise(F.col("item"))), 15 / 150, 0.5)
    assert {(r.x, "status=" + r.y) for r in level.collect()} == {(r.x, r.y) for r in growth.collect()}


def test_covers_and_frequencies(spark, small):
    sets = spark.createDataFrame([("a", ["1", "2"]), ("b", ["5", "2"]), ("c", ["2"]), ("d", ["7"]), ("e", ["1", "1"])], "set_id string, items array<string>")
    want = {"a": 2, "b": 1, "c": 2, "d": 0, "e": 3}
    assert {r.set_id: r.f for r in transactions.cover_sizes(sets, small).collect()} == want
    packed = transactions.packed_covers(transactions.with_positions(small))
    assert {r.set_id: r.f for r in transactions.packed_itemset_sizes(sets, packed).collect()} == want
    assert {r.component for r in transactions.item_components(small).collect()} == {"1"}
    assert {r.item for r in transactions.antecedent_items(small, spark.createDataFrame([("1",), ("14",)], "item string")).collect()} == {"2", "3", "4", "5", "9"}


def test_components_of_separate_rows(spark):
    tx = transactions.from_arrays(spark.createDataFrame([(i, [f"i{i:02d}", f"i{i + 1:02d}"]) for i in range(20)] + [(99, ["z"])], "tid long, items array<string>"))
    assert {r.component for r in transactions.item_components(tx).collect()} == {"i00", "z"}


def test_recounted_frequencies(spark, small):
    named = spark.createDataFrame([("1;2", "4"), ("2;5", "1"), ("2", "1"), ("3", "no")], "x string, y string")
    got = {r.rule_id: (r.fx, r.fy, r.fz) for r in files.with_frequencies(named, small).collect()}
    assert got == {"1;2=>4": (2, 1, 1), "2;5=>1": (1, 3, 1), "2=>1": (2, 3, 2), "3=>no": (1, 0, 0)}


def test_measures_in_plain_python(spark):
    rng = random.Random(2)
    table = []
    for i in range(60):
        n = rng.randrange(5, 60)
        fx, fy = rng.randrange(n + 1), rng.randrange(n + 1)
        table.append((i, fx, fy, rng.randrange(max(0, fx + fy - n), min(fx, fy) + 1), n))
    df = rules.with_measures(spark.createDataFrame(table, "i int, fx long, fy long, fz long, n long"), list(measures.MEASURES), 0.01)
    for r in df.collect():
        want = sampling.measure_vector(r.fx, r.fy, r.fz, r.n, list(measures.MEASURES), 0.01)
        assert [r[c] for c in measures.MEASURES] == pytest.approx(want, abs=1e-9)


def test_measures_without_spread_are_null(spark):
    df = rules.with_measures(spark.createDataFrame([(0, 0, 0, 0), (3, 3, 3, 3)], "fx long, fy long, fz long, n long"), list(measures.MEASURES))
    first, second = df.collect()
    assert first.confidence is None and first.support is None and second.phi is None and second.certainty is None and second.confidence == 1
    with pytest.raises(ValueError):
        measures.measure("no", measures.contingency())


def test_normal_distribution(spark):
    df = spark.range(-400, 401).select((F.col("id") / 100).alias("x")).select("x", certainty.normal_cdf(F.col("x")).alias("p"))
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-7 for r in df.collect())


def test_both_choquet_forms_agree(spark):
    rng = np.random.default_rng(4)
    masses = {(0,): 0.3, (1,): 0.2, (2,): 0.1, (0, 1): 0.3, (1, 2): -0.1, (0, 2): 0.2}
    assert sum(scores.shapley(masses, 3)) == pytest.approx(1)
    capacity = scores.capacity_of(masses, 3)
    assert {k: pytest.approx(v) for k, v in scores.mobius_of(capacity, 3).items() if abs(v) > 1e-12} == masses
    df = spark.createDataFrame(rng.random((50, 3)).tolist() + [[0.5, 0.5, 0.5]], "a double, b double, c double")
    for r in df.select(scores.choquet(["a", "b", "c"], capacity).alias("x"), scores.choquet_mobius(["a", "b", "c"], masses).alias("y")).collect():
        assert r.x == pytest.approx(r.y, abs=1e-12)
    with pytest.raises(ValueError):
        scores.choquet(["a"], {})
    with pytest.raises(ValueError):
        scores.get_score_function("none")
    assert sum(scores.lexmin_weights(5, 0.01)) == pytest.approx(1, abs=0.1)


def normalized(spark, method: str, fit: list[float], **options) -> list[float]:
    df = spark.createDataFrame(list(enumerate(fit)), "i int, v double")
    return [r.v for r in normalize.normalize(df, ["v"], method, **options).orderBy("i").collect()]


def test_normalizers(spark):
    assert normalized(spark, "DECIMAL_SCALING", [100.0, 200.0, 350.0]) == pytest.approx([0.1, 0.2, 0.35])
    assert normalized(spark, "MIN_MAX_SCALING", [-30.0, -10.0, -25.0]) == pytest.approx([0, 1, 0.25])
    assert normalized(spark, "Z_NORMALIZATION", [20.0, 20.0, 20.0]) == [0, 0, 0]
    assert normalized(spark, "TANH_ESTIMATOR", [20.0, 20.0]) == [0.5, 0.5]
    assert normalized(spark, "MEDIAN_NORMALIZATION", [1.0, 2.0, 4.0]) == [0.5, 1, 2]
    assert normalized(spark, "EMPIRICAL_CDF", [10.0, 20.0, 30.0, 40.0]) == [0.25, 0.5, 0.75, 1]
    assert normalized(spark, "EMPIRICAL_CDF", [float(i) for i in range(1000)], exact=False) == pytest.approx([(i + 1) / 1000 for i in range(1000)], abs=0.03)
    with pytest.raises(ValueError):
        normalized(spark, "none", [1.0])


def test_perfect_ranking(spark):
    df = evaluation.ranks(spark.range(20).select(F.col("id").cast("string").alias("r"), F.col("id").alias("s"), (F.col("id") * 2).alias("o"), F.lit(1).alias("p")), {"s": "rank_approx", "o": "rank_oracle"}, ["r"], ["p"])
    assert evaluation.kendall(df, ["p"], "r").first().tau == 1
    assert evaluation.spearman(df, ["p"]).first().spearman == pytest.approx(1)
    assert evaluation.precision_at(df, 0.2, ["p"]).first().precision == 1
    assert evaluation.regret_at(df, 0.2, ["p"], "r").first().regret == 0


def test_neighbours_by_brute_force(spark):
    items = "abcd"
    table = [(";".join(c) + "=>y", ";".join(c)) for k in (1, 2, 3) for c in itertools.combinations(items, k)]
    got = {(r.a, r.b) for r in rules.neighbours(spark.createDataFrame(table, "rule_id string, x string")).collect()}
    want = {tuple(sorted((i, j))) for (i, x), (j, z) in itertools.combinations(table, 2) if len(set(x.split(";")) ^ set(z.split(";"))) == 1}
    assert got == want


def test_closest_pair_by_brute_force(spark):
    rng = random.Random(8)
    table = [(f"r{i:02d}", rng.random()) for i in range(40)]
    got = pairs.closest_pair(spark.createDataFrame(table, "rule_id string, s double"), "s").first()
    assert got.gap == pytest.approx(min(abs(a[1] - b[1]) for a, b in itertools.combinations(table, 2)))


def test_learned_models_satisfy_their_preferences():
    rng = np.random.default_rng(6)
    x = rng.random((30, 4))
    truth = np.minimum(x[:, 0], x[:, 1]) * 0.6 + x[:, 2] * 0.4
    order = np.argsort(-truth)
    better, worse = x[order[:-1]], x[order[1:]]
    model = learning.choquet_fit(better, worse)
    assert sum(model.masses.values()) == pytest.approx(1)
    capacity = scores.capacity_of(model.masses, 4)
    assert all(capacity[m | 1 << i] >= capacity[m] - 1e-9 for m in capacity for i in range(4))
    s = learning.value(model, x)
    i, j = np.triu_indices(30, 1)
    assert ((s[i] > s[j]) == (truth[i] > truth[j])).mean() > 0.93
    net = learning.ranknet(better, worse)
    assert min(net.weights) >= 0 and sum(net.weights) == pytest.approx(1)


def test_learning_loop_reports_and_stops():
    rng = np.random.default_rng(1)
    pool = [(f"r{i}", v, float(v @ [0.7, 0.2, 0.1])) for i, v in enumerate(rng.random((15, 3)))]
    seen = []
    model = learning.active_learning(pool, learning.uncertain_selector(pool), learning.choquet_fit, iterations=5, observers=[seen.append])
    assert [s.iteration for s in seen] == list(range(5)) and not model.timed_out
    assert learning.active_learning(pool, learning.noisy_selector(pool, 5), learning.ranknet, iterations=50, budget=0.0).timed_out


def test_chains_visit_valid_rules(spark, flowers):
    found = mining.mine(flowers, F.col("item").isin("12", "13"), least=1, most=None)
    known = {(r.x, r.y) for r in found.collect()}
    top = sampling.smas(found, 150, chains=4, iterations=40, k=5)
    first, second = top.collect(), top.collect()
    assert first == second and {(r.x, r.y) for r in first} <= known and len(first) == 5
    assert [r.score for r in first] == sorted((r.score for r in first), reverse=True)
    assert {(r.x, r.y) for r in sampling.gibbs(found, 150, chains=2, iterations=10).collect()} <= known
    assert all(0 <= r.uncertainty <= 1 for r in sampling.mmas(found, 150, chains=2, iterations=5).collect())


def test_chains_walk_over_rules_of_any_size_and_frequency(spark):
    own = [["a", "b", "c", "d", "status=1"]] + [["a", "b", "status=2"], ["c", "d", "status=2"], ["a", "c", "status=1"], ["b", "e", "status=2"]] * 5
    tx = spark.createDataFrame([(t, i) for t, row in enumerate(own) for i in row], "tid bigint, item string")
    brute = {}
    for row in own:
        for k in range(1, len(row)):
            for x in itertools.combinations(row[:-1], k):
                hold = [r for r in own if set(x) <= set(r)]
                brute[";".join(x), row[-1]] = (len(hold), sum(row[-1] in r for r in own), sum(row[-1] in r for r in hold))
    top = sampling.smas(tx, len(own), chains=4, iterations=60, k=100).collect()
    for r in top:
        v = sampling.measure_vector(*brute[r.x, r.y], len(own), sampling.MEASURES, 0.01)
        assert r.score == pytest.approx(sum(v) / len(v))
    sampled = {(r.x, r.y) for r in sampling.gibbs(tx, len(own), chains=4, iterations=60).collect()}
    assert sampled <= brute.keys() and ("a;b;c;d", "status=1") in sampled
    assert ("a;b;c;d", "status=1") in {(r.x, r.y) for r in top}
    rules = {f"{x}=>{y}" for x, y in brute}
    assert all(r.a in rules and r.b in rules for r in sampling.mmas(tx, len(own), chains=2, iterations=5).collect())


def test_transaction_files(spark, tmp_path):
    (tmp_path / "t.dat").write_text("milk, bread  eggs\n\n  butter\tmilk ,bread\n")
    df = files.read_dat(spark, str(tmp_path / "t.dat"))
    assert [r["items"] for r in df.orderBy("tid").collect()] == [["milk", "bread", "eggs"], ["butter", "milk", "bread"]]
    files.write_dat(df, str(tmp_path / "out"))
    assert sorted(tuple(r["items"]) for r in files.read_dat(spark, str(tmp_path / "out")).collect()) == [("butter", "milk", "bread"), ("milk", "bread", "eggs")]
    folds = sampling.train_test(sampling.kfold(df, ["tid"], 3), 3)
    files.write_folds(folds, str(tmp_path / "folds"))
    back = files.read_folds(spark, str(tmp_path / "folds"), "test")
    assert back.count() == 2 and {r.split for r in back.collect()} == {"test"}
    (tmp_path / "train_3.dat").write_text("a b\nc\n")
    (tmp_path / "other.dat").write_text("x\n")
    assert {(r.fold, r.split) for r in files.read_fold_files(spark, str(tmp_path / "*.dat")).collect()} == {(3, "train")}


def test_rule_and_log_files(spark, tmp_path, flowers):
    found = mining.mine(flowers, F.col("item").isin("12", "13"), least=20, most=2)
    files.write_mined_rules(found, str(tmp_path / "rules"))
    again = files.with_frequencies(files.read_mined_rules(spark, str(tmp_path / "rules")), flowers)
    key = lambda df: {(r.x, r.y, r.fx, r.fy, r.fz) for r in df.collect()}
    assert key(again) == key(found)
    files.write_rule_json(found, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == found.count()
    (tmp_path / "a_b_2_GUS-ZSCORE_chi_20240101.csv").write_text("Rule,scoreApprox\nr,0.5\n")
    log = files.read_named_logs(spark, str(tmp_path / "*.csv")).first()
    assert (log.dataset, log.fold, log.algorithm, log.normalization, log.oracle) == ("a_b", 2, "GUS", "ZSCORE", "chi")
    files.append_log(spark.createDataFrame([("d", 1, "x", "o", 0, 0.5)], "dataset string, fold int, algorithm string, oracle string, iteration int, score double"), str(tmp_path / "log"))
    assert files.read_log(spark, str(tmp_path / "log")).where("fold = 1").count() == 1
    files.write_accuracy(spark.createDataFrame([(1, 0.5), (0, 0.4)], "iteration int, accuracy double"), str(tmp_path / "acc"))
    assert spark.read.csv(str(tmp_path / "acc"), header=True).count() == 2
    files.write_sample(found.withColumn("s", F.lit(1.0)).limit(0), ["fx"], "s", str(tmp_path / "sample"))
    assert spark.read.csv(str(tmp_path / "sample"), header=True).columns == ["Rule", "fx", "scoreApprox"]
    (tmp_path / "in.csv").write_text("p;q;class\n1;0;yes\n0;1;no\n")
    table = spark.read.csv(str(tmp_path / "in.csv"), sep=";", header=True)
    assert sorted(tuple(r["items"]) for r in files.encode_onehot(table, "class").collect()) == [("1", "4"), ("2", "3")]
    assert [r.column_name for r in files.encoding_map(table, "class").orderBy("encoding").collect()] == ["p", "q", "class=no", "class=yes"]
    files.csv_to_dat(spark, str(tmp_path / "in.csv"), str(tmp_path / "dat"), sep=";")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "dat")).collect()) == ["0 1 no", "1 0 yes"]


def test_running_scale_over_a_stream(spark, tmp_path):
    rows = [(u, t, float((u * 37 + t * 91) % 50)) for u in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, "u int, t int, v double")
    df.where("t < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running.running_minmax(stream, "u", "v", ["t"]).writeStream.format("memory").queryName("scaled").outputMode("append").start()
    q.processAllAvailable()
    df.where("t >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r.u, r.t): r.scaled for r in spark.table("scaled").collect()}
    want = {(r.u, r.t): r.v for r in normalize.running(df, ["v"], "MIN_MAX_SCALING", ["t"], ["u"]).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_random_sample_grows_valid_rules(spark):
    own = {t: [i for i, m in (("a", 2), ("b", 3), ("c", 5), ("d", 7), ("e", 11), ("f", 13)) if t % m == 0] + [f"class={t % 2}"] for t in range(1, 200)}
    tx = spark.createDataFrame([(t, i) for t, items in own.items() for i in items], "tid bigint, item string")
    of_class = F.col("item").startswith("class=")
    got = {(r.x, r.y) for r in sampling.random_sample(tx, len(own), class_item=of_class).collect()}
    assert got == {(r.x, r.y) for r in sampling.random_sample(tx, len(own), class_item=of_class).collect()} and len(got) > 10
    assert {len(x.split(";")) for x, _ in got} >= {1, 2}
    for x, y in got:
        fx = [t for t, items in own.items() if set(x.split(";")) <= set(items)]
        assert 0 < len([t for t in fx if y in own[t]]) and len(fx) < len(own)
    assert sampling.random_sample(tx, len(own), seconds=-1, class_item=of_class).count() == 0


TINY = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_transactions_meet_once_in_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(transactions, "TASK_BYTES", 8000)
    df = transactions.order_items(spark, TINY)
    size = sum(os.path.getsize(f"{TINY}/{t}.parquet") for t in ("lineitem", "orders"))
    assert df.rdd.getNumPartitions() == -(-size // 8000) > 4
    support = transactions.item_frequency(df)
    assert plan(support).count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan(support).split("REPARTITION_BY_NUM")[0]


@needs_data
def test_packed_covers_stay_in_the_task_of_their_bucket(spark):
    rows = transactions.order_baskets(spark, TINY, F.bitmap_bucket_number("tid"))
    packed = transactions.packed_covers(rows.select(F.col("tid").alias("pos"), F.col("block").alias("bucket"), F.explode("items").alias("item")))
    assert plan(packed).split("REPARTITION_BY_NUM")[0].count("Exchange") == 1  # the one by bucket


def test_item_sets_pass_by_the_transactions(spark, small, monkeypatch):
    sets = spark.createDataFrame([("a", ["1", "2"]), ("b", ["5", "2"]), ("c", []), ("d", ["7"]), ("e", ["1", "1"]), ("e", ["9"]), ("f", None)], "set_id string, items array<string>")
    few = transactions.itemset_covers(sets, transactions.baskets(small))
    assert "Join" not in plan(few)
    rows = sorted(map(tuple, few.collect()))
    assert rows == [("a", 0), ("a", 1), ("b", 1), ("e", 0), ("e", 1), ("e", 2), ("e", 2)]
    sizes = sorted(map(tuple, transactions.cover_sizes(sets, small).collect()))
    monkeypatch.setattr(transactions, "MOST_SETS", 2)
    assert sorted(map(tuple, transactions.itemset_covers(sets, small).collect())) == rows
    assert sorted(map(tuple, transactions.cover_sizes(sets, small).collect())) == sizes


def test_components_pass_over_the_transactions_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    held = spark.createDataFrame([(i, [f"i{i:02d}", f"i{i + 1:02d}"]) for i in range(20)], "tid long, items array<string>").mapInArrow(count, "tid long, items array<string>")
    assert {r.component for r in transactions.item_components(held).collect()} == {"i00"} and seen.value == 20


def mixed(spark):
    """Transactions with no, one and several classes."""
    rng = random.Random(11)
    own = [sorted(rng.sample("abcdefgh", rng.randrange(0, 7))) + rng.choice([[], ["status=1"], ["status=2"], ["status=1", "status=2"]]) for _ in range(300)]
    return own, transactions.from_arrays(spark.createDataFrame(list(enumerate(own)), "tid long, items array<string>"))


@pytest.mark.parametrize("limits", [{}, {"CELLS": 1, "CHUNK": 50}, {"CHUNK": 50}, {"MOST_SETS": 20}, {"MOST_CLASSES": 1}])
def test_miner_counts_without_moving_candidates(spark, monkeypatch, limits):
    own, tx = mixed(spark)
    for name, value in limits.items():
        monkeypatch.setattr(mining, name, value)
    want = {}
    for y in ("status=1", "status=2"):
        for k in (1, 2, 3):
            for x in itertools.combinations("abcdefgh", k):
                hold = [r for r in own if set(x) <= set(r)]
                fz = sum(y in r for r in hold)
                if fz >= 9 and fz * 100 >= 40 * len(hold):
                    want[";".join(x), y] = (k, len(hold), sum(y in r for r in own), fz)
    found = mining.mine(tx, least=9, confidence=40.0, most=3)
    assert {(r.x, r.y): (r.size, r.fx, r.fy, r.fz) for r in found.collect()} == want and len({k for k, *_ in want.values()}) == 3
    if "MOST_SETS" not in limits and "MOST_CLASSES" not in limits:
        assert "Join" not in plan(found)


def test_pattern_growth_in_parts(spark, monkeypatch):
    own, tx = mixed(spark)
    monkeypatch.setattr(mining, "PART_LEAST", 2)
    monkeypatch.setattr(mining, "PART_ROWS", 60)
    level = {(r.x, r.y): r.fz / r.fx for r in mining.mine(tx, least=9, confidence=40.0, most=None).collect()}
    n = tx.select("tid").distinct().count()
    growth = mining.growth_rules(tx, 8.5 / n, 0.4).collect()
    assert {(r.x, r.y): r.confidence for r in growth} == level and max(r.support for r in growth) > 9 / n


def test_chains_walk_over_segments(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    own, tx = mixed(spark)
    draw = lambda: [sorted(map(tuple, f(tx, len(own)).collect())) for f in (sampling.smas, sampling.gibbs, sampling.mmas, sampling.random_sample)]
    whole = draw()
    monkeypatch.setattr(sampling, "SEGMENT", 80)
    monkeypatch.setattr(sampling, "RECENT", 1)
    monkeypatch.setattr(DataFrame, "toArrow", None)  # the driver takes no transactions
    assert draw() == whole and all(whole)
    covers = sampling._load_covers(tx)
    assert len(covers[1]) > 3 and max(s.rows for s in covers[1]) <= 64
    for x, y in (("a", "status=1"), ("ab", "status=2"), ("", "status=1")):
        hold = [r for r in own if r and set(x) <= set(r)]
        assert sampling.Covers(*covers, set()).count(frozenset(x), y) == (len(hold), sum(y in r for r in own), sum(y in r for r in hold))


@needs_data
def test_a_log_mines_once(spark, monkeypatch):
    plans = []
    append = files.append_log
    monkeypatch.setattr(files, "append_log", lambda df, path: (plans.append(plan(df)), append(df, path)))
    from rulequarry.plans import registry

    assert registry.QUERIES["score_log_trip"](spark, TINY).count() == 4
    assert len(plans) == 4 and not any("lineitem" in p for p in plans)


def test_medians_of_many_values(spark):
    rng = np.random.default_rng(9)
    for n in (1999, 2000):
        table = [(float(a), float(b), None, float(c)) for a, b, c in zip(rng.normal(size=n), rng.integers(0, 3, n), np.exp(rng.normal(size=n) * 20))]
        df = spark.createDataFrame(table, "a double, b double, c double, d double")
        got = normalize.exact_medians(df, ["a", "b", "c", "d"], few=50, accuracy=100)
        assert [got[0], got[1], got[3]] == pytest.approx([float(np.median([r[i] for r in table])) for i in (0, 1, 3)], rel=1e-12) and got[2] is None


def test_sketched_ranks_are_looked_up(spark):
    df = spark.createDataFrame([(v,) for v in [None, float("nan"), *map(float, range(999))]], "v double")
    out = normalize.normalize(df, ["v"], "EMPIRICAL_CDF", exact=False)
    assert "lambda" not in plan(out)
    got = [r.v for r in out.collect()]
    assert got[0] is None and got[1] == 1 and got[2:] == sorted(got[2:]) and 0.99 < got[-1] <= 1
