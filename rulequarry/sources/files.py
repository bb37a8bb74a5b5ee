"""Text, CSV and JSON files as DataFrames and back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"[,\s]+"), lambda t: t != "")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rulequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: computed once."""
    path = work_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """(tid, items) of a transaction file: one row per line, items separated by commas or white space, blank lines skipped.

    ``tid`` increases in file order; it is not dense.
    """
    lines = spark.read.text(path).select(_tokens(F.col("value")).alias("items")).where(F.size("items") > 0)
    return lines.select(F.monotonically_increasing_id().alias("tid"), "items")


def write_dat(df: DataFrame, path: str, items: str = "items") -> None:
    """One line per row, items separated by spaces."""
    df.select(F.array_join(items, " ").alias("value")).write.mode("overwrite").text(path)


def encode_onehot(df: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(items) of a table of 0/1 columns and a class column: numbers of the columns that are set, from 1.

    Class values become columns of their own, in order, behind all others.  Columns of ``keep`` are carried in front.
    """
    columns = [c for c in df.columns if c != label and c not in keep]
    values = sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().where(f"`{label}` is not null").collect())  # one row per class
    flags = [F.when(F.col(f"`{c}`").cast("double") != 0, F.lit(str(i))) for i, c in enumerate(columns, 1)]
    flags += [F.when(F.col(f"`{label}`").cast("string") == v, F.lit(str(len(columns) + i))) for i, v in enumerate(values, 1)]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.array_compact(F.array(*flags)).alias("items"))


def encoding_map(df: DataFrame, label: str) -> DataFrame:
    """(encoding, column_name) that goes with ``encode_onehot``."""
    columns = [c for c in df.columns if c != label]
    values = sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().where(f"`{label}` is not null").collect())  # one row per class
    names = columns + [f"{label}={v}" for v in values]
    return df.sparkSession.createDataFrame(list(enumerate(names, 1)), "encoding int, column_name string")


def csv_to_dat(spark: SparkSession, source: str, target: str, sep: str = ",", header: bool = True) -> None:
    """Every row of a CSV file as a line of its values, separated by spaces."""
    df = spark.read.csv(source, sep=sep, header=header)
    df.select(F.concat_ws(" ", *(F.col(f"`{c}`") for c in df.columns)).alias("value")).write.mode("overwrite").text(target)


def write_folds(df: DataFrame, path: str, items: str = "items") -> None:
    """Rows with columns fold and split, as text below fold=/split= folders."""
    df.select(F.array_join(items, " ").alias("value"), "fold", "split").write.mode("overwrite").partitionBy("fold", "split").text(path)


def read_folds(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(fold, split, tid, items); partition pruning reads the wanted split only."""
    df = spark.read.format("text").option("basePath", path).load(path)
    if split:
        df = df.where(F.col("split") == split)
    return df.select(F.col("fold").cast("int").alias("fold"), "split", F.monotonically_increasing_id().alias("tid"), _tokens(F.col("value")).alias("items")).where(F.size("items") > 0)


def read_fold_files(spark: SparkSession, glob: str) -> DataFrame:
    """(fold, split, tid, items) of files named train_<fold>.dat and test_<fold>.dat; the fold comes from the name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    df = spark.read.text(glob).select("value", F.regexp_extract(name, r"^(train|test)_(\d+)\.dat$", 1).alias("split"), F.regexp_extract(name, r"^(train|test)_(\d+)\.dat$", 2).alias("f"))
    return df.where("f <> ''").select(F.col("f").cast("int").alias("fold"), "split", F.monotonically_increasing_id().alias("tid"), _tokens(F.col("value")).alias("items")).where(F.size("items") > 0)


def rule_columns(rules: DataFrame) -> DataFrame:
    """Mined rules as they are written: antecedent and consequent in braces, then the three frequencies."""
    return rules.select(F.concat(F.lit("{"), "x", F.lit("}")).alias("antecedent"), F.concat(F.lit("{"), "y", F.lit("}")).alias("consequent"), F.col("fx").alias("freqX"), F.col("fy").alias("freqY"), F.col("fz").alias("freqZ"))


def write_mined_rules(rules: DataFrame, path: str) -> None:
    rule_columns(rules).write.mode("overwrite").csv(path, header=True)


def read_mined_rules(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) of a mined-rule file; its frequencies are to be counted anew on the data at hand."""
    df = spark.read.csv(path, header=True)
    return df.select(F.array_join(F.array_sort(F.split(F.translate("antecedent", "{}", ""), ";")), ";").alias("x"), F.translate("consequent", "{}", "").alias("y"))


def with_frequencies(rules: DataFrame, tx: DataFrame) -> DataFrame:
    """Rules (x, y) with fx, fy, fz counted on transactions; the rules are stored, as both sides of the count use them."""
    from ..operators.transactions import cover_sizes

    rules = kept(rules.select("x", "y").distinct())
    antecedent = F.split("x", ";")
    sides = (("fx", F.concat(F.lit("x:"), "x"), antecedent), ("fy", F.concat(F.lit("y:"), "y"), F.array("y")), ("fz", F.concat(F.lit("z:"), "x", F.lit("=>"), "y"), F.concat(antecedent, F.array("y"))))
    named = rules.select("x", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), i.alias("set_id"), items.alias("items")) for k, i, items in sides))).alias("s")).select("x", "y", "s.*")
    sizes = cover_sizes(named.select("set_id", "items").distinct(), tx)
    out = named.join(sizes, "set_id").groupBy("x", "y").agg(*(F.max(F.when(F.col("side") == k, F.col("f"))).alias(k) for k, *_ in sides))
    return out.select(F.concat("x", F.lit("=>"), "y").alias("rule_id"), "x", "y", "fx", "fy", "fz")


def rule_json(rules: DataFrame) -> DataFrame:
    """(json): antecedent as a list, consequent and frequencies."""
    return rules.select(F.to_json(F.struct(F.split("x", ";").alias("antecedent"), F.col("y").alias("consequent"), "fx", "fy", "fz")).alias("json"))


def write_rule_json(rules: DataFrame, path: str) -> None:
    rule_json(rules).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def read_preferences_json(spark: SparkSession, path: str) -> DataFrame:
    """Alternatives and preferences (1-based winner, loser, delta) of a preference file."""
    schema = "alternatives array<array<double>>, preferences array<array<double>>, kAdditivity int, approachType string, significantFigures int"
    return spark.read.schema(schema).json(path, multiLine=True)


def write_preferences_json(alternatives: DataFrame, preferences: DataFrame, path: str, *, delta: float = 0.0, additivity: int = 2, approach: str = "gls", digits: int = 3) -> None:
    """One JSON object: alternatives (id, v) in order of their ids, and preferences (winner, loser) by 1-based position.

    Both tables are what one person has compared, so one task takes them.
    """
    ordered = alternatives.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("a"))
    pairs = preferences.agg(F.array_sort(F.collect_list(F.struct("winner", "loser"))).alias("p"))
    place = lambda key: F.array_position(F.transform("a", lambda x: x["id"]), key).cast("double")
    out = ordered.crossJoin(pairs).select(  # one row each
        F.transform("a", lambda x: x["v"]).alias("alternatives"),
        F.transform("p", lambda x: F.array(place(x["winner"]), place(x["loser"]), F.lit(float(delta)))).alias("preferences"),
        F.lit(additivity).alias("kAdditivity"), F.lit(approach).alias("approachType"), F.lit(digits).alias("significantFigures"))
    out.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


LOG_KEYS = ("dataset", "fold", "algorithm", "oracle", "iteration")


def append_log(df: DataFrame, path: str) -> None:
    """Scores of one iteration, below folders named by dataset, fold, algorithm and oracle; the iteration is a column."""
    df.write.mode("append").partitionBy("dataset", "fold", "algorithm", "oracle").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def read_named_logs(spark: SparkSession, glob: str) -> DataFrame:
    """CSV logs whose names carry dataset_fold_algorithm[-normalization]_oracle_time: all columns plus these."""
    df = spark.read.option("header", True).csv(glob)
    part = F.split(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", ""), "_")
    algo = F.element_at(part, -3)
    return df.select(*df.columns, F.array_join(F.slice(part, 1, F.size(part) - 4), "_").alias("dataset"), F.element_at(part, -4).cast("int").alias("fold"),
                     F.regexp_extract(algo, r"^(.*?)(?:-([^-]*))?$", 1).alias("algorithm"), F.regexp_extract(algo, r"^(.*?)(?:-([^-]*))?$", 2).alias("normalization"), F.element_at(part, -2).alias("oracle"), F.element_at(part, -1).alias("time"))


def write_accuracy(df: DataFrame, path: str) -> None:
    """Iteration,Accuracy in order."""
    df.select(F.col("iteration").alias("Iteration"), F.col("accuracy").alias("Accuracy")).coalesce(1).sortWithinPartitions("Iteration").write.mode("overwrite").csv(path, header=True)


def write_sample(rules: DataFrame, measures: Sequence[str], score: str, path: str) -> None:
    """Rule text, measures and score; the header is written even if there is no rule."""
    from ..operators.rules import text

    rules.select(text().alias("Rule"), *measures, F.col(score).alias("scoreApprox")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_sample(spark: SparkSession, path: str, measures: Sequence[str]) -> DataFrame:
    """(Rule, measures, scoreApprox) of a sampler's log; fields are counted from the right, as rules may hold commas."""
    k = len(measures) + 1
    part = F.split("value", ",")
    lines = spark.read.text(path).select(part.alias("p")).where((F.size("p") > k) & (F.element_at("p", -1) != "scoreApprox"))
    rule = F.array_join(F.slice("p", 1, F.size("p") - k), ",")
    values = [F.element_at("p", i - k).cast("double").alias(name) for i, name in enumerate([*measures, "scoreApprox"])]
    return lines.select(F.regexp_replace(rule, '^"|"$', "").alias("Rule"), *values)
