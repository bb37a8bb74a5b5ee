"""Mixing sources to target weights by Pareto order sampling.

Every source gets a fixed number of document slots from its target weight (largest remainders).  Within a
source a document's expected number of copies is proportional to a whole-number size measure; the whole part
is allocated for certain, and the fractional parts are drawn by Pareto order sampling: documents are ranked by
(odds of a uniform number) / (odds of the inclusion probability) and the lowest are taken, which gives a sample
of exactly the size that is left.  All quotas are integers, so the result is exact and reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import n_bytes, read, shared_dir, stored

BUCKETS = 4096


def pareto_mix(docs: DataFrame, *, weights: dict[str, int] | None = None, total: int | None = None, seed: str = "mix-1", expand: bool = True) -> DataFrame:
    """Draw ``total`` documents (copies counted) so that each source has its target share.

    ``weights``: whole-number weight by source; a source that is not named gets 0.  None means the square root
    of its number of documents.  ``total``: None means as many as there are rows.  Size measure of a document:
    ceil(sqrt(bytes)), at least 1.

    Result: with ``expand`` every column of ``docs``, each drawn row as often as it was drawn; without, the columns
    ``doc_id, source, copies``.  Null source: a source of its own (weighted only if ``weights`` is None).  Null or
    empty text: size 1; a very long one has the size of all its bytes.  Null ids are allowed.  Repeated rows are drawn independently of each other as far as the
    ranks differ; among fully equal rows with equal rank any may be taken, which cannot be told apart in the result.
    Empty table: empty result.  Other columns are carried and may have any name.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    keyed = docs if expand else docs.select("doc_id", "source", "text")
    keyed = keyed.select(F.struct(*(F.col(f"`{c}`") for c in keyed.columns)).alias("row"), F.col("doc_id").alias("i"), F.col("source").alias("s"), n_bytes().alias("b"))
    base = stored(keyed.select("i", "s", "b"), folder, "base")
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("b")))).cast("bigint")
    per = base.groupBy("s").agg(F.count("*").alias("n"), F.sum(size).alias("x_all"))
    if weights is None:
        per = per.withColumn("w", F.floor(F.sqrt("n") * 1000).cast("bigint"))
    else:
        w = F.lit(0).cast("bigint")
        for name, value in weights.items():
            w = F.when(F.col("s") == name, F.lit(int(value)).cast("bigint")).otherwise(w)
        per = per.withColumn("w", w)
    everything = Window.partitionBy()
    want = F.lit(total).cast("bigint") if total is not None else F.sum("n").over(everything)
    per = per.withColumn("num", F.expr("cast(w as bigint)") * want).withColumn("w_all", F.sum("w").over(everything))
    per = per.withColumn("q", F.expr("if(w_all = 0, 0, num div nullif(w_all, 0))")).withColumn("r", F.expr("if(w_all = 0, 0, num % nullif(w_all, 0))"))
    rest = F.when(F.col("w_all") == 0, 0).otherwise(want - F.sum("q").over(everything))
    rank = F.row_number().over(Window.orderBy(F.col("r").desc(), F.col("s").asc_nulls_first()))
    per = stored(per.select("s", "x_all", (F.col("q") + F.when(rank <= rest, 1).otherwise(0)).cast("bigint").alias("q")), folder, "sources")

    def drawn(df: DataFrame) -> DataFrame:
        """Adds whole copies, the Pareto rank (null if nothing is left to draw for) and its bucket."""
        # the few rows of ``per`` are read from a table of known size: Spark broadcasts them if they are small, else joins by exchange
        df = df.join(per.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_"))).drop("s_")
        df = df.withColumn("e", F.col("q") * size).withColumn("whole", F.expr("e div x_all")).withColumn("p", F.expr("e % x_all") / F.col("x_all"))
        token = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("i").cast("string"), F.lit("")), F.col("b").cast("string")))
        u = (F.conv(F.substring(token, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))
        df = df.withColumn("u", u).withColumn("k", F.expr("if(p > 0, (u / (1 - u)) * ((1 - p) / nullif(p, 0)), null)"))
        return df.withColumn("bucket", F.least(F.floor(F.col("k") / (1 + F.col("k")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))

    ranked = drawn(base)
    bins = ranked.groupBy("s", "bucket").agg(F.count("*").alias("c"), F.sum("whole").alias("whole"), F.first("q").alias("q"))
    own = Window.partitionBy("s")
    bins = bins.withColumn("left", F.first("q").over(own) - F.sum("whole").over(own)).where("bucket is not null")
    bins = bins.withColumn("upto", F.sum("c").over(own.orderBy("bucket")))
    edge = stored(bins.where("left > upto - c and left <= upto").select("s", "bucket", (F.col("left") - F.col("upto") + F.col("c")).alias("need")), folder, "edge")
    # exact ranks are needed in one narrow bucket of each source only
    tie = Window.partitionBy("s").orderBy("k", F.col("i").asc_nulls_first(), "b")
    inside = ranked.join(edge.toDF("s_", "bucket_", "need"), F.col("s").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("bucket_")))
    inside = inside.withColumn("rank", F.row_number().over(tie)).where("rank <= need")
    if not expand:
        below = ranked.join(edge.toDF("s_", "edge_", "need"), F.col("s").eqNullSafe(F.col("s_")), "left")
        out = below.select("i", "s", "whole", F.when(F.col("bucket") < F.col("edge_"), 1).otherwise(0).alias("one"), (F.col("bucket") == F.col("edge_")).alias("at_edge"))
        main = out.where("not coalesce(at_edge, false)").select("i", "s", F.col("whole") + F.col("one"))
        chosen = ranked.join(edge.toDF("s_", "bucket_", "need"), F.col("s").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("bucket_")))
        chosen = chosen.withColumn("rank", F.row_number().over(tie)).select("i", "s", F.col("whole") + F.when(F.col("rank") <= F.col("need"), 1).otherwise(0))
        return main.union(chosen).toDF("doc_id", "source", "copies").where("copies > 0")
    # the last rank that is taken: a row is drawn when it does not come after it
    last = inside.groupBy("s").agg(F.max(F.struct("k", F.coalesce(F.col("i").cast("bigint"), F.lit(-(1 << 63))).alias("i"), "b")).alias("last"), F.first("need").alias("need"))
    edge_rows = ranked.join(edge.toDF("s_", "bucket_", "need"), F.col("s").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("bucket_")))
    here = F.struct("k", F.coalesce(F.col("i").cast("bigint"), F.lit(-(1 << 63))).alias("i"), "b")
    last = edge_rows.join(last.toDF("t_", "last", "need_"), F.col("s").eqNullSafe(F.col("t_"))).groupBy("s").agg(
        F.first("last").alias("last"), F.first("need_").alias("need"),
        F.sum(F.when(here < F.col("last"), 1).otherwise(0)).alias("before"), F.sum(F.when(here == F.col("last"), 1).otherwise(0)).alias("ties"))
    last = stored(last, folder, "last")
    rows = drawn(keyed).join(last.select(F.col("s").alias("s_"), "last", (F.col("need") - F.col("before")).alias("room"), "ties"), F.col("s").eqNullSafe(F.col("s_")), "left")
    tied = last.where("ties > need - before").limit(1).count() > 0
    rows = rows.withColumn("here", here)
    if tied:  # equal rows share the last rank: number them, so that the size stays exact
        number = F.row_number().over(Window.partitionBy("s", "here").orderBy(F.lit(0)))
        even = rows.where("here = last").withColumn("copies", F.col("whole") + F.when(number <= F.col("room"), 1).otherwise(0))
        rows = rows.where("here <> last or last is null or here is null").withColumn("copies", F.col("whole") + F.when(F.col("here") < F.col("last"), 1).otherwise(0)).unionByName(even)
    else:
        rows = rows.withColumn("copies", F.col("whole") + F.when(F.col("here") <= F.col("last"), 1).otherwise(0))
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(read(spark, sf_dir, "documents"), expand=False)


SQL = """
WITH base AS (
  SELECT doc_id i, source s, coalesce(strlen(text), 0) b FROM documents
), sized AS (
  SELECT *, greatest(1, ceil(sqrt(b)))::BIGINT x FROM base
), per AS (
  SELECT s, count(*)::BIGINT n, sum(x)::BIGINT x_all, floor(sqrt(count(*)) * 1000)::BIGINT w FROM sized GROUP BY s
), shares AS (
  SELECT *, w * (sum(n) OVER ())::BIGINT num, (sum(w) OVER ())::BIGINT w_all, (sum(n) OVER ())::BIGINT want FROM per
), quotas AS (
  SELECT s, x_all, num // w_all + CASE WHEN row_number() OVER (ORDER BY num % w_all DESC, s NULLS FIRST)
    <= want - (sum(num // w_all) OVER ())::BIGINT THEN 1 ELSE 0 END q FROM shares
), drawn AS (
  SELECT d.*, q, (q * x) // x_all whole, (q * x) % x_all r, ((q * x) % x_all)::DOUBLE / x_all p,
    (('0x' || substr(md5('mix-1|' || coalesce(i::VARCHAR, '') || '|' || b::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE u
  FROM sized d JOIN quotas t ON d.s IS NOT DISTINCT FROM t.s
), ranked AS (
  SELECT *, q - (sum(whole) OVER (PARTITION BY s))::BIGINT room,
    row_number() OVER (PARTITION BY s ORDER BY CASE WHEN r > 0 THEN (u / (1 - u)) * ((1 - p) / p) END NULLS LAST, i NULLS FIRST, b) k
  FROM drawn
)
SELECT i AS doc_id, s AS source, whole + CASE WHEN r > 0 AND k <= room THEN 1 ELSE 0 END AS copies
FROM ranked WHERE whole + CASE WHEN r > 0 AND k <= room THEN 1 ELSE 0 END > 0
"""
