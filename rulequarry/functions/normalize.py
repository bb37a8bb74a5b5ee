"""Normalizers: one statistics aggregate, then one expression per coordinate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

METHODS = ("NO_NORMALIZATION", "MIN_MAX_SCALING", "MEAN_NORMALIZATION", "MAX_ABSOLUTE_SCALING", "MEDIAN_NORMALIZATION", "DECIMAL_SCALING", "TANH_ESTIMATOR", "Z_NORMALIZATION", "EMPIRICAL_CDF")


def digits(v: Column) -> Column:
    """Digits in front of the decimal point: floor(log10 |v|) + 1, at least 0, and 1 for 0."""
    return F.when(v == 0, 1).otherwise(F.greatest(F.lit(0), F.floor(F.log10(F.when(v != 0, F.abs(v)))) + 1)).cast("int")


def statistics(c: str, over: WindowSpec | None = None, median: bool = False, exact: bool = True) -> dict[str, Column]:
    """count, sum, min, max, mean, deviation, greatest magnitude and digits of a column; over a window if one is given."""
    v = F.col(c)
    out = {"count": F.count(v), "sum": F.sum(v), "sum_sq": F.sum(v * v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_pop(v), "max_abs": F.max(F.abs(v)), "digits": F.max(digits(v))}
    if median:
        out["median"] = F.percentile(v, F.lit(0.5)) if exact else F.percentile_approx(v, 0.5, 10_000).cast("double")
    return {k: (x.over(over) if over is not None else x) for k, x in out.items()}


def expression(method: str, v: Column, s: dict[str, Column]) -> Column:
    """A value normalized by its column's statistics; where these leave no spread the result is as documented per method."""
    if method == "NO_NORMALIZATION":
        return v
    if method == "MIN_MAX_SCALING":
        return F.when(s["max"] != s["min"], (v - s["min"]) / (s["max"] - s["min"])).when(v.isNotNull(), 0.0)
    if method == "MEAN_NORMALIZATION":
        return F.when(s["max"] != s["min"], (v - s["mean"]) / (s["max"] - s["min"])).when(v.isNotNull(), 0.0)
    if method == "MAX_ABSOLUTE_SCALING":
        return F.when(s["max_abs"] != 0, v / s["max_abs"]).when(v.isNotNull(), 0.0)
    if method == "MEDIAN_NORMALIZATION":
        return F.when(s["median"] != 0, v / s["median"]).when(v.isNotNull(), 0.0)
    if method == "DECIMAL_SCALING":
        return v / F.pow(F.lit(10.0), s["digits"])
    if method == "TANH_ESTIMATOR":
        return F.when(s["std"] != 0, 0.5 * F.tanh(0.01 * (v - s["mean"]) / s["std"]) + 0.5).when(v.isNotNull(), 0.5)
    if method == "Z_NORMALIZATION":
        return F.when(s["std"] != 0, (v - s["mean"]) / s["std"]).when(v.isNotNull(), 0.0)
    raise ValueError(f"unknown normalization {method!r}")


def normalize(df: DataFrame, columns: Sequence[str], method: str, *, exact: bool = True) -> DataFrame:
    """``columns`` replaced by their normalized values, the statistics taken over the whole DataFrame.

    One aggregation and a join with its single row; the empirical distribution function is a window instead
    (``exact``) or a KLL sketch, whose marks the workers look each value up in.  Exact medians come from a few passes.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalization {method!r}")
    if method == "EMPIRICAL_CDF":
        if exact:
            return _exact_cdf(df, columns)
        sketch = df.agg(*(F.kll_sketch_agg_double(F.col(c)).alias(f"__{c}") for c in columns))
        share = [i / 256 for i in range(257)]
        marks = sketch.select(*(F.kll_sketch_get_quantile_double(f"__{c}", F.array(*map(F.lit, share))).alias(f"__{c}") for c in columns)).first()
        return df.withColumns({c: _rank(marks[i] or [])(F.col(c).cast("double")) for i, c in enumerate(columns)}).select(*df.columns)
    if method == "MEDIAN_NORMALIZATION" and exact:
        middle = {c: F.lit(m).cast("double") for c, m in zip(columns, exact_medians(df, columns))}
        return df.withColumns({c: expression(method, F.col(c), {"median": middle[c]}) for c in columns}).select(*df.columns)
    stats = df.agg(*(x.alias(f"__{c}_{k}") for c in columns for k, x in statistics(c, median=method == "MEDIAN_NORMALIZATION", exact=exact).items()))
    out = df.crossJoin(F.broadcast(stats))  # one row
    names = ["count", "sum", "sum_sq", "min", "max", "mean", "std", "max_abs", "digits", *(["median"] if method == "MEDIAN_NORMALIZATION" else [])]
    return out.withColumns({c: expression(method, F.col(c), {k: F.col(f"__{c}_{k}") for k in names}) for c in columns}).select(*df.columns)


def _rank(marks: Sequence[float]) -> Callable[[Column], Column]:
    """The share of ``marks``, in order, that are not above a value."""
    ordered = np.array(marks, np.float64)

    def rank(v: pd.Series) -> pd.Series:
        found = np.searchsorted(ordered, v.to_numpy(np.float64, na_value=np.nan), side="right") / 257
        return pd.Series(found)

    share = F.pandas_udf(rank, "double")
    return lambda v: F.when(v.isNotNull(), share(v))


def exact_medians(df: DataFrame, columns: Sequence[str], few: int = 10_000, accuracy: int = 10_000) -> list[float | None]:
    """The median of every column, that of the two middle values where their number is even; None without values.

    A pass over the rows narrows each column down to the values between two approximate percentiles around the middle;
    once ``few`` distinct values at most are left, they are counted, in order.  So no task holds a column's values.
    """
    v = {c: F.col(c).cast("double") for c in columns}
    told = df.agg(*(x for i, c in enumerate(columns) for x in (F.count(v[c]).alias(f"n{i}"), F.approx_count_distinct(v[c]).alias(f"d{i}")))).first()
    state = {c: (0, told[f"n{i}"], told[f"d{i}"]) for i, c in enumerate(columns)}  # values below the span, in it, distinct ones in it
    span: dict[str, tuple[float, float] | None] = {c: None for c in columns}  # None: all values
    inside = lambda c: v[c].isNotNull() if span[c] is None else (v[c] >= F.lit(span[c][0])) & (v[c] <= F.lit(span[c][1]))
    below = lambda c: F.lit(False) if span[c] is None else v[c] < F.lit(span[c][0])
    open_ = [c for c in columns if state[c][1]]
    out: dict[str, float | None] = {c: None for c in columns}
    ranks = {c: ((state[c][1] - 1) // 2, state[c][1] // 2) for c in columns}
    while open_:
        for c in [c for c in open_ if state[c][2] <= few]:
            before = state[c][0]
            for r in df.where(inside(c)).groupBy(v[c].alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect():  # about ``few`` rows
                hit = [before <= k < before + r.n for k in ranks[c]]
                if hit[0]:
                    out[c] = r.v
                if hit[1]:
                    out[c] = r.v if hit[0] else 0.5 * out[c] + 0.5 * r.v
                    break
                before += r.n
            if out[c] is None:  # the percentiles missed the middle
                out[c] = df.agg(F.percentile(v[c], F.lit(0.5))).first()[0]
            open_.remove(c)
        if not open_:
            break
        edges = {}
        for c in open_:
            before, n, _ = state[c]
            low, high = ((k - before) / n for k in ranks[c])
            edges[c] = [max(0.0, low - 3 / accuracy), min(1.0, high + 3 / accuracy)]
        marks = df.agg(*(F.percentile_approx(F.when(inside(c), v[c]), edges[c], accuracy).alias(str(i)) for i, c in enumerate(open_))).first()
        for i, c in enumerate(open_):
            span[c] = tuple(marks[i])
        told = df.agg(*(x for i, c in enumerate(open_) for x in (F.count(F.when(below(c), 1)).alias(f"b{i}"), F.count(F.when(inside(c), 1)).alias(f"n{i}"), F.approx_count_distinct(F.when(inside(c), v[c])).alias(f"d{i}")))).first()
        state = {c: (told[f"b{i}"], told[f"n{i}"], told[f"d{i}"]) for i, c in enumerate(open_)}
    return [out[c] for c in columns]


def _exact_cdf(df: DataFrame, columns: Sequence[str], parts: int = 256) -> DataFrame:
    """cume_dist of every column without a window over all rows.

    Rows are counted by value; the counts are summed up inside stretches of the value range, whose bounds one pass over
    the rows gives for all columns, and the sums go back to the rows by value.  A column of few values needs few counts.
    """
    names, rows = df.columns, df
    share = [i / parts for i in range(1, parts)]
    marks = rows.agg(*(F.percentile_approx(c, share, 1000).alias(f"__{i}") for i, c in enumerate(columns))).first()
    for i, c in enumerate(columns):
        bounds = sorted(set(marks[i] or []))
        stretch = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("__v"))) if bounds else F.lit(0)  # noqa: B023
        counts = rows.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n")).withColumn("__s", F.when(F.col("__v").isNotNull(), stretch))
        sizes = counts.groupBy(F.col("__s").alias("__t")).agg(F.sum("__n").alias("__m"))  # a row per stretch
        upto = F.sum(F.when(F.col("__t").isNotNull(), F.col("__m"))).over(Window.orderBy(F.col("__t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
        sizes = sizes.select("__t", F.coalesce(upto, F.lit(0)).alias("__before"), F.sum("__m").over(Window.partitionBy()).alias("__all"))
        inside = F.sum("__n").over(Window.partitionBy("__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        ranks = counts.where("__v is not null").join(F.broadcast(sizes), F.col("__s") == F.col("__t"))  # parts + 1 rows
        ranks = ranks.select("__v", ((F.col("__before") + inside) / F.col("__all")).alias("__r"))
        df = df.join(ranks, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__r")).select(*names)
    return df


def running(df: DataFrame, columns: Sequence[str], method: str, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Every value normalized by the statistics of its row and all rows before it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: expression(method, F.col(c), statistics(c, w)) for c in columns})


def ideal_nadir(v: Column, low: Column, high: Column) -> Column:
    """Min-max scaling that leaves the value as it is if both ends are equal."""
    return F.when(high != low, (v - low) / (high - low)).otherwise(v)
