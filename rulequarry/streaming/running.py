"""Running normalization and item counts over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_minmax(stream: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each value scaled by the least and greatest that its key has shown so far: (key, order, value, scaled).

    The state of a key is two numbers.  Rows of a micro-batch are taken in ``order``; a value without spread is 0, a
    null value stays null and changes nothing.
    """
    schema = stream.select(key, *order, F.col(value).cast("double").alias(value)).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", scaled double"

    def scale(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        low, high = state.get if state.exists else (float("inf"), float("-inf"))
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        v = rows[value].astype("float64")
        lows = v.fillna(float("inf")).cummin().clip(upper=low)
        highs = v.fillna(float("-inf")).cummax().clip(lower=high)
        spread = highs - lows
        scaled = ((v - lows) / spread.where(spread > 0)).where(spread > 0, 0.0).where(v.notna())
        if len(rows):
            state.update((float(lows.iloc[-1]), float(highs.iloc[-1])))
        yield rows.assign(scaled=scaled)

    rows = stream.select(key, *order, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(scale, out, "low double, high double", "append", "NoTimeout")


def item_counts(stream: DataFrame, item: str = "item") -> DataFrame:
    """Frequencies of items over a stream of distinct (tid, item) rows, for complete or update output."""
    return stream.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("f"))
