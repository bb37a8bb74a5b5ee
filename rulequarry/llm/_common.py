"""Helpers that the corpus operators share.

Text handling: a null text counts as an empty one everywhere.  Intermediate tables go to the shared
folder named by ``spark.checkpoint.dir`` so that a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and Spark runs inside
    one process (tests) a temporary folder is made and recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rulequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rulequarry-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and is computed once."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(col: Column | str = "text") -> Column:
    """64-bit fingerprint of a text, null as empty; with the id it names a row."""
    return F.xxhash64(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


FILTER_BITS = 1 << 26
PIECE = 1 << 18  # bytes of text that a worker takes at a time where it holds many 64-bit numbers for each of them


def key_filter(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """Tells of a column of 64-bit fingerprints which may be among ``keys``: of keys always, of others hardly ever.

    A Bloom filter of three bits a key in 8 MB, whatever the number of keys: more of them let more others pass.
    """
    spots = F.explode(F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(FILTER_BITS)) for salt in range(3)))).alias("spot")
    found = keys.select(spots).groupBy((F.col("spot") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(spot, 64) as int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, U64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U64)
    where = np.flatnonzero(bits).astype(np.int32)
    packed, some = zlib.compress(where.tobytes() + bits[where].tobytes(), 1), len(where)
    held: list[np.ndarray] = []

    @F.pandas_udf("boolean")
    def among(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        if not held:
            raw = zlib.decompress(packed)
            full = np.zeros(FILTER_BITS // 64, U64)
            full[np.frombuffer(raw, np.int32, some)] = np.frombuffer(raw, U64, some, 4 * some)
            held.append(full)
        hit = np.ones(len(a), bool)
        for spot in (a, b, c):
            at = spot.to_numpy().astype(np.int64)
            hit &= (held[0][at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
        return pd.Series(hit)

    return lambda column: among(*(F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(FILTER_BITS)) for salt in range(3)))


def n_bytes(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("bigint")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most_bytes: int = 1 << 21, most_rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Row ranges of a column that hold at most ``most_bytes`` (or one row) each; together all rows."""
    _, at = flat(column)
    start, n = 0, len(at) - 1
    while start < n:
        stop = int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1
        stop = max(start + 1, min(stop, start + most_rows, n))
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finalizer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words of all rows: 64-bit hash, first byte, byte after, and per row the first word's index.

    White space is any byte up to 0x20; a row's end ends a word.  The last array has n + 1 entries.
    """
    gap = raw <= 32
    start = ~gap
    start[1:] &= gap[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(raw)]
    start[inner] |= ~gap[inner]
    first = np.flatnonzero(start)
    if len(first) == 0:
        return np.zeros(0, U64), first, first, np.zeros(len(at), np.int64)
    stop = ~gap
    stop[:-1] &= gap[1:]
    ends = at[1:-1] - 1
    ends = ends[(ends >= 0) & (ends < len(raw))]
    stop[ends] |= ~gap[ends]
    last = np.flatnonzero(stop) + 1
    size = last - first
    keep = np.flatnonzero(~gap)
    inside = np.arange(len(keep)) - np.repeat(np.cumsum(size) - size, size)
    value = _BYTE[raw[keep]] * powers(int(size.max()))[inside]
    h = mix64(np.add.reduceat(value, np.cumsum(size) - size))
    return h, first, last, np.searchsorted(first, at)


def components(pairs: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, label), label the least node of the component.

    Alternating large-star and small-star steps on the edge table, each pair of them written to the shared folder; the
    number of rounds grows with the logarithm of the component size, and no node is ever collected.  A round is one
    straight line of three exchanges (least neighbours by windows, no joins), so that its plan costs the driver little.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, folder, "cc-0")
    step = 0
    least = F.min("v").over(Window.partitionBy("u"))

    def two(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        return df.select(F.inline(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (first, second)))))

    def large_star(df: DataFrame) -> DataFrame:
        near = two(df, ("u", "v"), ("v", "u")).withColumn("m", F.least("u", least))
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # as many rows as there are edges

    def small_star(df: DataFrame) -> DataFrame:
        # each edge leads from its larger end to its smaller one here, as large_star leaves it
        return two(df.withColumn("m", least), ("v", "m"), ("u", "m")).where("u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        step += 1
        edges = stored(small_star(large_star(edges)), folder, f"cc-{step}")
        now = state(edges)
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(heads)
