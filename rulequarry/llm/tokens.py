"""Token counts of flat token files by separator scan.

A flat token file is nothing but unsigned 16-bit token ids, each document followed by the end-of-document id;
there is no index.  The scan reads the files in blocks, finds all separators of a block in one vectorised search,
and stitches documents that cross block boundaries with a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import flat, pieces, read, shared_dir, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK = 1 << 22


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _token_bytes(path: str) -> np.ndarray:
    coder = _encoder(path)
    out = np.zeros(coder.n_vocab + 1, np.int64)
    for piece, rank in coder._mergeable_ranks.items():
        out[rank] = len(piece)
    return out


def _end_to_end(names: pa.Array) -> str:
    lists = pa.LargeListArray.from_arrays(pa.array([0, len(names)], pa.int64()), names)
    return pc.binary_join(lists, " ")[0].as_py()


def encode(column: pa.Array, path: str = VOCABULARY, eod: int = EOD) -> np.ndarray:
    """Token ids of all rows end to end, every row followed by ``eod``; a null row has no tokens.

    A token never holds a space after a non-space, so a text can be cut in front of every single space; each
    distinct cut is encoded once.  Texts with two spaces in a row are encoded whole.
    """
    coder = _encoder(path)
    column = column.fill_null("")
    whole = pc.match_substring(column, "  ").to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(column.filter(pa.array(~whole)), " ")
    units = pc.list_flatten(cut)
    lengths = np.ones(len(column), np.int64)
    lengths[~whole] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    # where each row's units are: those of whole texts follow all others
    heads = np.zeros(len(column), np.int64)
    heads[~whole] = np.cumsum(lengths[~whole]) - lengths[~whole]
    heads[whole] = len(units) + np.arange(int(whole.sum()))
    units = pa.concat_arrays([units, column.filter(pa.array(whole))])
    first = np.zeros(len(units), bool)
    first[heads[lengths > 0]] = True
    # units with a space in front and no white space after it are encoded end to end and cut apart by their bytes
    coded = units.filter(pa.array(~first)).dictionary_encode()
    names = coded.dictionary
    safe = pc.and_(pc.greater(pc.binary_length(names), 0), pc.invert(pc.utf8_is_space(pc.utf8_slice_codeunits(names, 0, 1)))).to_numpy(zero_copy_only=False)
    joined = names.filter(pa.array(safe))
    tokens = np.array(coder.encode_ordinary(" " + _end_to_end(joined)), np.uint16) if len(joined) else np.zeros(0, np.uint16)
    ends = np.searchsorted(np.cumsum(_token_bytes(path)[tokens]), np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64) + 1)) + 1
    others = [coder.encode_ordinary(" " + name) for name in names.filter(pa.array(~safe)).to_pylist()]
    heads_ = [coder.encode_ordinary(text) for text in units.filter(pa.array(first)).to_pylist()]
    # kinds of units: the distinct spaced ones, every first one, and the separator
    size = np.r_[np.zeros(len(names), np.int64), np.array([len(x) for x in heads_], np.int64), 1]
    size[: len(names)][safe] = np.diff(ends, prepend=0)
    size[: len(names)][~safe] = [len(x) for x in others]
    place = np.cumsum(size) - size
    table = np.full(int(size.sum()), eod, np.uint16)
    kind = np.repeat(np.r_[np.where(safe, 0, 1), np.full(len(heads_), 2), 3], size)
    table[kind == 0] = tokens
    for k, lists in ((1, others), (2, heads_)):
        table[kind == k] = np.fromiter((t for x in lists for t in x), np.uint16, sum(map(len, lists)))
    ids = np.zeros(len(units), np.int64)
    ids[~first] = coded.indices.to_numpy(zero_copy_only=False)
    ids[first] = len(names) + np.arange(len(heads_))
    turn = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(heads, lengths)
    order = np.insert(ids[turn], np.cumsum(lengths), len(size) - 1)  # the separator follows each row
    n = size[order]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(place[order], n)
    return table[at]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def write_token_files(docs: DataFrame, folder: str, *, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """One flat token file per input partition under ``folder``.

    Returns the list of files and their documents in order: (file, tokens, ids).  A file of an attempt that was
    lost is in no list, so a retried task does no harm.
    """
    folder_files = folder + "/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder_files)
        system.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.bin"
        total, ids = 0, []
        with system.open_output_stream(name) as out:
            for batch in batches:
                text = batch.column(1)
                for a, b in pieces(text, 16 << 20, 1 << 20):
                    tokens = encode(text[a:b], vocabulary, eod)
                    out.write(tokens.tobytes())
                    total += len(tokens)
                ids.append(batch.column(0))
        ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        if len(ids):
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64()), lists], names=["file", "tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    return stored(rows.mapInArrow(write, "file string, tokens bigint, ids array<bigint>"), folder, "manifest")


def separator_scan(spark: SparkSession, files: DataFrame, folder: str, *, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """Documents of flat token files: (file, ordinal, n_tokens), the separator not counted.

    ``files``: columns file, tokens.  Tokens after a file's last separator are a last document.  Blocks are read
    independently of each other, a document may cross any number of them.  Empty file: no document.
    """
    blocks = files.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(block).cast("bigint"))).alias("at")).where("tokens > 0")
    # some blocks per task: a block is 2 * block bytes of input that Spark doesn't see
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for name, total, at in zip(*(c.to_pylist() for c in batch.columns)):
                n = min(block, total - at)
                with system.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(2 * n, 2 * at), np.uint16)
                found = np.flatnonzero(ids == eod).astype(np.int64) + at
                last = [int(found[-1])] if len(found) else [None]
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total]), pa.array([at]), pa.array([len(found)], pa.int64()), pa.array(last, pa.int64()), lists], names=["file", "tokens", "at", "n", "last", "found"])

    seen = stored(blocks.mapInArrow(scan, "file string, tokens bigint, at bigint, n bigint, last bigint, found array<bigint>"), folder, f"blocks-{uuid.uuid4().hex}")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    prefix = seen.select("file", "tokens", "at", "n", "last")
    prefix = prefix.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("carry", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)))
    stitched = seen.select("file", "at", "found").join(prefix.select("file", "at", "base", "carry"), ["file", "at"])
    docs = stitched.select("file", "base", "carry", "found", F.posexplode("found").alias("k", "stop"))
    docs = docs.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("stop") - F.when(F.col("k") == 0, F.col("carry")).otherwise(F.expr("try_element_at(found, k)")) - 1).alias("n_tokens"))
    tail = seen.groupBy("file").agg(F.first("tokens").alias("tokens"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    tail = tail.where("last < tokens - 1").select("file", "ordinal", (F.col("tokens") - F.col("last") - 1).alias("n_tokens"))
    return docs.union(tail)


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every row, by way of flat token files that are scanned for separators.

    Null or empty text: 0 tokens.  Repeated rows and ids: a row each.  Null id: kept.  Empty table: empty result.
    Very long texts are encoded whole, whatever the block size.  Columns other than ``doc_id`` and ``text`` are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    manifest = write_token_files(docs, folder, vocabulary=vocabulary, eod=eod)
    counts = separator_scan(spark, manifest.select("file", "tokens"), folder, eod=eod, block=block)
    ids = manifest.select("file", F.posexplode("ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
