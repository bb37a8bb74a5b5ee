"""A training corpus from raw documents: five stages, each of which works on all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's ``docs``; all but the last keep the columns of ``documents``.

Every stage keeps all columns of its input, whatever their names, takes very long texts whole, and returns an empty
table for an empty one.  Null ids and repeated rows are rows like others but where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulequarry.llm import decontaminate, jaccard, mixing, quality, sharding
from rulequarry.llm._common import read, shared_dir, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, finds worth keeping.

    Null and empty texts hold no evidence against themselves and stay, as does a tie (probability 1/2).  No usable
    label: all stay.  Repeated rows share their fate.
    """
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality.probability(net)("text") >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the least by (doc_id, text fingerprint), null ids first.

    Null, empty and blank texts belong to no group and all stay.  Repeated rows are a group: one of them stays.
    """
    return jaccard.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts stay; null and empty passages match nothing.  Repeated rows share their fate.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as came in, drawn to the target share of each source; some documents repeat, some are left out.

    A null source is a source of its own; null and empty texts have the least size.  Of rows that tie in rank, equal in
    id and bytes, any may be drawn.
    """
    return mixing.pareto_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in byte-balanced shards by document id, with their shard's number in ``shard`` (replaced if it is there).

    Null ids come first; rows of one id stay together.  Null and empty texts have 0 bytes.
    """
    return sharding.histogram_sort(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL: str | None = None  # a trained network can't be written in SQL; the tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, folder, f"stage-{k}")
    return docs
