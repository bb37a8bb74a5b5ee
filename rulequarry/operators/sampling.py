"""Rule samplers: reproducible hash draws as plain DataFrames, and Markov chains that run side by side.

A chain walks over transactions or over mined rules.  Of transactions the shared folder holds one bit per transaction and
item, in segments of some transactions; a worker looks up the items it needs and counts each rule when the chain comes to
it: antecedents may have any size and frequency, and neither driver nor worker holds all.  Of mined rules a worker gets the
frequencies; a rule that is not among them scores 0.
"""

from __future__ import annotations

import hashlib
import math
import os
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import hash_coin, hash_key
from ..sources import files
from . import transactions as tx_

MOST_RULES = 2_000_000  # mined rules that are sent to every worker
SEGMENT = 16 << 20  # bytes of bits that a worker packs at a time
RECENT = 64 << 20  # bytes of covers of antecedents that a chain remembers, one at least


def kfold(df: DataFrame, key: Sequence[str], k: int, seed: str = "42") -> DataFrame:
    """Adds ``fold``, 0 to k - 1, from a digest of the key: no exchange, the same folds on every run."""
    return df.withColumn("fold", (F.conv(F.substring(hash_key(*key, seed=seed), 1, 8), 16, 10).cast("bigint") % k).cast("int"))


def train_test(df: DataFrame, k: int) -> DataFrame:
    """Every row once per fold with ``split`` = test in its own fold and train in the others."""
    all_ = df.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return all_.withColumn("split", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")).drop("own")


def random_rules(tx: DataFrame, tries: int, seed: str = "1") -> DataFrame:
    """Rules read off the ``tries`` transactions of least digest: (x, y).

    An antecedent item stays by a fair hash coin; the class item of least digest is the consequent.  Empty antecedents
    and transactions without a class are dropped, equal rules merged.
    """
    held = tx_.baskets(tx)
    rows = held.select("tid").orderBy(hash_key("tid", seed=seed), "tid").limit(tries)
    own = tx_.long(held.join(F.broadcast(rows), "tid"))  # ``tries`` rows
    cls = tx_.is_class("item")
    kept = F.when(~cls & (hash_coin("tid", "item", seed=seed) < 0.5), F.col("item"))
    pick = F.min_by("item", hash_key("tid", "item", seed=seed)).alias("y")
    sides = own.groupBy("tid").agg(F.array_join(F.array_sort(F.collect_set(kept)), ";").alias("x"))
    classes = own.where(cls).groupBy("tid").agg(pick)
    return sides.join(classes, "tid").where("x <> ''").select("x", "y").distinct()


def hash_sample(rules: DataFrame, n: int, seed: str = "1", key: str = "rule_id") -> DataFrame:
    """n distinct rules of a candidate table, picked by digest."""
    return rules.orderBy(hash_key(key, seed=seed), key).limit(n)


def grid(low: Sequence[float], high: Sequence[float], n: int, spark) -> DataFrame:
    """floor(sqrt(n)) equally spaced points per dimension over the box: (id, v)."""
    side = int(math.sqrt(n))
    df = spark.range(1).select(F.array().cast("array<double>").alias("v"))
    for a, b in zip(low, high):
        step = (b - a) / (math.sqrt(n) - 1)
        df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).select(F.concat("v", F.array(F.lit(float(a)) + F.col("i") * float(step))).alias("v"))
    return df


Frequencies = dict[tuple[frozenset, str], tuple[int, int, int]]


@dataclass
class Segment:
    """Some transactions of a file: from byte ``at`` on, a row of 64-bit words for each item."""

    file: str
    at: int
    rows: int


class Covers:
    """Frequencies of any rule, counted when asked for: bit t of an item's row says that transaction t has it."""

    def __init__(self, names: list[str], segments: list[Segment], classes: set[str]):
        self.at, self.segments, self.classes = {name: i for i, name in enumerate(names)}, segments, classes
        self.start = np.cumsum([0, *(s.rows for s in segments)])
        self.rows = int(self.start[-1])
        self.files: dict[str, object] = {}
        self.of_class: dict[str, int] = {}
        self.of_set: dict[frozenset, int] = {}
        self.of_rule: dict[tuple[frozenset, str], int] = {}
        self.recent: OrderedDict[frozenset, list[np.ndarray]] = OrderedDict()

    def __len__(self) -> int:
        return self.rows

    def item(self, name: str, segment: Segment) -> np.ndarray:
        """An item's bits in a segment, mapped where the folder is local."""
        if segment.file not in self.files:
            system, path = _filesystem(segment.file)
            self.files[segment.file] = np.memmap(path, np.uint64, "r") if system.type_name == "local" else system.open_input_file(path)
        file, words = self.files[segment.file], -(-segment.rows // 64)
        start = segment.at // 8 + self.at[name] * words
        return file[start : start + words] if isinstance(file, np.memmap) else np.frombuffer(file.read_at(8 * words, 8 * start), np.uint64)

    def cover(self, x: frozenset) -> list[np.ndarray]:
        """The bits of an antecedent by segment; the last ones are remembered, and one item more is one step from there."""
        if x not in self.recent:
            near = next((i for i in x if x - {i} in self.recent), None)
            if near is not None:
                found = [old & self.item(near, s) for old, s in zip(self.recent[x - {near}], self.segments)]
            else:
                found = []
                for s in self.segments:
                    bits = None
                    for i in x:
                        bits = self.item(i, s) if bits is None else bits & self.item(i, s)
                    found.append(bits)
            self.recent[x] = found
            while len(self.recent) > max(1, RECENT // max(1, self.rows // 8)):
                self.recent.popitem(last=False)
        self.recent.move_to_end(x)
        return self.recent[x]

    def fx(self, x: frozenset) -> int:
        """How many transactions hold ``x``; the empty antecedent is in every one."""
        if x not in self.of_set:
            self.of_set[x] = sum(int(np.bitwise_count(b).sum()) for b in self.cover(x)) if x else self.rows
        return self.of_set[x]

    def fy(self, y: str) -> int:
        if y not in self.of_class:
            self.of_class[y] = sum(int(np.bitwise_count(self.item(y, s)).sum()) for s in self.segments)
        return self.of_class[y]

    def count(self, x: frozenset, y: str) -> tuple[int, int, int]:
        """(fx, fy, fz)."""
        if (x, y) not in self.of_rule:
            self.of_rule[x, y] = sum(int(np.bitwise_count(b & self.item(y, s)).sum()) for b, s in zip(self.cover(x), self.segments)) if x else self.fy(y)
        return self.fx(x), self.fy(y), self.of_rule[x, y]

    def get(self, rule: tuple[frozenset, str]) -> tuple[int, int, int] | None:
        """The frequencies of a valid rule: none of them is 0 or the number of transactions."""
        f = self.count(*rule) if rule[0] else (0, 0, 0)
        return f if min(f) > 0 and max(f) < self.rows else None

    def draw(self, random: Random, k: int) -> list[tuple[frozenset, str]]:
        """Up to k distinct valid rules read off random transactions, in at most 200 k tries."""
        out: dict[tuple[frozenset, str], None] = {}
        for _ in range(200 * k):
            t = random.randrange(self.rows)
            at = int(np.searchsorted(self.start, t, side="right")) - 1
            t -= int(self.start[at])
            own = [name for name in self.at if int(self.item(name, self.segments[at])[t >> 6]) >> (t & 63) & 1]
            x = frozenset(i for i in own if i not in self.classes and random.random() < 0.5)
            y = [i for i in own if i in self.classes]
            if x and y and self.get(rule := (x, random.choice(y))):
                out[rule] = None
            if len(out) == k:
                break
        return list(out)


def measure_vector(fx: int, fy: int, fz: int, n: int, names: Sequence[str], smooth: float) -> list[float]:
    """The measures of one rule in plain Python, for chains; 0 where a denominator vanishes."""
    s, n_ = smooth, n + 4 * smooth
    n11, n10, n01, n00 = fz + s, fx - fz + s, fy - fz + s, n - fx - fy + fz + s
    n1x, nx1 = fx + 2 * s, fy + 2 * s
    n0x, nx0 = n_ - n1x, n_ - nx1
    most = max(nx1, nx0)

    def ratio(a: float, b: float) -> float:
        return a / b if b else 0.0

    odds = ratio(n11 * n00, n10 * n01)
    all_ = {
        "confidence": ratio(n11, n1x), "lift": ratio(n_ * n11, n1x * nx1), "cosine": ratio(n11, math.sqrt(n1x * nx1)),
        "phi": ratio(n_ * n11 - n1x * nx1, math.sqrt(max(n1x * nx1 * n0x * nx0, 0))), "kruskal": ratio(max(n11, n10) + max(n01, n00) - most, n_ - most),
        "yuleQ": ratio(odds - 1, odds + 1), "pavillon": ratio(n11, n1x) - ratio(nx1, n_),
        "certainty": max(ratio(ratio(n11, n1x) - nx1 / n_, 1 - nx1 / n_), ratio(ratio(n11, nx1) - n1x / n_, 1 - n1x / n_)), "support": ratio(n11, n_), "revsup": 1 - ratio(n11, n_),
    }
    return [all_[name] for name in names]


THETA: dict[str, Callable[[float, float], float]] = {
    "ScoreDifference": lambda a, b: min(1.0, max(0.0, 0.999 * ((a - b) / 2 + 0.5) + 0.001)),
    "BradleyTerry": lambda a, b: 1 / (1 + math.exp(min(700.0, b - a))),
    "Thurstone": lambda a, b: 0.5 * (1 + math.erf((a - b) / math.sqrt(2))),
}


@dataclass
class Chain:
    """One walk over rules."""

    frequencies: Frequencies | Covers
    antecedents: list[str]
    classes: list[str]
    n: int
    names: Sequence[str]
    certainty: str
    smooth: float
    random: Random
    x: frozenset = frozenset()
    y: str = ""
    best: dict[tuple[frozenset, str], float] = field(default_factory=dict)
    scorer: Callable[[list[float]], float] | None = None

    def score(self, x: frozenset, y: str) -> float:
        f = self.frequencies.get((x, y))
        if f is None:
            return 0.0
        v = measure_vector(*f, self.n, self.names, self.smooth)
        return self.scorer(v) if self.scorer else sum(v) / len(v)

    def seeds(self, k: int) -> list[tuple[frozenset, str]]:
        if isinstance(self.frequencies, Covers):
            return self.frequencies.draw(self.random, k)
        table = sorted(self.frequencies, key=lambda r: (sorted(r[0]), r[1]))
        return self.random.sample(table, min(k, len(table)))

    def start(self) -> bool:
        for self.x, self.y in self.seeds(1):
            return True
        return False

    def g(self, x: frozenset) -> float:
        """The unrestricted sampler's value: fy / n of an antecedent that occurs."""
        if isinstance(self.frequencies, Covers):
            fx, fy, _ = self.frequencies.count(x, self.y)
            return fy / self.n if fx else 0.0
        return self.frequencies.get((x, self.y), (0, 0, 0))[1] / self.n

    def _accept(self, new: float, old: float) -> bool:
        return new != 0 and self.random.random() <= THETA[self.certainty](new, old)

    def step(self, halve: bool = False) -> None:
        if halve and len(self.x) > 1:
            part = frozenset(self.random.sample(sorted(self.x), len(self.x) - len(self.x) // 2))
            if self._accept(self.score(part, self.y), self.score(self.x, self.y)):
                self.x = part
        for item in self.random.sample(self.antecedents, len(self.antecedents)):
            old = self.score(self.x, self.y)
            if item in self.x:
                if self._accept(old, old):
                    break
                if len(self.x) > 1:
                    self.x = self.x - {item}
            elif self._accept(self.score(self.x | {item}, self.y), old):
                self.x = self.x | {item}
                break
        for y in self.random.sample(self.classes, len(self.classes)):
            if y != self.y and self._accept(self.score(self.x, y), self.score(self.x, self.y)):
                self.y = y
                break
        s = self.score(self.x, self.y)
        if s:
            self.best[self.x, self.y] = s


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _load_covers(tx: DataFrame) -> tuple[list[str], list[Segment]]:
    """Item names in the order in which they come up, and the segments of the transactions in order of their ids."""
    held = files.kept(tx_.baskets(tx))
    null = F.max(F.col("tid").isNull().cast("int")).alias("null")
    first = tx_.long(held).groupBy("item").agg(F.min("tid").alias("tid"), null).orderBy(F.desc("null"), "tid", "item")
    names = [r.item for r in first.select("item").collect()]  # as many as there are items
    folder = files.work_dir(tx.sparkSession)
    most = max(64, SEGMENT * 8 // max(1, len(names)) // 64 * 64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        file, known = f"{folder}/{uuid.uuid4().hex}.bits", pa.array(names, pa.string())
        sizes: list[int] = []
        with system.open_output_stream(_filesystem(file)[1]) as out:

            def flush(lists: list[pa.Array]) -> None:
                rows = sum(map(len, lists))
                bits = np.zeros((len(names), -(-rows // 64)), np.uint64)
                start = 0
                for part in lists:
                    row, item = tx_.ids_of(part, known)
                    row += start
                    np.bitwise_or.at(bits, (item, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
                    start += len(part)
                out.write(bits.tobytes())
                sizes.append(rows)

            lists, held_ = [], 0
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.column(0).slice(at, most - held_)
                    lists.append(part)
                    at, held_ = at + len(part), held_ + len(part)
                    if held_ == most:
                        flush(lists)
                        lists, held_ = [], 0
            if lists:
                flush(lists)
        ats = np.cumsum([0, *(8 * len(names) * -(-n // 64) for n in sizes)])[:-1]
        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(sizes), pa.int32()), pa.array([file] * len(sizes), pa.string()), pa.array(ats.tolist(), pa.int64()), pa.array(sizes, pa.int64())], names=["part", "file", "at", "rows"])

    # a segment is named by the task that wrote it, so a retried task does no harm
    ordered = held.repartitionByRange(tx_.tasks(tx.sparkSession, held, each=4 << 20), "tid").sortWithinPartitions("tid")  # a stored basket takes a few bytes
    found = ordered.select("items").mapInArrow(pack, "part int, file string, at bigint, rows bigint").collect()  # a row for each segment
    return names, [Segment(r.file, r["at"], r.rows) for r in sorted(found)]


def _load(rules: DataFrame, n: int) -> tuple[Frequencies, list[str], list[str]]:
    size = rules.count()
    if size > MOST_RULES:
        raise ValueError(f"{size} rules are too many to walk over; mine with a higher least frequency")
    table = rules.select("x", "y", "fx", "fy", "fz").collect()  # bounded by MOST_RULES
    freq = {(frozenset(r.x.split(";")), r.y): (r.fx, r.fy, r.fz) for r in table}
    return freq, sorted({i for x, _ in freq for i in x}), sorted({y for _, y in freq})


def _chains(rules: DataFrame, n: int, chains: int, seed: str, walk: Callable[[Chain], list[tuple]], schema: str, class_item: Column | None = None, **options) -> DataFrame:
    spark = rules.sparkSession
    walks_covers = "tid" in rules.columns
    if walks_covers:
        names, segments = _load_covers(rules)
        classes_ = sorted(r.item for r in spark.createDataFrame([(i,) for i in names], "item string").where(tx_.is_class() if class_item is None else class_item).collect())
        shared = spark.sparkContext.broadcast((names, segments, classes_))
    else:
        shared = spark.sparkContext.broadcast(_load(rules, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if walks_covers:
            classes = shared.value[2]
            freq = Covers(*shared.value[:2], set(classes))
            items = sorted(set(shared.value[0]) - set(classes))
        else:
            freq, items, classes = shared.value
        for batch in batches:
            for chain_id in batch["id"]:
                own = Random(int(hashlib.md5(f"{seed}|{chain_id}".encode()).hexdigest(), 16))
                if not freq:
                    continue
                chain = Chain(freq, items, classes, n, options["names"], options["certainty"], options["smooth"], own)
                if not chain.start():
                    continue
                rows = walk(chain)
                yield pd.DataFrame([(int(chain_id), *r) for r in rows], columns=[c.split()[0] for c in ("chain " + "bigint, " + schema).split(", ")])

    return spark.range(chains, numPartitions=min(chains, max(1, spark.sparkContext.defaultParallelism))).mapInPandas(run, "chain bigint, " + schema)


MEASURES = ("lift", "confidence", "support", "yuleQ", "kruskal")


def smas(rules: DataFrame, n: int, *, chains: int = 8, iterations: int = 100, k: int = 10, certainty: str = "BradleyTerry", names: Sequence[str] = MEASURES, smooth: float = 0.01, seed: str = "1", halve: bool = False, class_item: Column | None = None) -> DataFrame:
    """The k best distinct rules that the chains visited: (x, y, score).  ``halve`` tries to drop half of X first (batch sampler)."""

    def walk(chain: Chain) -> list[tuple]:
        for _ in range(iterations):
            chain.step(halve)
        top = sorted(chain.best.items(), key=lambda e: (-e[1], sorted(e[0][0]), e[0][1]))[:k]
        return [(";".join(sorted(x)), y, s) for (x, y), s in top]

    found = _chains(rules, n, chains, seed, walk, "x string, y string, score double", names=names, certainty=certainty, smooth=smooth, class_item=class_item)
    return found.groupBy("x", "y").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "x", "y").limit(k)


def random_sample(tx: DataFrame, n: int, *, draws: int = 20, chains: int = 8, most: int = 5, seconds: float | None = None, seed: str = "1", class_item: Column | None = None) -> DataFrame:
    """Distinct random rules (x, y) of transactions, ``draws`` in each of ``chains`` tasks that run side by side.

    A class is drawn uniformly and a size from 1 to ``most``; items are added in random order if the rule stays valid,
    until the size is reached.  A chain that isn't done after ``seconds`` returns nothing.
    """

    def walk(chain: Chain) -> list[tuple]:
        begun, out = time.monotonic(), []
        for _ in range(draws):
            if seconds is not None and time.monotonic() - begun > seconds:
                return []
            x, y, size = frozenset(), chain.random.choice(chain.classes), chain.random.randint(1, most)
            for item in chain.random.sample(chain.antecedents, len(chain.antecedents)):
                if len(x) == size:
                    break
                if chain.frequencies.get((x | {item}, y)):
                    x = x | {item}
            if x:
                out.append((";".join(sorted(x)), y))
        return out

    found = _chains(tx, n, chains, seed, walk, "x string, y string", names=MEASURES, certainty="BradleyTerry", smooth=0.01, class_item=class_item)
    return found.select("x", "y").distinct()


def gibbs(rules: DataFrame, n: int, *, chains: int = 8, iterations: int = 50, steep: float = 1000.0, seed: str = "1", class_item: Column | None = None) -> DataFrame:
    """Unrestricted sampler: every item is redrawn with odds exp(steep * (g with - g without)); valid states are kept."""

    def walk(chain: Chain) -> list[tuple]:
        out: OrderedDict[tuple, None] = OrderedDict()
        for _ in range(iterations):
            for item in chain.antecedents:
                g = [chain.g(s) for s in (chain.x | {item}, chain.x - {item})]
                p = 1 / (1 + math.exp(max(-700.0, min(700.0, steep * (g[1] - g[0])))))
                chain.x = chain.x | {item} if chain.random.random() <= p else chain.x - {item}
            chain.y = chain.random.choice(chain.classes)
            if chain.frequencies.get((chain.x, chain.y)):
                out[";".join(sorted(chain.x)), chain.y] = None
        return list(out)

    return _chains(rules, n, chains, seed, walk, "x string, y string", names=MEASURES, certainty="BradleyTerry", smooth=0.01, class_item=class_item).select("x", "y").distinct()


def mmas(rules: DataFrame, n: int, *, chains: int = 4, iterations: int = 30, k: int = 10, certainty: str = "ScoreDifference", names: Sequence[str] = MEASURES, smooth: float = 0.01, seed: str = "1", memory: int = 10, class_item: Column | None = None) -> DataFrame:
    """The k most uncertain rule pairs: each step walks towards a rule that is hard to tell from one of the last ``memory``."""

    def walk(chain: Chain) -> list[tuple]:
        plain = lambda x, y: Chain.score(chain, x, y)
        history: OrderedDict[tuple, float] = OrderedDict()
        for rule in chain.seeds(memory):
            history[rule] = plain(*rule)
        theta = THETA[certainty]
        pairs: dict[tuple, float] = {}
        for _ in range(iterations):
            best, value = None, -1.0
            for _ in range(10):
                chain.step()
                s = plain(chain.x, chain.y)
                u = max((1 - abs(1 - 2 * theta(s, h)) for r, h in history.items() if r != (chain.x, chain.y)), default=0.0)
                if u > value:
                    best, value = (chain.x, chain.y), u
            s = plain(*best)
            for rule, h in history.items():
                if rule != best:
                    a, b = sorted((f"{';'.join(sorted(r[0]))}=>{r[1]}" for r in (rule, best)))
                    pairs[a, b] = 1 - abs(1 - 2 * theta(s, h))
            history[best] = s
            history.move_to_end(best)
            while len(history) > memory:
                history.popitem(last=False)
        return [(a, b, u) for (a, b), u in sorted(pairs.items(), key=lambda e: (-e[1], e[0]))[:k]]

    found = _chains(rules, n, chains, seed, walk, "a string, b string, uncertainty double", names=names, certainty=certainty, smooth=smooth, class_item=class_item)
    return found.groupBy("a", "b").agg(F.max("uncertainty").alias("uncertainty")).orderBy(F.col("uncertainty").desc(), "a", "b").limit(k)
