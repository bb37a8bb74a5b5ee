"""Level-wise mining of classification rules.

A transaction's candidate antecedents grow by one item per level inside its own row, so that only counting moves data.
A level starts from the sets that the level before found often enough (anti-monotone pruning).  As long as these are
few enough to be sent to every worker (``MOST_SETS``), sets are numbers there: the place of the set without its last
item among the frequent ones, times the number of items, plus that item.  Beyond, they are arrays exchanged by their keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept
from . import transactions as tx_

KEY = ";"
MOST_SETS = 2_000_000  # frequent sets of one level that are sent to every worker
MOST_CLASSES = 64  # classes that are counted side by side
CELLS = 1 << 24  # counts that a worker holds in a table; more sets are sorted
CHUNK = 1 << 21  # candidate sets that a worker holds at a time
PART_LEAST, PART_ROWS, MOST_ROWS = 100, 200_000, 1_000_000  # pattern growth: a part's least count and usual rows, and its greatest


def _counted(grown: DataFrame, least: int) -> DataFrame:
    """(x, y, c) for y over the classes and null (any): one aggregation gives fx and fz."""
    each = grown.select("x", F.explode(F.concat("classes", F.array(F.lit(None).cast("string")))).alias("y"))
    return each.groupBy("x", "y").agg(F.count("*").alias("c")).where(F.col("c") >= least)


def _split(tx: DataFrame, class_item: Column | None) -> DataFrame:
    """(tid, items, classes): the two kinds of items of each transaction, in order."""
    if class_item is None and "items" in tx.columns:
        return tx.select("tid", F.filter("items", lambda i: ~tx_.is_class(i)).alias("items"), F.filter("items", lambda i: tx_.is_class(i)).alias("classes"))
    own = tx_.is_class() if class_item is None else class_item
    return tx_.long(tx).groupBy("tid").agg(F.array_sort(F.collect_set(F.when(~own, F.col("item")))).alias("items"), F.collect_set(F.when(own, F.col("item"))).alias("classes"))


def levels(split: DataFrame, *, most: int | None, least: int) -> list[DataFrame]:
    """One DataFrame (x ARRAY, y, c) per antecedent size, of transactions (items, classes)."""
    grown = split.select("items", "classes", F.array().cast("array<string>").alias("x"), F.lit(0).alias("at"))
    out: list[DataFrame] = []
    while most is None or len(out) < most:
        step = grown.where(F.size("items") > F.col("at")).select("items", "classes", "x", F.explode(F.sequence(F.col("at"), F.size("items") - 1)).alias("i"))
        grown = step.select("items", "classes", F.concat("x", F.array(F.expr("items[i]"))).alias("x"), (F.col("i") + 1).alias("at"))
        counts = _counted(grown, least)
        if most is None:
            counts = counts.persist()
            if not counts.limit(1).count():
                break
        out.append(counts)
        if most is None or len(out) < most:
            # sets that are too rare can't become frequent again; the frequent ones are few or are exchanged by their keys
            grown = grown.join(counts.where("y is null").select("x"), "x", "left_semi")
    return out


def _singles(split: DataFrame) -> DataFrame:
    """(x, y, c): transactions with item x and class y; x or y is null for any."""
    any_ = F.array(F.lit(None).cast("string"))
    each = split.select(F.explode(F.concat("items", any_)).alias("x"), "classes").select("x", F.explode(F.concat("classes", any_)).alias("y"))
    return each.where("x is not null or y is not null").groupBy("x", "y").agg(F.count("*").alias("c"))


def _grow(known: list[str], classes: list[str], frequent: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker that counts the sets of one item more than the last of ``frequent`` (numbers in order, by size from 2 on).

    It takes (items, classes) and returns (code, c0, c1 ...): a set's number, its transactions, and those of each class.
    """
    many, kinds, size = len(known), len(classes) + 1, len(frequent) + 2
    cells = (len(frequent[-1]) if frequent else many) * many * kinds
    columns = ["code", *(f"c{i}" for i in range(kinds))]

    def candidates(item: np.ndarray, stop: np.ndarray, at: np.ndarray, sets: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, places of their last items) of sets grown from ``sets``, which end at the places ``at``; about a chunk at a time."""
        left = stop[at] - at - 1
        upto, begin = np.cumsum(left), 0
        while begin < len(at):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, side="right")))
            part = left[begin:end]
            of = np.repeat(np.arange(begin, end), part)
            last = at[of] + 1 + np.arange(len(of)) - np.repeat(upto[begin:end] - part - done, part)
            code = sets[of] * many + item[last]
            begin = end
            if level == size:
                yield code, last
                continue
            own = frequent[level - 2]
            found = np.minimum(np.searchsorted(own, code), max(0, len(own) - 1))
            ok = own[found] == code if len(own) else np.zeros(len(code), bool)
            yield from candidates(item, stop, last[ok], found[ok], level + 1)

    def rows(code: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(code), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 18)]), *(pa.array(counts[i : i + (1 << 18), j]) for j in range(kinds))], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, names_of_class = pa.array(known, pa.string()), pa.array(classes, pa.string())
        table = np.zeros(cells, np.int64) if cells <= CELLS else None
        keys: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(keys)
            keys.clear()
            if table is not None:
                np.add(table, np.bincount(every, minlength=cells), out=table)
                return
            every, n = np.unique(every, return_counts=True)
            code, at = np.unique(every // kinds, return_inverse=True)
            counts = np.zeros((len(code), kinds), np.int64)
            counts[at, every % kinds] = n
            yield from rows(code, counts)

        for batch in batches:
            row, item = tx_.ids_of(batch.column(0), names)
            of, kind = tx_.ids_of(batch.column(1), names_of_class)
            many_of = np.bincount(of, minlength=batch.num_rows)
            first = np.cumsum(many_of) - many_of
            stop = np.cumsum(np.bincount(row, minlength=batch.num_rows))[row]
            for code, last in candidates(item, stop, np.arange(len(item)), item, 2):
                keys.append(code * kinds)
                of_row = row[last]
                for turn in range(int(many_of.max(initial=0))):
                    has = many_of[of_row] > turn
                    keys.append(code[has] * kinds + kind[first[of_row[has]] + turn] + 1)
                if sum(map(len, keys)) >= CHUNK:
                    yield from counted()
        if keys:
            yield from counted()
        if table is not None:
            counts = table.reshape(-1, kinds)
            code = np.flatnonzero(counts[:, 0])
            yield from rows(code, counts[code])

    return run


def _told(known: list[str], before: list[str], classes: list[str], fy: np.ndarray, least: int, confidence: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker that turns counted numbers into rules (x, y, size, fx, fy, fz); ``before``: the frequent sets of one item less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, heads = pa.array(known, pa.string()), pa.array(before, pa.string())
        for batch in batches:
            code, fx = (batch.column(i).to_numpy() for i in (0, 1))
            for i, y in enumerate(classes):
                fz = batch.column(i + 2).to_numpy()
                ok = np.flatnonzero((fz >= least) & (fz * 100.0 >= fx * confidence))
                x = pc.binary_join_element_wise(heads.take(pa.array(code[ok] // len(known))), names.take(pa.array(code[ok] % len(known))), KEY)
                yield pa.RecordBatch.from_arrays([x, pa.array([y] * len(ok), pa.string()), pa.array(np.full(len(ok), size, np.int32)), pa.array(fx[ok]), pa.array(np.full(len(ok), fy[i])), pa.array(fz[ok])], names=["x", "y", "size", "fx", "fy", "fz"])

    return run


def mine(tx: DataFrame, class_item: Column | None = None, *, least: int = 1, confidence: float = 0.0, most: int | None = 3, n: int | None = None, rows: int | None = None) -> DataFrame:
    """All rules X => y with one class item y: (rule_id, x, y, size, fx, fy, fz).

    ``least``: least fx, fy and fz; ``confidence``: least percentage 100 fz / fx; ``most``: greatest antecedent size
    (None: until no set is left); ``rows``: keep so many by rule id.  x is the sorted items joined by ``;``.  From size 2
    on levels are counted one after the other, each by a pass over the stored transactions.
    """
    split = _split(tx, class_item).select("items", "classes")
    if most == 1:
        singles = _singles(split)
    else:
        split = kept(split)
        singles = kept(_singles(split).where(F.col("c") >= least))
    whole = F.max(F.when(F.col("y").isNull(), F.col("c"))).over(Window.partitionBy("x"))
    of_class = F.max(F.when(F.col("x").isNull(), F.col("c"))).over(Window.partitionBy("y"))
    found = singles.select("x", "y", F.lit(1).alias("size"), whole.alias("fx"), of_class.alias("fy"), F.col("c").alias("fz")).where("x is not null and y is not null")
    out = found.where((F.col("fz") >= least) & (F.col("fz") * 100.0 >= F.col("fx") * float(confidence)))
    if most is None or most > 1:
        for more in _larger(split, singles, least, float(confidence), most):
            out = out.union(more)
    out = out.select(F.concat("x", F.lit("=>"), "y").alias("rule_id"), "*")
    return out if rows is None else out.orderBy("rule_id").limit(rows)


def _larger(split: DataFrame, singles: DataFrame, least: int, confidence: float, most: int | None) -> Iterator[DataFrame]:
    """Rules (x, y, size, fx, fy, fz) by size from 2 on."""
    size, frequent = 2, []
    of_item, of_class = singles.where("y is null"), singles.where("x is null")
    if of_item.count() <= MOST_SETS and of_class.count() <= MOST_CLASSES:
        known = sorted(r.x for r in of_item.select("x").collect())  # bounded by MOST_SETS
        classes = sorted((r.y, r.c) for r in of_class.collect())  # bounded by MOST_CLASSES
        names, fy, before = [y for y, _ in classes], np.array([c for _, c in classes], np.int64), known
        sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names) + 1)]
        while most is None or size <= most:
            counts = split.mapInArrow(_grow(known, names, frequent), "code bigint" + "".join(f", c{i} bigint" for i in range(len(names) + 1)))
            counts = kept(counts.groupBy("code").agg(*sums).where(F.col("c0") >= least))
            amount = counts.count()
            if not amount:
                return
            yield counts.mapInArrow(_told(known, before, names, fy, least, confidence, size), "x string, y string, size int, fx bigint, fy bigint, fz bigint")
            size += 1
            if amount > MOST_SETS:
                break
            if most is None or size <= most:
                frequent = [*frequent, np.sort(counts.select("code").toArrow().column("code").to_numpy())]  # bounded by MOST_SETS
                before = [f"{before[c // len(known)]}{KEY}{known[c % len(known)]}" for c in frequent[-1].tolist()]
        else:
            return
    for at, counts in enumerate(levels(split, most=most, least=least), 1):
        if at >= size:
            whole = counts.where("y is null").select("x", F.col("c").alias("fx"))
            part = counts.where("y is not null").select("x", "y", F.col("c").alias("fz"))
            rules = part.join(whole, "x").where(F.col("fz") * 100.0 >= F.col("fx") * confidence).join(singles.where("x is null").select("y", F.col("c").alias("fy")), "y")
            yield rules.select(F.array_join("x", KEY).alias("x"), "y", F.lit(at).alias("size"), "fx", "fy", "fz")


def one_item_rules(tx: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """The rules with one antecedent item, and n, the number of transactions: (rule_id, x, y, fx, fy, fz, n)."""
    total = (tx.select("tid").distinct().agg(F.count("*").alias("n"))) if n is None else n
    return mine(tx, most=1).drop("size").crossJoin(F.broadcast(total))  # one row


def frequent_sets(tx: DataFrame, support: float) -> DataFrame:
    """Frequent item sets of any size by FP-growth: (items, freq)."""
    from pyspark.ml.fpm import FPGrowth

    return FPGrowth(itemsCol="items", minSupport=support).fit(tx_.baskets(tx).select("items")).freqItemsets


def growth_rules(tx: DataFrame, support: float, confidence: float, prefix: str = tx_.CLASS_PREFIX) -> DataFrame:
    """Class rules of any antecedent size by pattern growth: (x, y, confidence, support).

    Every part of the transactions grows its own patterns over bits, depth first, as often as its share asks for; what
    is frequent in all is so in a part at least.  One more pass counts these candidates everywhere.
    """
    from ..sources.files import with_frequencies

    held = kept(tx_.baskets(tx))
    n = held.count()
    least = math.ceil(support * n)
    parts = max(1, min(least // PART_LEAST, -(-n // PART_ROWS)))
    found = held.select("items").repartition(max(parts, -(-n // MOST_ROWS))).mapInArrow(_patterns(least, n, prefix), "x string, y string").distinct()
    out = with_frequencies(found, held).where((F.col("fz") >= least) & (F.col("fz") / F.col("fx") >= float(confidence)))
    return out.select("x", "y", (F.col("fz") / F.col("fx")).alias("confidence"), (F.col("fz") / F.lit(n)).alias("support"))


def _patterns(least: int, n: int, prefix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker that grows the class rules (x, y) of its transactions which ``least`` of ``n`` would ask of so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [batch.column(0) for batch in batches if batch.num_rows]
        if not lists:
            return
        rows = sum(map(len, lists))
        names = sorted(set().union(*(x.flatten().unique().to_pylist() for x in lists)) - {None})
        known = pa.array(names, pa.string())
        spots = [tx_.ids_of(x, known) for x in lists]
        start = np.cumsum([0, *map(len, lists)])
        row, item = np.concatenate([r + s for (r, _), s in zip(spots, start)]), np.concatenate([i for _, i in spots])
        del lists, spots
        need = max(1, -(-least * rows // n))
        often = np.bincount(item, minlength=len(names)) >= need
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        edge = np.searchsorted(item, np.arange(len(names) + 1))
        covers = {}
        for i in np.flatnonzero(often).tolist():
            bits = np.zeros(-(-rows // 64) * 64, bool)
            bits[row[edge[i] : edge[i + 1]]] = True
            covers[i] = np.packbits(bits, bitorder="little").view(np.uint64)
        classes = [i for i in covers if names[i].startswith(prefix)]
        sides = [i for i in covers if not names[i].startswith(prefix)]
        out: list[tuple[str, str]] = []

        def grow(x: tuple[int, ...], cover: np.ndarray | None, rest: list[int]) -> None:
            held = []
            for i in rest:
                wider = covers[i] if cover is None else cover & covers[i]
                own = [y for y in classes if int(np.bitwise_count(wider & covers[y]).sum()) >= need] if int(np.bitwise_count(wider).sum()) >= need else []
                if own:
                    held.append((i, wider))
                    out.extend((KEY.join(names[j] for j in (*x, i)), names[y]) for y in own)
            for k, (i, wider) in enumerate(held):
                grow((*x, i), wider, [j for j, _ in held[k + 1 :]])

        grow((), None, sides)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["x", "y"])

    return run
