"""Transactions as (tid, item) rows: views, covers, frequencies, components.

The long form is what all counting works on; ``baskets`` turns it into one row per transaction with a single
exchange, after which sets of items are formed without moving any row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASS_PREFIX = "status="
TASK_BYTES = 16 << 20  # bytes of files behind a task that groups transactions
MOST_SETS = 100_000  # item sets that are sent to every worker
MOST_BITS = 1 << 24  # items times transactions that a worker compares at a time


def order_baskets(spark: SparkSession, sf_dir: str, block: Column | None = None) -> DataFrame:
    """The driver's tables as transactions (tid, items): an order is a row of brands, types, priority, segment and status.

    Lines and orders meet in one exchange by ``tid``, in as many tasks as the files are large, whatever the session's
    number; orders of one ``block`` (an expression over ``tid``, carried as a column) go to one task.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tag = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c))
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), tag("brand", "p_brand").alias("brand"), tag("type", "p_type").alias("type"))
    line = t("lineitem").select(F.col("l_orderkey").alias("tid"), "l_partkey").where("tid is not null")
    seg = t("customer").select(F.col("c_custkey").alias("o_custkey"), tag("seg", "c_mktsegment").alias("seg"))
    orders = t("orders").select(F.col("o_orderkey").alias("tid"), tag("prio", "o_orderpriority").alias("prio"), tag("status", "o_orderstatus").alias("status"), "o_custkey")
    of_line = line.join(part, "l_partkey").select("tid", F.array("brand", "type").alias("some"), F.lit(False).alias("own"))
    rows = of_line.union(orders.join(seg, "o_custkey", "left").select("tid", F.array("prio", "status", "seg"), F.lit(True)))
    keys = ["tid"]
    if block is not None:
        rows, keys = rows.withColumn("block", block), ["block", "tid"]
    rows = rows.repartition(tasks(spark, t("lineitem"), t("orders")), keys[0])
    held = rows.groupBy(*keys).agg(F.collect_list("some").alias("all"), F.max("own").alias("own")).where("own")  # a line needs its order
    return held.select(*keys, F.array_sort(F.array_distinct(F.array_compact(F.flatten("all")))).alias("items")).where("size(items) > 0")


def tasks(spark: SparkSession, *tables: DataFrame, each: int | None = None) -> int:
    """How many tasks to share files out to: some MB each, so that a task's memory stays as it is when the files grow."""
    size = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (each or TASK_BYTES)))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions as rows (tid, item)."""
    return long(order_baskets(spark, sf_dir))


def event_items(spark: SparkSession, sf_dir: str, least: float = 100.0) -> DataFrame:
    """Events as transactions: a user's day is a row of event types and of its spending class."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("tid"), "event_type", "value")
    spend = events.groupBy("tid").agg(F.round(F.sum("value"), 6).alias("s")).select("tid", F.when(F.col("s") >= least, "spend=hi").otherwise("spend=lo").alias("item"))
    return events.select("tid", F.concat(F.lit("event="), "event_type").alias("item")).union(spend).where("item is not null").distinct()


def from_arrays(df: DataFrame, items: str = "items", tid: str = "tid") -> DataFrame:
    """(tid, item) from rows of item arrays; repeated items of a row count once."""
    return df.select(F.col(tid).alias("tid"), F.explode(F.array_distinct(items)).alias("item"))


def is_class(item: Column | str = "item", prefix: str = CLASS_PREFIX) -> Column:
    c = F.col(item) if isinstance(item, str) else item
    return c.startswith(prefix)


def antecedent_items(tx: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct items that are not among ``classes`` (column item)."""
    return tx.select("item").distinct().join(classes.select("item"), "item", "left_anti")


def item_frequency(tx: DataFrame) -> DataFrame:
    """(item, f): in how many transactions each item is; the rows must be distinct."""
    return tx.groupBy("item").agg(F.count("*").alias("f"))


def baskets(tx: DataFrame) -> DataFrame:
    """(tid, items): each transaction's items in order; such rows are taken as they are."""
    if "items" in tx.columns:
        return tx.select("tid", "items")
    return tx.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))


def long(tx: DataFrame) -> DataFrame:
    """(tid, item) of either form of transactions."""
    return tx.select("tid", F.explode("items").alias("item")) if "items" in tx.columns else tx


def contains_all(items: Column | str, wanted: Sequence[str] | Column) -> Column:
    """Whether an item array holds all of ``wanted``."""
    c = F.col(items) if isinstance(items, str) else items
    w = wanted if isinstance(wanted, Column) else F.array(*map(F.lit, wanted)).cast("array<string>")
    return F.size(F.array_except(w, c)) == 0


def itemset_covers(sets: DataFrame, tx: DataFrame) -> DataFrame:
    """Cover rows (set_id, tid) of item sets (set_id, items): the transactions that hold every item of a set.

    Up to ``MOST_SETS`` sets are sent to the workers, where transactions pass by them without an exchange.  Of more, a
    set meets the baskets that hold its rarest item, and only these are looked through: an item that most
    transactions have costs nothing where a rarer one stands beside it.
    """
    held = baskets(tx)
    few = _few(sets)
    if few is not None:
        tid = held.schema["tid"].dataType.simpleString()
        return held.mapInArrow(_matches(few, False), f"set_id {sets.schema['set_id'].dataType.simpleString()}, tid {tid}")
    known = sets.select("set_id", F.array_distinct("items").alias("wanted"))
    frequency = held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("f"))
    rarest = known.select("set_id", "wanted", F.explode("wanted").alias("item")).join(frequency, "item", "left")
    rarest = rarest.groupBy("set_id", "wanted").agg(F.min_by("item", F.struct(F.coalesce("f", F.lit(0)), "item")).alias("item"))
    near = held.select("tid", "items", F.explode("items").alias("item")).join(rarest, "item")
    return near.where(F.size(F.array_except("wanted", "items")) == 0).select("set_id", "tid")


def cover_sizes(sets: DataFrame, tx: DataFrame) -> DataFrame:
    """(set_id, f) with 0 for a set that no transaction holds, or that has an unknown item."""
    few = _few(sets)
    if few is not None:
        name = sets.schema["set_id"].dataType.simpleString()
        f = baskets(tx).mapInArrow(_matches(few, True), f"set_id {name}, f bigint").groupBy("set_id").agg(F.sum("f").alias("f"))
    else:
        f = itemset_covers(sets, tx).groupBy("set_id").agg(F.count("*").alias("f"))
    return sets.select("set_id").join(f, "set_id", "left").select("set_id", F.coalesce("f", F.lit(0)).alias("f"))


def _few(sets: DataFrame) -> tuple[pa.Array, list[tuple[str, ...]]] | None:
    """(set_ids, items) of distinct sets that hold something, or None if there are more than ``MOST_SETS``."""
    head = sets.select("set_id", "items").limit(MOST_SETS + 1).toArrow()
    if len(head) > MOST_SETS:
        return None
    ids = pa.concat_arrays(head.column("set_id").chunks) if len(head) else pa.array([], head.schema.field("set_id").type)
    found: dict[tuple, int] = {}
    for at, (key, items) in enumerate(zip(ids.to_pylist(), head.column("items").to_pylist())):
        if items and None not in items:
            found.setdefault((key, tuple(dict.fromkeys(items))), at)
    return ids.take(pa.array(list(found.values()), pa.int64())), [items for _, items in found]


def _matches(few: tuple[pa.Array, list[tuple[str, ...]]], counts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker that ANDs the items' bits over a few thousand transactions (tid, items) at a time: how many hold a set, or which."""
    ids, sets = few
    names = sorted({i for s in sets for i in s})
    at = {name: i for i, name in enumerate(names)}
    sizes: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        sizes.setdefault(len(s), []).append(k)
    alike = [(np.array(own), np.array([[at[i] for i in sets[k]] for k in own])) for own in sizes.values()]
    rows = max(64, min(8192, MOST_BITS // max(1, len(names), len(sets)) // 64 * 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sets), np.int64)
        known = pa.array(names, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                row, item = ids_of(part.column(1), known)
                bits = np.zeros((len(names), -(-part.num_rows // 64) * 64), bool)
                bits[item, row] = True
                bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
                for own, items in alike:
                    hit = bits[items[:, 0]]
                    for i in range(1, items.shape[1]):
                        hit &= bits[items[:, i]]
                    if counts:
                        total[own] += np.bitwise_count(hit).sum(1, dtype=np.int64)
                    else:
                        k, t = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[k])), part.column(0).take(pa.array(t))], names=["set_id", "tid"])
        if counts:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(total[some])], names=["set_id", "f"])

    return run


def ids_of(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``known``) of all items of a column of lists that are known, in order."""
    item = pc.index_in(lists.flatten(), value_set=known)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    keep = item.is_valid().to_numpy(zero_copy_only=False)
    return row[keep], item.drop_null().to_numpy().astype(np.int64)


def extend_cover(cover: DataFrame, tx: DataFrame, item: str) -> DataFrame:
    """The cover (set_id, tid) after one more item has joined every set."""
    return cover.join(tx.where(F.col("item") == item).select("tid"), "tid", "left_semi").select("set_id", "tid")


def packed_covers(tx: DataFrame, position: str = "pos") -> DataFrame:
    """Bitmaps of item covers: (item, bucket, bits) over integer row positions ``pos``.

    Rows that come with their ``bucket``, together in one task, stay there.
    """
    if "bucket" not in tx.columns:
        tx = tx.withColumn("bucket", F.bitmap_bucket_number(position))
    return tx.groupBy("item", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(position))).alias("bits"))


def packed_itemset_sizes(sets: DataFrame, packed: DataFrame) -> DataFrame:
    """(set_id, f) by AND over packed covers: partial and final aggregation take the place of a tree of pairs."""
    long = sets.select("set_id", F.size(F.array_distinct("items")).alias("k"), F.explode(F.array_distinct("items")).alias("item"))
    both = long.join(packed, "item").groupBy("set_id", "bucket", "k").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("c"))
    f = both.where("c = k").groupBy("set_id").agg(F.sum(F.bitmap_count("bits")).alias("f"))
    return sets.select("set_id").join(f, "set_id", "left").select("set_id", F.coalesce("f", F.lit(0)).cast("bigint").alias("f"))


def item_components(tx: DataFrame, rounds: int = 100) -> DataFrame:
    """(item, component): items are connected if a transaction holds both; a component is named by its least item.

    One pass over the transactions turns each into links of its least item with all others.  Labels spread over the
    distinct links, and each item also takes the label of its own label, so that long chains halve in every round.
    Few items are left after each round; they alone are kept.
    """
    spark = tx.sparkSession
    held = baskets(tx)
    one = held.select(F.col("items")[0].alias("a"), F.explode("items").alias("b")).distinct()
    link = _cut(spark, one.union(one.select("b", "a")).distinct())
    label = link.groupBy(F.col("a").alias("item")).agg(F.min("b").alias("component"))
    for _ in range(rounds):
        label = _cut(spark, label)
        new = link.join(label, F.col("b") == F.col("item")).groupBy(F.col("a").alias("item")).agg(F.min("component").alias("component"))
        jump = new.toDF("component", "next")
        new = _cut(spark, new.join(jump, "component", "left").select("item", F.coalesce(F.least("component", "next"), "component").alias("component")))
        changed = new.join(label, ["item", "component"], "left_anti").limit(1).count()
        label = new
        if not changed:
            break
    return label


def _cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint; the folder is the session's, or a temporary one in a single process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="rulequarry-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def with_positions(tx: DataFrame) -> DataFrame:
    """Adds ``pos``, the transaction's rank by tid: what bitmaps index."""
    rank = tx.select("tid").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("tid")) - 1).cast("bigint"))
    return tx.join(rank, "tid")
