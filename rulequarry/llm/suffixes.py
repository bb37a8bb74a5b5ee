"""Repeated passages by suffix arrays of linear grouping construction.

Only text that can repeat reaches a suffix array.  Every window of ``LENGTH`` words holds an anchor: the least hash
of its ``SHINGLE``-word shingles.  Anchors that occur in one document only are dropped, which loses no repeated
window.  Around each of the others the words that any window with this anchor can reach form a segment; equal
segments of one anchor are kept once.  The segments of an anchor go to one shard, where a generalized suffix array
over their words is built by grouping (``suffix_array``): its runs of suffixes with a common prefix of ``LENGTH``
words are the repeated windows, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import U64, flat, mix64, pieces, powers, read, shared_dir, stored, words
from .jaccard import groups

LENGTH = 50
SHINGLE = 25
SHARD_WORDS = 250_000
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of whole numbers, 0 or more and below 2**32, whose last one is its unique least.

    The time is linear: the first grouping takes two counting passes, every pointer is set once and followed a bounded
    number of times on average, and the members of a group are taken in any order.

    First the suffixes are grouped by their first symbol.  Groups are processed in descending order: every suffix of
    the group gets its previous-smaller pointer (the last position before it that is in a lower group), and the
    suffixes pointed at leave their groups, those with more pointers further up, for new groups right behind the old
    ones.  In the end suffixes with one Lyndon prefix share a group.  Then one sweep emits the suffixes: the
    predecessor of each emitted one, and on along its pointers, takes the next place in its group.
    """
    n = len(text)
    symbol = np.asarray(text, np.int64)
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")  # a counting sort for 16-bit numbers
    order = order[np.argsort((symbol[order] >> 16).astype(np.uint16), kind="stable")]
    value = symbol[order]
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    size = np.zeros(n, np.int64)
    size[begin] = np.diff(np.r_[begin, n])
    group = np.zeros(n, np.int64)
    group[order] = np.repeat(begin, size[begin])
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    sa, size, group, at = order.tolist(), size.tolist(), group.tolist(), at.tolist()
    unset = -2
    prev = [unset] * n
    end = n - 1
    while end >= 0:
        g = group[sa[end]]
        if g == end:
            s = sa[end]
            j = s - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[s] = j
            if j >= 0:  # one suffix goes up behind its group
                old = group[j]
                m = size[old] - 1
                if m:
                    last = old + m
                    other, here = sa[last], at[j]
                    sa[here], at[other] = other, here
                    sa[last], at[j] = j, last
                    size[old], size[last], group[j] = m, 1, last
            end = g - 1
            continue
        count: dict[int, int] = {}
        for s in sa[g : end + 1]:
            path = [s] if prev[s] == unset else []
            while path:
                s = path[-1]
                j = s - 1
                while j >= 0 and group[j] >= g:
                    if prev[j] == unset:  # of this group, its turn comes later: it goes first
                        path.append(j)
                        break
                    j = prev[j]
                else:
                    prev[s] = j
                    path.pop()
                    if j >= 0:
                        count[j] = count.get(j, 0) + 1
        end = g - 1
        by_count: dict[int, list[int]] = {}
        for j, c in count.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[c]:
                moved.setdefault(group[j], []).append(j)
            for old, members in moved.items():
                m = size[old]
                if len(members) == m:
                    continue
                for j in members:
                    m -= 1
                    last = old + m
                    other, here = sa[last], at[j]
                    sa[here], at[other] = other, here
                    sa[last], at[j] = j, last
                size[old] = m
                new = old + m
                size[new] = len(members)
                for j in members:
                    group[j] = new
    out = [0] * n
    free = list(range(n))  # next place of the group that starts there
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return out


def repeated_windows(segment: list[np.ndarray], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, start, stop): merged stretches whose windows of ``length`` words occur in two documents at least.

    low and high: least and greatest document key of each segment's occurrences.
    """
    m = len(segment)
    size = np.array([len(s) for s in segment], np.int64)
    base = np.cumsum(size + 1) - size - 1
    _, rank = np.unique(np.concatenate(segment), return_inverse=True)
    text = np.zeros(int((size + 1).sum()), np.int64)
    where = np.arange(len(rank)) + np.repeat(np.arange(m), size)
    text[where] = rank + m
    text[base + size] = np.arange(m)[::-1]  # a terminator of its own for each segment, the last one the least
    sa = np.array(suffix_array(text.tolist()), np.int64)
    # neighbours share ``length`` words if and only if their windows are equal: compare window hashes, then words
    n = len(text)
    owner = np.repeat(np.arange(m), size + 1)
    room = base[owner] + size[owner] - np.arange(n)
    same = np.zeros(n, bool)  # same[i]: suffixes sa[i - 1] and sa[i] have a common prefix of ``length``
    i = np.flatnonzero((room[sa[1:]] >= length) & (room[sa[:-1]] >= length)) + 1
    for k in range(0, len(i), 200_000):
        part = i[k : k + 200_000]
        alike = np.ones(len(part), bool)
        for o in range(length):
            live = np.flatnonzero(alike)
            if not len(live):
                break
            alike[live] = text[sa[part[live]] + o] == text[sa[part[live] - 1] + o]
        same[part[alike]] = True
    start = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    least, most = np.minimum.reduceat(low[owner[sa]], start), np.maximum.reduceat(high[owner[sa]], start)
    hit = np.flatnonzero((least != most)[run] & (np.diff(np.r_[start, n]) > 1)[run])
    pos = np.sort(sa[hit])
    if not len(pos):
        return []
    new = np.r_[True, (pos[1:] - pos[:-1] > length) | (owner[pos[1:]] != owner[pos[:-1]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(pos)] - 1
    seg = owner[pos[first]]
    return list(zip(seg.tolist(), (pos[first] - base[seg]).tolist(), (pos[last] + length - base[seg]).tolist()))


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + width] for every i where it fits."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.full(len(h) + 1, _INVERSE, U64)
    scale[0] = 1
    scale = np.multiply.accumulate(scale)
    power = np.full(max(len(h), 1), _ODD, U64)
    power[0] = 1
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * np.multiply.accumulate(power)[: len(h)], out=total[1:])
    return total, scale


def anchors(h: np.ndarray, first: np.ndarray, length: int = LENGTH, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the shingles that are the least of some window of ``length`` words of one row.

    Equal least shingles of a window all count, so equal windows have equal anchors wherever they are.
    """
    none = np.zeros(0, np.int64), np.zeros(0, U64)
    m = len(h)
    span = length - shingle + 1  # shingles in a window
    if m < length:
        return none
    total, scale = _prefix(h)
    x = mix64((total[shingle:] - total[: m - shingle + 1]) * scale[: m - shingle + 1])
    least = _sliding(x, span, np.minimum)
    row_end = np.repeat(first[1:], np.diff(first))
    least[np.arange(len(least)) + length > row_end[: len(least)]] = 0
    padded = np.concatenate((np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)))
    pos = np.flatnonzero(_sliding(padded, span, np.maximum) == x)
    return pos, x[pos]


def repeated_passages(docs: DataFrame, *, length: int = LENGTH, shingle: int = SHINGLE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start_word, stop_word): what the ``length``-word windows of each document cover that occur in
    another document too; overlapping and touching windows make one stretch.  Words count from 0 and are separated by white space up to U+0020, case matters.

    Every occurrence is reported, the first one included.  Documents are told apart by (doc_id, text): rows that
    repeat both are one document, copies under other ids are several.  Null or empty texts and those of fewer than
    ``length`` words: no row; very long texts are searched whole.  Null id: reported with a null id.  Ties: among equal
    windows none is preferred, all are reported.  Empty table: empty result.  Columns other than ``doc_id`` and ``text``
    are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), text).alias("dk"), text.alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                h, _, _, first = words(*flat(batch.column(1)[a:b]))
                pos, value = anchors(h, first, length, shingle)
                row = np.searchsorted(first, pos, side="right") - 1
                if len(pos):
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(row + a)), pa.array((pos - first[row]).astype(np.int32))], names=["h", "dk", "p"])

    marks = stored(rows.select("dk", "text").mapInArrow(mark, "h bigint, dk bigint, p int"), folder, "anchors")
    shared = marks.groupBy("h").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi")).where("lo <> hi").select("h")
    spots = marks.join(shared, "h").groupBy("dk").agg(F.collect_set(F.struct("p", "h")).alias("spots"))
    suspects = stored(rows.join(spots, "dk").dropDuplicates(["dk"]), folder, "suspects")

    left = length - shingle

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                h, _, _, first = words(*flat(batch.column(1)[a:b]))
                total, scale = _prefix(h)
                spot = batch.column(2)[a:b]
                n = np.diff(spot.offsets.to_numpy()).astype(np.int64)
                inner = spot.flatten()
                p, value = inner.field("p").to_numpy().astype(np.int64), inner.field("h").to_numpy()
                row = np.repeat(np.arange(b - a), n)
                start = np.maximum(p - left, 0)
                stop = np.minimum(p + length, np.diff(first)[row])
                s, e = start + first[row], stop + first[row]
                sh = mix64((total[e] - total[s]) * scale[s] ^ mix64(((p - start) << 8 | (stop - start)).astype(U64)))
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(sh.view(np.int64)), batch.column(0).take(pa.array(row + a)), pa.array(start.astype(np.int32)), pa.array((stop - start).astype(np.int32))], names=["h", "sh", "dk", "s", "n"])

    segs = stored(suspects.select("dk", "text", "spots").mapInArrow(cut, "h bigint, sh bigint, dk bigint, s int, n int"), folder, "segments")
    kinds = segs.groupBy("h", "sh").agg(F.min(F.struct("dk", "s", "n")).alias("rep"), F.min("dk").alias("lo"), F.max("dk").alias("hi"))
    kinds = stored(kinds, folder, "kinds")
    # a segment that several documents share repeats as a whole
    whole = kinds.where("lo <> hi").where(F.col("rep.n") >= length).select("h", "sh", F.lit(0).alias("a"), F.col("rep.n").alias("b"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("lo").alias("l"), F.max("hi").alias("m")).where("k > 1 and l <> m").select("h")
    reps = stored(kinds.join(mixed, "h").select("h", "sh", "lo", "hi", F.col("rep.dk").alias("dk"), F.col("rep.s").alias("s"), F.col("rep.n").alias("n")), folder, "reps")
    amount = reps.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-amount // shard_words))
    wanted = reps.groupBy("dk").agg(F.collect_list(F.struct("h", "sh", "lo", "hi", "s", "n")).alias("want"))
    want = suspects.select("dk", "text").join(wanted, "dk").select("text", "want")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                h, _, _, first = words(*flat(batch.column(0)[a:b]))
                lists = batch.column(1)[a:b]
                inner = lists.flatten()
                row = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                s = inner.field("s").to_numpy() + first[row]
                n = inner.field("n").to_numpy()
                data = [h[i : i + k].tobytes() for i, k in zip(s.tolist(), n.tolist())]
                key = inner.field("h").to_numpy()
                shard = (key.view(U64) % U64(shards)).astype(np.int64)
                if len(data):
                    yield pa.RecordBatch.from_arrays([pa.array(shard), *(inner.field(c) for c in ("h", "sh", "lo", "hi")), pa.array(data, pa.binary())], names=["g", "h", "sh", "lo", "hi", "w"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            g = table.column("g").to_numpy()
            edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            h, sh, lo, hi = (table.column(c).to_numpy() for c in ("h", "sh", "lo", "hi"))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                parts = [np.frombuffer(x, U64) for x in table.column("w").slice(a, b - a).to_pylist()]
                found = repeated_windows(parts, lo[a:b], hi[a:b], length)
                if found:
                    seg, s, e = map(np.array, zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(h[a + seg]), pa.array(sh[a + seg]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["h", "sh", "a", "b"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    cuts = want.mapInArrow(take, "g bigint, h bigint, sh bigint, lo bigint, hi bigint, w binary").repartition(tasks, F.col("g")).sortWithinPartitions("g")
    partial = cuts.mapInArrow(build, "h bigint, sh bigint, a int, b int")
    spans = segs.join(whole.union(stored(partial, folder, "runs")), ["h", "sh"]).select("dk", (F.col("s") + F.col("a")).alias("start"), (F.col("s") + F.col("b")).alias("stop")).distinct()
    own = Window.partitionBy("dk").orderBy("start", "stop")
    seen = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0)).withColumn("island", F.sum("new").over(own))
    merged = spans.groupBy("dk", "island").agg(F.min("start").cast("bigint").alias("start_word"), F.max("stop").cast("bigint").alias("stop_word"))
    return merged.join(suspects.select("dk", "doc_id"), "dk").select("doc_id", "start_word", "stop_word")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def sql(length: int = LENGTH) -> str:
    return f"""
WITH docs AS (
  SELECT row_number() OVER () r, doc_id, list_filter(string_split_regex(text, '[\\x00-\\x20]+'), lambda x: x <> '') w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), starts AS (
  SELECT r, w, unnest(range(1, len(w) - {length} + 2)) i FROM docs WHERE len(w) >= {length}
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + {length - 1}], ' ')) m FROM starts
), shared AS (
  SELECT m FROM windows GROUP BY m HAVING min(r) <> max(r)
), hits AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) p FROM windows SEMI JOIN shared USING (m)
), islands AS (
  SELECT r, i, sum(CASE WHEN p IS NULL OR i - p > {length} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) k FROM hits
)
SELECT doc_id, (min(i) - 1)::BIGINT AS start_word, (max(i) - 1 + {length})::BIGINT AS stop_word
FROM islands JOIN docs USING (r) GROUP BY r, k, doc_id
"""
