"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word n-grams.  Documents with equal sets form a class, and only classes are joined.  A
class is summed up by ``BINS`` sampled tokens (the least hash in each of ``BINS`` parts of the hash range).  In each
of ``runs`` independent runs, a class goes to the nodes of ``fan`` sampled coordinates; a node holds the classes that
share the sampled token.  Nodes of at most ``SMALL`` classes compare all their sketches.  Larger ones split again, on
``WIDER`` times as many coordinates of their own, until they are small; only a node whose classes are so alike that
splitting doesn't pay (``candidate_pairs``) is compared at once, in blocks, at a cost in proportion to the pairs in it.
Pairs whose sketches come near the threshold are verified on the full sets.  ``plan`` sets ``runs`` and what near means
for the recall that is asked for, even of a pair whose nodes are split ``DEPTH`` times.

Many different texts that are all alike (a crowd) have quadratically many pairs.  These are never spelled out on the
way: a crowd is named by a star of edges, and all its pairs are verified at once by products of token matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import PIECE, U64, components, flat, key_filter, mix64, pieces, read, shared_dir, stored, text_key, words

N, THRESHOLD, RECALL = 3, 0.5, 0.999
BINS, SMALL, DEPTH, BLOCK = 64, 256, 12, 2000
CROWD, CROWDED = 64, 1 / 8  # members that a crowd has at least, share of its pairs whose sketches are near
WIDER = 2  # below the first level a path that is lost is lost for all its parts, so more of them are tried


def found_at(p: float, fan: int, runs: int) -> float:
    """Chance that a pair whose sketches agree in a share ``p`` of their bins is compared, if all its nodes are large.

    Below the first level a pair has more than one common child on average, so the chance hardly falls with the depth.
    """
    s = 1.0
    for _ in range(DEPTH - 1):
        s = 1 - (1 - p * s) ** (WIDER * fan)
    return 1 - (1 - p * s) ** (fan * runs)


def plan(threshold: float, recall: float) -> tuple[int, int, float]:
    """(fan, runs, near) that find a pair right at the threshold with probability ``recall``.

    The number of agreeing bins of long sets is binomial; that of short ones varies less, as their tokens run out.  A
    quarter of the loss goes to sketches that agree in a share of less than ``near``, the rest to pairs that never meet.
    """
    fan = math.ceil(1 / threshold)
    share = [math.comb(BINS, k) * threshold**k * (1 - threshold) ** (BINS - k) for k in range(BINS + 1)]
    least = max(k for k in range(BINS + 1) if sum(share[:k]) <= (1 - recall) / 4)
    runs = 1
    while sum(share[k] * found_at(k / BINS, fan, runs) for k in range(least, BINS + 1)) < recall:
        runs += 1
    return fan, runs, least / BINS


def shingles(raw: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of each row: their 52-bit hashes in order, and n + 1 offsets.

    At most 4,000 rows.  A row of fewer words than n is one token, its whole word sequence; one of no words is empty.
    """
    h, _, _, first = words(raw, at)
    rows = len(at) - 1
    count = np.diff(first)
    m = len(h)
    gram = np.zeros(m, U64)
    for k in range(n):
        gram[: m - k] += mix64(h[k:] + U64(k + 1)) * U64(2 * k + 3)
    row = np.repeat(np.arange(rows), count)
    good = np.arange(m) + n <= first[row + 1] if m else np.zeros(0, bool)
    for r in np.flatnonzero((count > 0) & (count < n)):
        a = first[r]
        gram[a] = U64(0)
        for k in range(count[r]):
            gram[a : a + 1] += mix64(h[a + k : a + k + 1] + U64(k + 1)) * U64(2 * k + 3)
        good[a] = True
    key = np.unique((row[good].astype(U64) << U64(52)) | (mix64(gram[good]) >> U64(12)))
    owner = (key >> U64(52)).astype(np.int64)
    return key & U64((1 << 52) - 1), np.searchsorted(owner, np.arange(rows + 1))


def sketches(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, BINS) of the least token in each bin, 0 for an empty bin."""
    rows = len(at) - 1
    out = np.zeros((rows, BINS), np.uint32)
    v = mix64(token)
    row = np.repeat(np.arange(rows, dtype=U64), np.diff(at))
    key = np.sort(row << U64(38) | (v & U64(BINS - 1)) << U64(32) | np.maximum(v >> U64(32), U64(1)))
    top = key >> U64(32)
    new = np.r_[True, top[1:] != top[:-1]] if len(key) else np.zeros(0, bool)
    spot = top[new].astype(np.int64)
    out[spot >> 6, spot & 63] = (key[new] & U64(0xFFFFFFFF)).astype(np.uint32)
    return out


def children(node: np.ndarray, sk: np.ndarray, fan: int) -> np.ndarray:
    """(rows, fan) child nodes: each node samples ``fan`` coordinates, and a row's tokens there name its children.

    A coordinate is the first filled bin of a random sequence of bins that the node sets.  Two rows so get the same child
    with just the probability with which a bin that either fills agrees, and independently for each coordinate,
    however few their tokens are.
    """
    out = np.zeros((len(node), fan), np.int64)
    filled = np.flatnonzero(sk.any(1))
    for f in range(fan):
        draw = mix64(node.astype(np.int64).view(U64) + U64(0x1234567 * (f + 1)))
        token = np.zeros(len(node), np.uint32)
        left, k = filled, 0
        while len(left):
            token[left] = sk[left, (mix64(draw[left] + U64(k)) & U64(BINS - 1)).astype(np.int64)]
            left, k = left[token[left] == 0], k + 1
        out[:, f] = mix64(draw ^ mix64(token.astype(U64))).view(np.int64)
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, row by row."""
    used = ((a != 0) | (b != 0)).sum(1)
    return ((a == b) & (a != 0)).sum(1) / np.maximum(used, 1)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that come ordered by ``key``, several small groups at a time."""
    left: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if left and left[-1].column(key)[-1].as_py() == keys[0] and cut == 0:
            left.append(table)
            continue
        head = np.searchsorted(keys, left[-1].column(key)[-1].as_py(), side="right") if left else 0
        if left:
            yield pa.concat_tables(left + [table.slice(0, int(head))]).combine_chunks()
        if cut > head:
            yield table.slice(int(head), cut - int(head)).combine_chunks()
        left = [table.slice(max(cut, int(head)))] if max(cut, int(head)) < len(keys) else []
    if left:
        yield pa.concat_tables(left).combine_chunks()


def _pairs_of(size: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j inside consecutive groups of the given sizes, about ``most`` at a time."""
    start = np.cumsum(size) - size
    first = np.arange(int(size.sum()))
    after = np.repeat(start + size, size) - first - 1  # partners behind each element
    done = 0
    total = np.cumsum(after)
    while done < len(first):
        base = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, base + most, side="right")))
        n = after[done:stop]
        i = np.repeat(first[done:stop], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        done = stop


def forest(i: np.ndarray, j: np.ndarray, parent: dict[int, int]) -> np.ndarray:
    """Which of the edges i-j join two parts that none before them joined; ``parent`` is carried on."""
    out = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        while (p := parent.get(a, a)) != a:
            parent[a] = a = parent.get(p, p)
        while (p := parent.get(b, b)) != b:
            parent[b] = b = parent.get(p, p)
        if a != b:
            parent[a] = b
            out[k] = True
    return out


def _struct(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([a, b], names=["a", "b"])


PRINT = "struct<a:bigint,b:bigint>"  # 128-bit fingerprint of a set


def class_table(docs: DataFrame, folder: str, *, n: int, fan: int, runs: int) -> DataFrame:
    """One row per distinct n-gram set: class, the least (doc_id, text key) as its witness, rows, size, sketch, first nodes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(1, runs + 1, dtype=U64) * U64(0xABCDEF)).view(np.int64)
        for batch in batches:
            for a, b in pieces(batch.column(2), PIECE):
                raw, at = flat(batch.column(2)[a:b].cast(pa.string()))
                token, offset = shingles(raw, at, n)
                size = np.diff(offset)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                edge = offset[some]
                fp = [np.add.reduceat(mix64(token + U64(salt)), edge).view(np.int64) for salt in (1 << 60, 1 << 61)]
                sk = sketches(token, offset)[some]
                node = np.concatenate([children(np.full(len(some), r), sk, fan) for r in roots], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * node.shape[1], pa.int32()), pa.array(node.ravel()))
                take = pa.array(some + a)
                yield pa.RecordBatch.from_arrays([_struct(pa.array(fp[0]), pa.array(fp[1])), batch.column(0).take(take), batch.column(1).take(take), pa.array(size[some]), pa.array([x.tobytes() for x in sk], pa.binary()), lists], names=["fp", "doc_id", "th", "n", "sk", "nodes"])

    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("th"), text.alias("text"))
    made = rows.mapInArrow(sketch, f"fp {PRINT}, doc_id bigint, th bigint, n bigint, sk binary, nodes array<bigint>")
    made = made.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.collect_list(F.struct("doc_id", "th")).alias("members"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.first("nodes").alias("nodes"))
    # short numbers, fixed once they are written, travel lighter than fingerprints
    return stored(made.withColumn("c", F.monotonically_increasing_id()), folder, "classes")


def parts(linked: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Connected components of n rows, numbered from 0; ``linked`` tells which of some rows a row is linked with.

    A row is held against those alone that no component has yet, so that rows which are all alike cost one pass.
    """
    label, left, count = np.full(n, -1), np.arange(n), 0
    while len(left):
        queue, left = [int(left[0])], left[1:]
        label[queue[0]] = count
        while queue and len(left):
            hit = linked(queue.pop(), left)
            label[left[hit]] = count
            queue += left[hit].tolist()
            left = left[~hit] if hit.any() else left
        count += 1
    return label


def crowds(sk: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Component of each sketch, and of each component whether it is a crowd (by the links of 64 of its members)."""
    full, held = sk != 0, [None, None, None]

    def linked(row: int, left: np.ndarray) -> np.ndarray:
        if held[0] is not left:
            held[:] = left, sk[left], full[left]
        same = ((held[1] == sk[row]) & full[row]).sum(1)
        return same >= near * (held[2] | full[row]).sum(1)

    label = parts(linked, len(sk))
    order = np.argsort(label, kind="stable")
    size = np.bincount(label)
    dense = np.zeros(len(size), bool)
    for c in np.flatnonzero(size >= CROWD):
        rows = order[size[:c].sum() :][: size[c]]
        some = rows[np.linspace(0, len(rows) - 1, min(64, len(rows))).astype(int)]
        dense[c] = np.mean([linked(r, rows).sum() - 1 for r in some]) >= CROWDED * (len(rows) - 1)
    return label, dense


def _compare(near: float):
    """Candidate pairs among rows (g, c, blk, same, sk) that come ordered by the group g; a crowd gives a star of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(a: np.ndarray, b: np.ndarray, tree: np.ndarray, crowd: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(tree), pa.array(np.full(len(a), crowd))], names=["c1", "c2", "tree", "crowd"])

        for table in groups(batches, "g"):
            g = table.column("g").to_numpy()
            sk = np.frombuffer(b"".join(table.column("sk").to_pylist()), np.uint32).reshape(-1, BINS)
            c = table.column("c").to_numpy()
            blk, same = table.column("blk").to_numpy(), table.column("same").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[edge, len(g)])
            part, use = np.repeat(np.arange(len(size)) << 32, size), np.ones(len(g), bool)
            for a, m in zip(edge[size >= CROWD].tolist(), size[size >= CROWD].tolist()):
                label, dense = crowds(sk[a : a + m], near)
                part[a : a + m] += label
                use[a : a + m] = ~dense[label]
                for k in np.flatnonzero(dense):
                    rows = c[a + np.flatnonzero(label == k)]
                    star = rows[rows != rows.min()]
                    yield found(np.full(len(star), rows.min()), star, np.ones(len(star), bool), True)
            rows = np.flatnonzero(use)
            rows = rows[np.argsort(part[rows], kind="stable")]
            parent: dict[int, int] = {}
            for i, j in _pairs_of(np.unique(part[rows], return_counts=True)[1]):
                i, j = rows[i], rows[j]
                new = same[i] | (blk[i] != blk[j])
                i, j = i[new], j[new]
                keep = _agree(sk[i], sk[j]) >= near
                i, j = i[keep], j[keep]
                if len(i):
                    yield found(c[i], c[j], forest(i, j, parent), False)

    return run


def candidate_pairs(classes: DataFrame, folder: str, *, near: float, fan: int) -> DataFrame:
    """Distinct pairs of classes that met in a node and whose sketches are close: (c1, c2, tree, crowd), c1 < c2.

    The pairs with ``tree`` alone connect what all pairs connect: components need only these few.  Classes that pairs
    with ``crowd`` connect are a crowd, of which all pairs are to be verified; not all of them are rows here.
    """

    width = WIDER * fan

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, BINS)
            child = children(batch.column(0).to_numpy(), sk, width)
            take = pa.array(np.repeat(np.arange(batch.num_rows), width))
            f = pa.array(np.tile(np.arange(width, dtype=np.int8), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), f, pa.array(child.ravel()), batch.column(1).take(take)], names=["parent", "f", "node", "c"])

    sketch = classes.select("c", "sk")
    at = classes.select(F.explode(F.array_distinct("nodes")).alias("node"), "c")
    found: list[DataFrame] = []
    depth = 1
    while True:
        at = stored(at, folder, f"nodes-{depth}")
        sizes = at.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        met = at.join(sizes, "node")
        # the same members often meet in several nodes: each such list is compared once
        lists = met.where(F.col("m") <= SMALL).groupBy("node").agg(F.sort_array(F.collect_list("c")).alias("l")).select("l").distinct()
        found.append(lists.select(F.xxhash64("l").alias("g"), F.explode("l").alias("c"), F.lit(0).alias("blk"), F.lit(True).alias("same")))
        large = stored(met.where(F.col("m") > SMALL), folder, f"large-{depth}")
        if large.isEmpty():
            break
        kids = stored(large.join(sketch, "c").select("node", "c", "sk").mapInArrow(split, "parent bigint, f tinyint, node bigint, c bigint"), folder, f"kids-{depth}")
        # two classes of a node get one child at a coordinate as often as their sketches agree.  With 1/width or more of
        # such pairs at half the coordinates, the children hold as many pairs as the node: it is compared as it is.
        alike = kids.groupBy("parent", "f", "node").agg(F.count("*").alias("n")).groupBy("parent", "f").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n") / F.sum("n")).alias("v"))
        dense = alike.groupBy("parent").agg(F.sum((F.col("v") >= 1 / width).cast("int")).alias("alike")).where((2 * F.col("alike") >= width) | F.lit(depth >= DEPTH))
        dense = stored(dense.select(F.col("parent").alias("node")), folder, f"dense-{depth}")
        big = large.join(dense, "node").withColumn("b", F.ceil(F.col("m") / (4 * BLOCK)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("c"), F.col("b")).cast("int"))
        tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("i"), F.greatest(o, F.col("blk")).alias("j"))))
        found.append(big.withColumn("t", tile).select(F.xxhash64("node", "t.i", "t.j").alias("g"), "c", "blk", (F.col("t.i") == F.col("t.j")).alias("same")))
        at = kids.join(dense.toDF("parent"), "parent", "left_anti").select("node", "c").distinct()
        depth += 1
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    rows = rows.join(sketch, "c").select("g", "c", "blk", "same", "sk")
    ordered = rows.repartition(F.col("g")).sortWithinPartitions("g")
    pairs = ordered.mapInArrow(_compare(near), "c1 bigint, c2 bigint, tree boolean, crowd boolean").where("c1 <> c2").groupBy("c1", "c2").agg(F.max("tree").alias("tree"), F.max("crowd").alias("crowd"))
    return stored(pairs, folder, "candidates")


def overlaps(token: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """How many tokens each set has in common with each of ``other`` (None: of the same sets).

    Tokens of many sets are columns of matrices that are multiplied; the pairs of sets that share a rarer one are counted.
    """
    both = token + (other or [])
    size = np.array([len(x) for x in both])
    row = np.repeat(np.arange(len(both)), size)
    _, name = np.unique(np.concatenate(both), return_inverse=True)
    often = np.bincount(name)
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    n = len(token)
    m = len(other) if other else n
    out = np.zeros((n, m), np.float32)
    wide = often > max(8, len(both) // 16)
    column = np.cumsum(wide) - 1
    start = np.searchsorted(name, np.arange(len(often)))
    base = 0 if other is None else n
    for at in range(0, int(wide.sum()), 512):
        here = np.flatnonzero(wide)[at : at + 512]
        take = wide[name] & (column[name] >= at) & (column[name] < at + 512)
        x = np.zeros((len(both), len(here)), np.float32)
        x[row[take], column[name[take]] - at] = 1
        out += x[:n] @ x[base:].T
    rare = np.flatnonzero(~wide & (often > 1))
    spot = np.repeat(start[rare], often[rare]) + np.arange(int(often[rare].sum())) - np.repeat(np.cumsum(often[rare]) - often[rare], often[rare])
    row = row[spot]
    for i, j in _pairs_of(often[rare]):
        a, b = row[i], row[j]  # in order, as the sets are
        if other is None:
            a, b = np.concatenate((a, b)), np.concatenate((b, a))
        else:
            cross = (a < n) & (b >= n)
            a, b = a[cross], b[cross] - n
        np.add.at(out.reshape(-1), a * m + b, np.float32(1))
    if other is None:
        out[np.arange(n), np.arange(n)] = size
    return out


ROW = "c1 bigint, c2 bigint, jaccard double, tree boolean, links bigint"


def _crowd_links(c: np.ndarray, weight: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float, out: str) -> Iterator[pa.RecordBatch]:
    """What ``verified_pairs`` returns of one tile of a crowd: all pairs of its two sides, or of its one side with itself."""
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    size = np.array([len(x) for x in sets])
    own = (side == 2).all()
    if own:
        two = one
    if not len(one) or not len(two):
        return
    common = overlaps([sets[r] for r in one], None if own else [sets[r] for r in two])
    linked = np.zeros(common.shape, bool)
    for at in range(0, len(one), 200):
        part = common[at : at + 200].astype(np.float64)
        part /= size[one[at : at + 200], None] + size[two] - part
        linked[at : at + 200] = part >= threshold
        if own:
            part[np.tril(np.ones(part.shape, bool), at)] = 0  # each pair once
        if out == "pairs":
            i, j = np.nonzero(part >= threshold)
            yield _found(c[one[at + i]], c[two[j]], part[i, j], np.zeros(len(i), bool))
    if own:
        np.fill_diagonal(linked, False)
    if out == "links":
        for rows, links in ((one, linked @ weight[two]), *(() if own else ((two, weight[one] @ linked),))):
            some = links > 0
            yield _found(c[rows[some]], links=links[some])
    n = len(one)
    if own:
        label = parts(lambda r, left: linked[r, left], n)
    else:
        across = linked.T.copy()
        def of(r: int, left: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(left), bool)
            far = left >= n
            if r < n:
                hit[far] = linked[r, left[far] - n]
            else:
                hit[~far] = across[r - n, left[~far]]
            return hit
        label = parts(of, n + len(two))
    rows = c[one] if own else np.concatenate((c[one], c[two]))
    first = rows[np.unique(label, return_index=True)[1]][label]
    star = first != rows
    yield _found(first[star], rows[star], np.full(int(star.sum()), np.nan), np.ones(int(star.sum()), bool))


def _found(c1: np.ndarray, c2: np.ndarray | None = None, jaccard: np.ndarray | None = None, tree: np.ndarray | None = None, links: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(c1)
    columns = [pa.array(c1, pa.int64()), pa.nulls(n, pa.int64()) if c2 is None else pa.array(c2, pa.int64()), pa.nulls(n, pa.float64()) if jaccard is None else pa.array(jaccard, pa.float64(), from_pandas=True)]
    columns += [pa.array(np.zeros(n, bool) if tree is None else tree), pa.nulls(n, pa.int64()) if links is None else pa.array(links, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "jaccard", "tree", "links"])


def verified_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, folder: str, *, n: int, threshold: float, out: str) -> DataFrame:
    """What of the candidate pairs and of the pairs in crowds reaches the threshold on the full sets: (c1, c2, jaccard, tree, links).

    Rows with ``tree`` connect what all such pairs connect.  With ``out`` = "pairs" every pair is a row with its
    ``jaccard``; with "links" rows without c2 have, to be summed up by c1, the documents in classes linked with c1; with
    "trees" there is nothing else.

    Candidates are grouped by connected component, so that a text travels once to its group; a component or crowd of more
    than ``BLOCK`` classes is cut into tiles of pairs.
    """
    crowd = stored(components(pairs.where("crowd"), folder + "/crowds", "c1", "c2"), folder, "crowds-members")
    apart = pairs.join(crowd.toDF("c1", "l1"), "c1", "left").join(crowd.toDF("c2", "l2"), "c2", "left").where("l1 is null or l2 is null or l1 <> l2").select("c1", "c2")
    labels = stored(components(pairs.where("tree"), folder, "c1", "c2"), folder, "labels")
    size = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("b"))
    told = apart.join(labels.toDF("c1", "label"), "c1").join(size, "label")
    key = F.xxhash64("label", F.pmod(F.xxhash64("c1"), F.col("b")), F.pmod(F.xxhash64("c2"), F.col("b"))).alias("g")
    told = told.select(key, "c1", "c2")
    rows = told.select("g", F.col("c1").alias("c"), F.col("c2").alias("p")).union(told.select("g", F.col("c2").alias("c"), F.lit(None).cast("bigint")))
    rows = rows.groupBy("g", "c").agg(F.collect_list("p").alias("p")).withColumn("side", F.lit(-1))
    tiled = crowd.join(crowd.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("b")), "label").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("i"), F.greatest(o, F.col("blk")).alias("j"))))
    side = F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("t.i") == F.col("blk"), 0).otherwise(1)
    tiled = tiled.withColumn("t", tile).select(F.xxhash64("label", "t.i", "t.j", F.lit("crowd")).alias("g"), F.col("node").alias("c"), F.array().cast("array<bigint>").alias("p"), side.alias("side"))
    weight = F.size(F.array_distinct(F.transform("members", lambda m: m["doc_id"]))).cast("bigint").alias("w")
    rows = stored(rows.union(tiled).join(classes.select("c", F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("t"), weight), "c"), folder, "wanted")
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("th"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    text = text.where(key_filter(rows.select("t").distinct(), "t")("th"))  # only these travel
    rows = rows.join(text, (F.col("t") == F.col("th")) & F.col("i").eqNullSafe(F.col("doc_id"))).select("g", "c", "p", "side", "w", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            g, names, partners, side, weight = table.column("g").to_numpy(), table.column("c").to_numpy(), table.column("p").to_pylist(), table.column("side").to_numpy(), table.column("w").to_numpy()
            text = table.column("text").combine_chunks()
            text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
            sets: list[np.ndarray] = []
            for a, b in pieces(text, PIECE):
                token, at = shingles(*flat(text[a:b]), n)
                sets += np.split(token, at[1:-1])
            edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            pair, parent = [], {}
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                spot = {c: a + r for r, c in reversed(list(enumerate(names[a:b].tolist())))}  # a repeated row of the table counts once
                if side[a] >= 0:
                    rows = np.sort(np.fromiter(spot.values(), np.int64))
                    yield from _crowd_links(names[rows], weight[rows], side[rows], [sets[r] for r in rows], threshold, out)
                    continue
                for own, r in spot.items():
                    x = sets[r]
                    for other in partners[r]:
                        y = sets[spot[other]]
                        if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                            continue
                        both = np.concatenate((x, y))
                        both.sort(kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        j = common / (len(x) + len(y) - common)
                        if j >= threshold:
                            pair.append((r, spot[other], j))
            if pair:
                r, o, j = (np.array(v) for v in zip(*pair))
                tree = forest(r, o, parent)
                if out == "links":
                    yield _found(np.concatenate((names[r], names[o])), links=np.concatenate((weight[o], weight[r])))
                keep = tree | (out == "pairs")
                yield _found(names[r[keep]], names[o[keep]], j[keep], tree[keep])

    ordered = rows.repartition(F.col("g")).sortWithinPartitions("g")
    return stored(ordered.mapInArrow(verify, ROW), folder, "verified")


def _join(docs: DataFrame, n: int, threshold: float, recall: float, out: str) -> tuple[DataFrame, DataFrame, str]:
    fan, runs, near = plan(threshold, recall)
    folder = shared_dir(docs.sparkSession)
    classes = class_table(docs, folder, n=n, fan=fan, runs=runs)
    pairs = candidate_pairs(classes, folder, near=near, fan=fan)
    return classes, verified_pairs(docs, classes, pairs, folder, n=n, threshold=threshold, out=out), folder


def jaccard_join(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, factored: bool = False) -> DataFrame:
    """All pairs of documents whose word n-gram sets have a Jaccard similarity of at least ``threshold``.

    One row a pair: (doc_a, doc_b, jaccard), doc_a < doc_b.  With ``factored`` the same pairs come as (docs_a, docs_b,
    jaccard): every document of docs_a pairs with every other one of docs_b; the documents of one list have equal sets,
    and a row with docs_a = docs_b lists such a class (jaccard 1).  Plain pairs are spelled out from that form where it
    arises, without an exchange; use ``factored`` where millions of documents are equal, as their pairs grow with the square.

    Null, empty and blank texts match nothing.  Texts shorter than n words are one token; very long ones take part with
    all their n-grams.  Rows that repeat id and set count once, an id with several texts pairs by each of them, never
    with itself; documents without an id take part but can't be listed.  Ties: all pairs at exactly the threshold
    belong to the result.  Empty table: empty result.  Words are separated by white space up to U+0020 and compared in
    lower case.  Columns other than ``doc_id`` and ``text`` are not read, whatever their names.
    """
    classes, pairs, _ = _join(docs, n, threshold, recall, "pairs")
    pairs = pairs.where("jaccard is not null")
    known = F.filter("members", lambda m: m["doc_id"].isNotNull())
    ids = classes.select("c", F.array_sort(F.array_distinct(F.transform(known, lambda m: m["doc_id"]))).alias("ids")).where("size(ids) > 0")
    out = pairs.join(ids.toDF("c1", "docs_a"), "c1").join(ids.toDF("c2", "docs_b"), "c2").select("docs_a", "docs_b", F.round("jaccard", 6).alias("jaccard"))
    equal = ids.where("size(ids) > 1").select(F.col("ids").alias("docs_a"), F.col("ids").alias("docs_b"), F.lit(1.0).alias("jaccard"))
    if factored:
        return out.union(equal)
    one = out.select(F.explode("docs_a").alias("a"), "docs_b", "jaccard").select("a", F.explode("docs_b").alias("b"), "jaccard").where("a <> b")
    same = equal.select(F.posexplode("docs_a").alias("i", "a"), "docs_b", "jaccard").select("a", F.explode(F.slice("docs_b", F.col("i") + 2, F.size("docs_b"))).alias("b"), "jaccard")
    return one.union(same).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")


def near_duplicate_classes(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: (doc_id, class_id, links).

    A document is a distinct pair of id and n-gram set.  ``links`` is the number of other documents whose sets have a
    Jaccard similarity of at least ``threshold`` with its own, copies among them.  Classes are the connected components of
    these links, where the documents of one id are in one class as well; ``class_id`` is the least id of the class.  So
    the rows grow with the table, whatever the number of pairs; ``jaccard_join`` spells the pairs out.

    Null, empty and blank texts have an empty set and no links.  Texts shorter than n words are one token; very long ones
    take part with all their n-grams.  Rows that repeat id and set are one document.  Null ids are listed and take part;
    they are no reason to be in one class, and a class of nothing else has a null ``class_id``.  Ties: similarities at
    exactly the threshold count.  Empty table: empty result.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    classes, found, folder = _join(docs, n, threshold, recall, "links")
    ids = classes.select("c", F.array_distinct(F.transform("members", lambda m: m["doc_id"])).alias("ids"))
    links = found.where("links is not null").groupBy("c1").agg(F.sum("links").alias("links"))
    owner = ids.select("c", F.explode("ids").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("c").alias("l")).where("size(l) > 1")
    owner = owner.select(F.array_min("l").alias("c1"), F.explode("l").alias("c2")).where("c1 <> c2")
    label = components(found.where("tree").select("c1", "c2").union(owner), folder + "/groups", "c1", "c2")
    told = ids.join(label.toDF("c", "label"), "c", "left").join(links.toDF("c", "links"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    told = stored(told, folder, "told")
    least = told.groupBy("label").agg(F.min(F.array_min("ids")).alias("class_id"))
    rows = told.join(least, "label").select(F.explode("ids").alias("doc_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.size("ids") - 1).alias("links"))
    blank = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x00-\\x20]")).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    classed = told.join(least, "label").select(F.explode("ids").alias("doc_id"), "class_id").distinct()
    return rows.union(blank.join(classed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.lit(0).cast("bigint")))


def drop_near_duplicates(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least (doc_id, text fingerprint), null ids first.

    Groups are the connected components of the join's pairs.  Null, empty and blank texts belong to no group and all stay;
    very long ones take part whole.  Of rows that agree in id and text (ties) any one stays.  Empty table: empty result.
    All columns are kept, whatever their names.
    """
    classes, pairs, folder = _join(docs, n, threshold, recall, "trees")
    label = components(pairs.where("tree"), folder + "/groups", "c1", "c2")
    told = classes.select("c", "rep", "members").join(label.toDF("c", "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    best = told.groupBy("label").agg(F.min("rep").alias("best"), F.sum(F.size("members")).alias("all")).where("all > 1")
    # the rows of groups of several rows, by (doc_id, text fingerprint): those that go, and those that stay but are there more than once
    fate = told.join(best, "label").select(F.explode("members").alias("key"), "best").groupBy("key").agg(F.max(F.col("key") == F.col("best")).alias("stays"), F.count("*").alias("rows"))
    fate = stored(fate.where("not stays or rows > 1").select("key", "stays"), folder, "fate")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("th")).alias("key"))
    known = key_filter(fate.select("key.th"), "th")  # rows that it doesn't know stay where they are
    rest = held.where(~known("key.th")).union(held.where(known("key.th")).join(fate, "key", "left_anti").select("row", "key"))
    again = fate.where("stays")
    if not again.isEmpty():
        rest = rest.select("row").union(held.join(again, "key", "left_semi").dropDuplicates(["key"]).select("row"))
    return rest.select("row.*")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))


def sql(n: int = N, threshold: float = THRESHOLD) -> str:
    gram = " || chr(1) || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x20]+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, chr(1))] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) END)) t
  FROM split WHERE len(w) > 0
), numbered AS (
  SELECT row_number() OVER () r, doc_id, t FROM sets
), tokens AS (
  SELECT r, doc_id, len(t) n, unnest(t) g FROM numbered
)
SELECT least(any_value(a.doc_id), any_value(b.doc_id)) AS doc_a, greatest(any_value(a.doc_id), any_value(b.doc_id)) AS doc_b,
  round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard
FROM tokens a JOIN tokens b ON a.g = b.g AND a.r < b.r AND a.doc_id <> b.doc_id GROUP BY a.r, b.r
HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= {threshold}
"""


def class_sql(n: int = N, threshold: float = THRESHOLD) -> str:
    gram = " || chr(1) || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x20]+'), lambda x: x <> '') w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, chr(1))] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) END)) t
  FROM split
), numbered AS MATERIALIZED (
  SELECT row_number() OVER () r, doc_id, t FROM sets
), tokens AS MATERIALIZED (
  SELECT r, len(t) n, unnest(t) g FROM numbered
), pairs AS MATERIALIZED (
  SELECT a.r a, b.r b FROM tokens a JOIN tokens b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
  HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= {threshold}
), edges AS MATERIALIZED (
  SELECT a, b FROM pairs UNION SELECT x.r, y.r FROM numbered x JOIN numbered y ON x.doc_id = y.doc_id AND x.r <> y.r
), reach(r, o) AS (
  SELECT r, r FROM numbered UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.o
), classes AS (
  SELECT reach.r, min(x.doc_id) class_id FROM reach JOIN numbered x ON x.r = reach.o GROUP BY reach.r
), linked AS (
  SELECT a r, count(*) links FROM pairs GROUP BY a
)
SELECT numbered.doc_id, class_id, coalesce(links, 0) AS links
FROM numbered JOIN classes ON classes.r = numbered.r LEFT JOIN linked ON linked.r = numbered.r
"""
