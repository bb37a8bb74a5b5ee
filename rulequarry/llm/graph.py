"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors are assigned to overlapping clusters: to coarse cells around centres that all vectors were averaged into, and
inside these to fine ones around members.  Each cluster is a shard in which every vector is linked to a pruned choice
of its nearest neighbours: a neighbour is left out if one that was already chosen is much closer to it.  The adjacency
lists of all shards are united; a link between shards is followed if its ends are near each other, as only these lead on
within range.  Every vector is a query: a greedy search starts at the shard's medoid, and from what
it finds within range the search expands along the graph until no new vector is in range.  Pairs are verified on the
exact vectors, and the recall is audited by brute force on a sample of queries; while it falls short, the search is
repeated with more overlap and a wider beam, and what it adds is kept.  Vectors of each length are a world of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, read, shared_dir, stored
from .jaccard import groups

THRESHOLD, RECALL = 0.95, 0.95
SHARD, BLOCK, OVERLAP, DEGREE, POOL, BEAM, ALPHA, SLACK = 200, 1000, 2, 24, 96, 16, 1.2, 0.15
AUDIT, AUDIT_PAIRS, MOST_AUDIT = 256, 100, 4096  # audited queries at first, near pairs that they should have, queries at most
ATTEMPTS = 4
ENTRIES = 1 << 22  # numbers that a search step holds at a time, whatever the number of links of a vector


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> list[np.ndarray]:
    """Pruned neighbour lists of all rows of ``x`` (unit vectors), made symmetric."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    pool = min(pool, n - 1)
    dist = np.maximum(2 - 2 * (x @ x.T), 0)
    np.fill_diagonal(dist, np.inf)
    near = np.argpartition(dist, pool - 1, axis=1)[:, :pool]
    # far links keep the graph connected: some neighbours by rank further out
    far = np.argsort(dist[:, :: max(1, n // 64)], axis=1) * max(1, n // 64)
    cand = np.concatenate([near, far[:, :32]], axis=1)
    d = np.take_along_axis(dist, cand, 1)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    rows = np.arange(n)
    src, dst = [], []
    for _ in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        r, c = rows[some], cand[rows[some], first[some]]
        src.append(r)
        dst.append(c)
        gap = dist[c[:, None], cand[r]]
        alive[r] &= (alpha * gap > d[r]) & (cand[r] != c[:, None])
    src, dst = np.concatenate(src), np.concatenate(dst)
    code = np.unique(np.concatenate((src * n + dst, dst * n + src)))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max((len(x) for x in lists), default=0) or 1), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def range_search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, start: int, threshold: float, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within ``threshold``: greedy beam search from ``start``, then expansion within range.

    All queries advance side by side; ``adjacency`` is padded with -1.
    """
    q, n = len(queries), len(x)
    ids = np.full((q, beam), -1, np.int64)
    sim = np.full((q, beam), -2.0, np.float32)
    open_ = np.zeros((q, beam), bool)
    ids[:, 0], sim[:, 0], open_[:, 0] = start, x[queries] @ x[start], True
    live = np.arange(q)
    while len(live):
        best = np.where(open_[live], sim[live], -3).argmax(1)
        node = ids[live, best]
        open_[live, best] = False
        new = adjacency[node]
        new = new[:, : max(1, int((new >= 0).sum(1).max()))]  # hubs make the table wide
        known = (new[:, :, None] == ids[live][:, None, :]).any(2) | (new < 0)
        score = np.einsum("qrd,qd->qr", x[np.maximum(new, 0)], x[queries[live]])
        score[known] = -3
        all_ids, all_sim = np.concatenate((ids[live], new), 1), np.concatenate((sim[live], score), 1)
        all_open = np.concatenate((open_[live], ~known), 1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        ids[live], sim[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sim, top, 1)
        open_[live] = np.take_along_axis(all_open, top, 1) & (sim[live] > -2)
        live = live[open_[live].any(1)]
    hit = (sim >= threshold - slack) & (ids >= 0)
    code = np.unique(np.nonzero(hit)[0] * n + ids[hit])
    frontier = code
    while len(frontier):
        fresh = []
        step = max(1, ENTRIES // adjacency.shape[1])
        for i in range(0, len(frontier), step):
            a, b = frontier[i : i + step] // n, frontier[i : i + step] % n
            near = adjacency[b]
            a = np.broadcast_to(a[:, None], near.shape)[near >= 0]
            fresh.append(np.unique(a * n + near[near >= 0]))
        fresh = np.setdiff1d(np.unique(np.concatenate(fresh)), code, assume_unique=True)
        keep = [np.einsum("id,id->i", x[queries[c // n]], x[c % n]) >= threshold - slack for c in np.array_split(fresh, len(fresh) // 100_000 + 1)]
        frontier = fresh[np.concatenate(keep)]
        code = np.union1d(code, frontier)
    return queries[code // n], code % n


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The lengths that the vectors of a column have, and the rows of each."""
    size = np.diff(column.offsets.to_numpy())
    for d in np.unique(size):
        yield int(d), np.flatnonzero(size == d)


def _centres(vectors: DataFrame, count: int, rounds: int = 3) -> np.ndarray:
    """Cluster centres: the vectors with the least hashes, moved by a few rounds over all vectors."""
    first = vectors.orderBy(F.xxhash64("k", F.lit("centre"))).limit(count).select("x").toPandas()["x"]
    centres = np.array(first.tolist(), np.float32).reshape(len(first), -1)
    for _ in range(rounds):
        own = centres

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(own.shape, np.float64), np.zeros(len(own), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0))
                    at = (x @ own.T).argmax(1)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(own))
            hit = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * own.shape[1], pa.int32()), pa.array(total[hit].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(hit), lists], names=["c", "s"])

        for c, s in vectors.select("x").mapInArrow(part, "c bigint, s array<double>").groupBy("c").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(own.shape[1]))).alias("s")).toLocalIterator():
            norm = np.linalg.norm(s)
            if norm > 0:
                centres = centres.copy()
                centres[c] = np.array(s) / norm
    return centres


def _coarse(vectors: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(g, r, k, x): each vector in its ``overlap`` nearest coarse cells, r = 0 the nearest; a cell is of one length.

    A length without centres is one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_length(batch.column(1)):
                part = batch.take(pa.array(rows))
                own = centres.get(d)
                near = np.zeros((len(rows), 1), np.int64) if own is None else np.argsort(-(matrix(part.column(1)) @ own.T), axis=1, kind="stable")[:, :overlap]
                take = pa.array(np.repeat(np.arange(len(rows)), near.shape[1]))
                rank = np.tile(np.arange(near.shape[1], dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array((d << 44 | near << 22).ravel()), pa.array(rank), part.column(0).take(take), part.column(1).take(take)], names=["g", "r", "k", "x"])

    return vectors.select("k", "x").mapInArrow(run, "g bigint, r int, k bigint, x array<float>")


def _fine(coarse: DataFrame, count: dict[int, int], overlap: int) -> DataFrame:
    """(g, k, x): each coarse cell cut up around ``count`` of its vectors; one at home there goes to ``overlap`` parts, others to one.

    Only the centres of one coarse cell are in memory; its vectors stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(g: int, centres: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
            for batch in table.combine_chunks().to_batches():
                near = np.argsort(-(matrix(batch.column(3)) @ centres.T), axis=1, kind="stable")[:, :overlap]
                use = (batch.column(1).to_numpy() == 0)[:, None] | (np.arange(near.shape[1]) == 0)
                row, spot = np.nonzero(use)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(g + near[row, spot]), batch.column(2).take(take), batch.column(3).take(take)], names=["g", "k", "x"])

        own, centres, held = None, None, []
        for batch in batches:
            g = batch.column(0).to_numpy()
            edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if g[a] != own:
                    if held:
                        table = pa.concat_tables(held)
                        yield from parts(own, matrix(table.column("x")), table)
                    own, centres, held = int(g[a]), None, []
                held.append(pa.Table.from_batches([batch.slice(int(a), int(b - a))]))
                want = count[own >> 44]
                if centres is None and sum(map(len, held)) >= want:
                    centres = matrix(pa.concat_tables(held).column("x").slice(0, want))
                if centres is not None:
                    yield from parts(own, centres, pa.concat_tables(held))
                    held = []
        if held:
            table = pa.concat_tables(held)
            yield from parts(own, matrix(table.column("x")), table)

    ordered = coarse.repartition(F.col("g")).sortWithinPartitions("g", "r", F.xxhash64("k"))
    return ordered.mapInArrow(run, "g bigint, k bigint, x array<float>")


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition(F.col("g")).sortWithinPartitions("g")


def _blocks(x: np.ndarray, rows: np.ndarray, seed: int = 1) -> Iterator[np.ndarray]:
    """Overlapping blocks of at most 2 * BLOCK rows: around random members as long as that cuts them up, else slices."""
    if len(rows) <= 2 * BLOCK:
        yield rows
        return
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(rows, -(-2 * len(rows) // BLOCK), replace=False)]
    near = np.concatenate([np.argpartition(-(x[rows[i : i + 4096]] @ centres.T), 1, axis=1)[:, :2] for i in range(0, len(rows), 4096)])
    for c in range(len(centres)):
        part = rows[(near == c).any(1)]
        if len(part) <= 0.5 * len(rows):
            yield from _blocks(x, part, seed + 1)
        else:  # all alike: any slices do
            mixed = rng.permutation(part)
            for start in range(0, max(1, len(part) - BLOCK), BLOCK):
                yield mixed[start : start + 2 * BLOCK]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, "g"):
        g = table.column("g").to_numpy()
        edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            part = table.slice(a, b - a)
            k, x = part.column("k").to_numpy(), matrix(part.column("x"))
            for block in _blocks(x, np.arange(len(k))):
                lists = robust_prune(x[block])
                src = np.repeat(k[block], [len(y) for y in lists])
                dst = k[block][np.concatenate(lists)] if len(src) else np.zeros(0, np.int64)
                if len(src):
                    i = np.repeat(np.arange(len(block)), [len(y) for y in lists])
                    s = np.einsum("id,id->i", x[block[i]], x[block[np.concatenate(lists)]])
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(s)], names=["k", "n", "s"])


def _search(threshold: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            g = table.column("g").to_numpy()
            edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                part = table.slice(a, b - a)
                k, x = part.column("k").to_numpy(), matrix(part.column("x"))
                near = part.column("near").combine_chunks()
                near = pa.concat_arrays(near.chunks) if isinstance(near, pa.ChunkedArray) else near
                size = np.diff(near.offsets.to_numpy())
                src, dst = np.repeat(np.arange(len(k)), size), near.flatten().to_numpy()
                order = np.argsort(k)
                slot = np.searchsorted(k[order], dst)
                slot[slot == len(k)] = 0
                here = k[order][slot] == dst
                src, dst = src[here], order[slot[here]]
                code = np.unique(np.concatenate((src * len(k) + dst, dst * len(k) + src)))
                adjacency = _padded(np.split(code % len(k), np.searchsorted(code // len(k), np.arange(1, len(k)))))
                member = np.flatnonzero(size > 0) if (size > 0).any() else np.arange(len(k))
                medoid = int(member[(x[member] @ x[member].mean(0)).argmax()])
                step = max(1, min(1000, ENTRIES // (adjacency.shape[1] * x.shape[1]), ENTRIES // len(k)))
                for i in range(0, len(member), step):
                    p, q = range_search(x, adjacency, member[i : i + step], medoid, threshold, beam)
                    exact = np.einsum("id,id->i", x[p].astype(np.float64), x[q].astype(np.float64)) / np.linalg.norm(x[p].astype(np.float64), axis=1) / np.linalg.norm(x[q].astype(np.float64), axis=1)
                    keep = (exact >= threshold) & (k[p] != k[q])
                    p, q, exact = p[keep], q[keep], exact[keep]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[p], k[q])), pa.array(np.maximum(k[p], k[q])), pa.array(exact)], names=["a", "b", "s"])

    return run


def audit(vectors: DataFrame, pairs: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[int, int]:
    """(pairs found, pairs there are) of ``sample`` queries chosen by hash, each compared with every vector of its length."""
    chosen = vectors.orderBy(F.xxhash64("k", F.lit("audit"))).limit(sample).select("k", "x").toArrow()
    queries = {}
    for part in chosen.combine_chunks().to_batches():
        for d, rows in _by_length(part.column(1)):
            q = matrix(part.column(1).take(pa.array(rows))).astype(np.float64)
            queries[d] = part.column(0).to_numpy()[rows], q / np.linalg.norm(q, axis=1)[:, None]
    if not queries:
        return 0, 0

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_length(batch.column(1)):
                if d not in queries:
                    continue
                keys, q = queries[d]
                k, x = batch.column(0).to_numpy()[rows], matrix(batch.column(1).take(pa.array(rows))).astype(np.float64)
                for at in range(0, len(k), 2000):
                    part = x[at : at + 2000]
                    i, j = np.nonzero(q @ part.T / np.linalg.norm(part, axis=1) >= threshold)
                    j += at
                    i, j = i[keys[i] != k[j]], j[keys[i] != k[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[i], k[j])), pa.array(np.maximum(keys[i], k[j]))], names=["a", "b"])

    truth = vectors.select("k", "x").mapInArrow(brute, "a bigint, b bigint").distinct()
    row = truth.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("hit"), F.count("*")).first()
    return row[0], row[1]


def _join(embeddings: DataFrame, threshold: float, recall: float, shard: int, overlap: int, beam: int, attempts: int) -> tuple[DataFrame, DataFrame, str]:
    """(classes, pairs, folder): vectors of equal direction by number, k and ids, and the near pairs of numbers."""
    spark = embeddings.sparkSession
    folder = shared_dir(spark)
    x = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), x.alias("e"), norm.alias("norm")).where("size(e) > 0 and norm > 0 and norm < double('infinity')")
    unit = F.transform("e", lambda v: (v / F.col("norm")).cast("float"))
    classes = rows.select("id", unit.alias("x")).groupBy("x").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"), F.max(F.col("id").isNull().cast("int")).alias("unnamed"))
    classes = stored(classes.withColumn("k", F.monotonically_increasing_id()), folder, "classes")  # numbers that are fixed once written
    vectors = classes.select("k", "x")
    amount = {d: n for d, n in vectors.groupBy(F.size("x")).count().collect()}  # a row for each length
    pairs = None
    for attempt in range(attempts):
        cells = {d: max(1, -(-overlap * n // shard)) for d, n in amount.items()}
        outer_cells = {d: math.isqrt(c - 1) + 1 for d, c in cells.items()}
        centres = {d: _centres(vectors.where(F.size("x") == d), c) for d, c in outer_cells.items() if c > 1}
        cells = stored(_fine(_coarse(vectors, centres, overlap), {d: -(-c // outer_cells[d]) for d, c in cells.items()}, overlap), folder, f"cells-{attempt}")
        links = _grouped(cells).mapInArrow(_build, "k bigint, n bigint, s float").groupBy("k", "n").agg(F.max("s").alias("s"))
        leads = F.collect_list(F.when(F.col("s") >= threshold - SLACK, F.col("n"))).alias("far")
        lists = stored(links.groupBy("k").agg(F.collect_list("n").alias("near"), leads), folder, f"lists-{attempt}")
        # each shard gets its members with their united lists, and the near vectors that these point to elsewhere
        member = cells.select("g", "k").join(lists, "k", "left").select("g", "k", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"), "far")
        outer = member.select("g", F.explode("far").alias("k")).distinct().join(cells.select("g", "k"), ["g", "k"], "left_anti").select("g", "k", F.array().cast("array<bigint>").alias("near"))
        local = member.drop("far").union(outer).join(vectors, "k").select("g", "k", "x", "near")
        found = _grouped(local).mapInArrow(_search(threshold, beam), "a bigint, b bigint, s double")
        found = found if pairs is None else found.union(pairs)
        pairs = stored(found.groupBy("a", "b").agg(F.max("s").alias("s")), folder, f"pairs-{attempt}")
        sample = AUDIT
        got, there = audit(vectors, pairs, threshold, sample)
        while there < AUDIT_PAIRS and sample < min(MOST_AUDIT, sum(amount.values())):
            sample *= 4
            got, there = audit(vectors, pairs, threshold, sample)
        if got >= recall * there:
            break
        overlap, beam = overlap + 1, beam * 2
    else:
        raise RuntimeError(f"audited recall {got}/{there} is below {recall} after {attempts} searches")
    return classes, pairs, folder


def near_duplicates(embeddings: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, shard: int = SHARD, overlap: int = OVERLAP, beam: int = BEAM, attempts: int = ATTEMPTS, factored: bool = False) -> DataFrame:
    """Pairs of embeddings whose cosine is at least ``threshold``: (vec_a, vec_b, cosine), vec_a < vec_b.

    Embeddings with equal directions and lengths form a class, and only classes are searched.  With ``factored`` a row
    is (vecs_a, vecs_b, cosine): each of vecs_a pairs with each other one of vecs_b, and one with vecs_a = vecs_b lists
    such a class of two or more (cosine 1).  Vectors of different lengths never match; each length is searched.

    Null or empty vectors, those with null, NaN or infinite entries and zero vectors match nothing.  Rows that repeat
    id and direction count once; an id with several vectors pairs by each of them, never with itself; vectors without
    an id can't be listed.  Ties: all pairs at exactly the threshold belong to the result.  Very long vectors are
    compared whole.  Empty table: empty result.  Columns other than ``vec_id`` and ``embedding`` are not read.

    The audit takes ``AUDIT`` queries and, while they have fewer than ``AUDIT_PAIRS`` near vectors, four times as many,
    ``MOST_AUDIT`` at most.  If ``recall`` is still missed after ``attempts`` searches, a RuntimeError says so.
    """
    classes, pairs, _ = _join(embeddings, threshold, recall, shard, overlap, beam, attempts)
    ids = classes.where("size(ids) > 0").select("k", "ids")
    out = pairs.join(ids.toDF("a", "vecs_a"), "a").join(ids.toDF("b", "vecs_b"), "b").select("vecs_a", "vecs_b", F.round("s", 4).alias("cosine"))
    equal = ids.where("size(ids) > 1").select(F.col("ids").alias("vecs_a"), F.col("ids").alias("vecs_b"), F.lit(1.0).alias("cosine"))
    if factored:
        return out.union(equal)
    one = out.select(F.explode("vecs_a").alias("a"), "vecs_b", "cosine").select("a", F.explode("vecs_b").alias("b"), "cosine").where("a <> b")
    same = equal.select(F.posexplode("vecs_a").alias("i", "a"), "vecs_b", "cosine").select("a", F.explode(F.slice("vecs_b", F.col("i") + 2, F.size("vecs_b"))).alias("b"), "cosine")
    return one.union(same).select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b"), "cosine")


def near_duplicate_classes(embeddings: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, shard: int = SHARD, overlap: int = OVERLAP, beam: int = BEAM, attempts: int = ATTEMPTS) -> DataFrame:
    """One row per vector: (vec_id, class_id, links).

    A vector is a distinct pair of id and direction.  ``links`` is the number of other vectors of its length whose cosine
    with it is at least ``threshold``, copies among them.  Classes are the connected components of these links, where the
    vectors of one id are in one class as well; ``class_id`` is the least id of the class.  So the rows grow with the table,
    whatever the number of pairs; ``near_duplicates`` spells the pairs out, and says which vectors match nothing: those
    are no rows here.  Vectors without an id are one for each direction; they count as links and are listed.
    """
    classes, pairs, folder = _join(embeddings, threshold, recall, shard, overlap, beam, attempts)
    ids = classes.select("k", "ids", "unnamed", (F.size("ids") + F.col("unnamed")).cast("bigint").alias("w"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = both.join(ids.select(F.col("k").alias("b"), "w"), "b").groupBy("a").agg(F.sum("w").alias("links"))
    owner = ids.select("k", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_list("k").alias("l")).where("size(l) > 1")
    owner = owner.select(F.array_min("l").alias("a"), F.explode("l").alias("b")).where("a <> b")
    label = components(pairs.select("a", "b").union(owner), folder + "/groups")
    told = ids.join(label.toDF("k", "label"), "k", "left").join(links.toDF("k", "links"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    told = stored(told, folder, "told")
    least = told.groupBy("label").agg(F.min(F.array_min("ids")).alias("class_id"))
    listed = F.when(F.col("unnamed") == 1, F.concat("ids", F.array(F.lit(None).cast("bigint")))).otherwise(F.col("ids"))
    return told.join(least, "label").select(F.explode(listed).alias("vec_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "embeddings"))


SQL = f"""
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding::DOUBLE[], lambda v: (v / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda u: u * u))))::FLOAT) e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)) > 0
), numbered AS (
  SELECT row_number() OVER () r, vec_id, e::DOUBLE[] e FROM rows
)
SELECT least(a.vec_id, b.vec_id) AS vec_a, greatest(a.vec_id, b.vec_id) AS vec_b, round(list_cosine_similarity(a.e, b.e), 4) AS cosine
FROM numbered a JOIN numbered b ON a.r < b.r AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
"""

CLASS_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding::DOUBLE[], lambda v: (v / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda u: u * u))))::FLOAT) e FROM embeddings
  WHERE len(embedding) > 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)) > 0
), numbered AS MATERIALIZED (
  SELECT row_number() OVER () r, vec_id, e::DOUBLE[] e FROM rows
), pairs AS MATERIALIZED (
  SELECT a.r a, b.r b FROM numbered a JOIN numbered b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), edges AS MATERIALIZED (
  SELECT a, b FROM pairs UNION SELECT x.r, y.r FROM numbered x JOIN numbered y ON x.vec_id = y.vec_id AND x.r <> y.r
), reach(r, o) AS (
  SELECT r, r FROM numbered UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.o
), classes AS (
  SELECT reach.r, min(x.vec_id) class_id FROM reach JOIN numbered x ON x.r = reach.o GROUP BY reach.r
), linked AS (
  SELECT a r, count(*) links FROM pairs GROUP BY a
)
SELECT numbered.vec_id, class_id, coalesce(links, 0) AS links
FROM numbered JOIN classes ON classes.r = numbered.r LEFT JOIN linked ON linked.r = numbered.r
"""
