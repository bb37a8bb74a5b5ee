"""Quality classifier: a byte-level convolutional network in numpy.

A filter sees ``WIDTH`` neighbouring bytes; its weights are one row per (offset, byte value), so a convolution over
one-hot bytes is a sum of table rows.  A document is cut into chunks of ``CHUNK`` bytes that overlap by
``WIDTH - 1`` bytes, so every window of the whole text lies in a chunk.  Each filter is max-pooled over a chunk; the
document's features are, per filter, the maximum over its chunks and the mean over its chunks, and a logistic unit
combines them into one probability.  Filters start from the byte n-grams of the training texts that tell the labels
apart best, and are then trained together with the output by back-propagation through the max-pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import flat, pieces, read

WIDTH, FILTERS, CHUNK = 6, 32, 1024
SAMPLE = 4000  # labelled documents to fit on, at most
SAMPLE_BYTES = 12 << 20  # and their texts' bytes, at most
EPOCHS, STEPS, RATE = 10, 250, 0.02


class ByteConvNet:
    """Parameters: ``w`` (WIDTH, 256, FILTERS), ``b`` (FILTERS), ``v`` (2 * FILTERS), ``c``."""

    def __init__(self, w: np.ndarray, b: np.ndarray, v: np.ndarray, c: float):
        self.w, self.b, self.v, self.c = w.astype(np.float32), b.astype(np.float32), v.astype(np.float32), float(c)

    def _tables(self) -> list[np.ndarray]:
        # two neighbouring bytes at once: half as many look-ups
        return [(self.w[k][:, None, :] + self.w[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def pooled(self, raw: np.ndarray, at: np.ndarray, where: bool = False, tables: list[np.ndarray] | None = None):
        """Chunk maxima (after ReLU) with each chunk's row and, if asked for, the byte at which each maximum starts.

        Rows are padded with WIDTH - 1 zero bytes, so that a row of n bytes has n windows and an empty row none.
        """
        n = np.diff(at)
        pad = np.zeros(len(raw) + (WIDTH - 1) * len(n), np.uint8)
        base = at[:-1] + (WIDTH - 1) * np.arange(len(n))
        pad[np.arange(len(raw)) + np.repeat((WIDTH - 1) * np.arange(len(n)), n)] = raw
        per = -(-n // CHUNK)
        row = np.repeat(np.arange(len(n)), per)
        start = np.repeat(base, per) + CHUNK * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
        stop = np.minimum(start + CHUNK, np.repeat(base + n, per))
        top = np.zeros((len(row), FILTERS), np.float32)
        arg = np.zeros((len(row), FILTERS), np.int64) if where else None
        tables = tables or self._tables()
        pair = pad[:-1].astype(np.int32) * 256 + pad[1:] if len(pad) > 1 else np.zeros(0, np.int32)
        for i in range(0, len(row), 64):
            # neighbouring chunks of one block are laid end to end; windows between rows are cut out below
            a, b = start[i], stop[min(i + 64, len(row)) - 1]
            act = tables[0][pair[a:b]]
            for k in range(1, WIDTH // 2):
                act += tables[k][pair[a + 2 * k : b + 2 * k]]
            j = slice(i, min(i + 64, len(row)))
            edges = np.stack([start[j] - a, stop[j] - a], 1).ravel()
            if edges[-1] == len(act):
                edges = edges[:-1]
            top[j] = np.maximum.reduceat(act, edges, axis=0)[::2]
            if where:
                for k in range(i, min(i + 64, len(row))):
                    arg[k] = act[start[k] - a : stop[k] - a].argmax(0) + start[k]
        return np.maximum(top + self.b, 0), row, arg, pad

    def features(self, top: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 2 * FILTERS), np.float32)
        if len(row):
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[at, len(row)])[:, None]
            out[row[at], :FILTERS] = np.maximum.reduceat(top, at, axis=0)
            out[row[at], FILTERS:] = np.add.reduceat(top, at, axis=0) / size
        return out

    def predict(self, raw: np.ndarray, at: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        top, row, *_ = self.pooled(raw, at, tables=tables)
        z = self.features(top, row, len(at) - 1) @ self.v + self.c
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _grams(text: np.ndarray, n: int) -> np.ndarray:
    """The distinct byte n-grams of one text, as numbers."""
    code = np.zeros(max(len(text) - n + 1, 0), np.uint64)
    for k in range(n):
        code = code << np.uint64(8) | text[k : k + len(code)]
    return np.unique(code)


def _telling(raw: np.ndarray, at: np.ndarray, y: np.ndarray, n: int, count: int, covered: np.ndarray) -> list[int]:
    """Byte n-grams (as numbers) chosen one by one: each marks most rejected documents that few before it mark.

    ``covered``: by how many n-grams each rejected document is marked already; it is counted on.
    """
    bad = np.flatnonzero(y == 0)
    own = [_grams(raw[at[r] : at[r + 1]], n) for r in bad]
    grams, hits = np.unique(np.concatenate(own), return_counts=True)
    grams = grams[hits >= 3]
    if not len(grams):
        return []

    def known(codes: np.ndarray) -> np.ndarray:
        slot = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        return slot[grams[slot] == codes]

    good = np.zeros(len(grams))
    for r in np.flatnonzero(y != 0):
        good[known(_grams(raw[at[r] : at[r + 1]], n))] += 1
    found = [known(codes) for codes in own]
    slot, row = np.concatenate(found), np.repeat(np.arange(len(bad)), [len(f) for f in found])
    ratio = max(1.0, (len(y) - len(bad)) / len(bad))
    out: list[int] = []
    cost = 4 * good / ratio
    for _ in range(count):
        gain = np.bincount(slot, 0.5 ** covered[row], minlength=len(grams)) - cost
        best = int(gain.argmax())
        if gain[best] < 1.5:
            break
        out.append(int(grams[best]))
        cost[best] = np.inf
        covered[row[slot == best]] += 1
    return out


def fit(texts: pa.Array, y: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> ByteConvNet:
    """Train on whole texts; ``y`` is 1 for documents to keep.  One class only: a network that always answers it."""
    raw, at = flat(texts)
    y = np.asarray(y, np.float32)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.02, (WIDTH, 256, FILTERS)).astype(np.float32)
    b, v, c = np.full(FILTERS, 0.1, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.clip(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), -7, 7) if len(y) else 0)
    net = ByteConvNet(w, b, v, c)
    if not len(y) or y.min() == y.max():
        return net
    covered = np.zeros(int((y == 0).sum()), np.int64)
    grams = [(3, g) for g in _telling(raw, at, y, 3, FILTERS // 4, covered)]
    grams += [(WIDTH, g) for g in _telling(raw, at, y, WIDTH, FILTERS - len(grams) - 2, covered)]
    for f, (n, gram) in enumerate(grams):
        for k in range(n):
            net.w[k, gram >> 8 * (n - 1 - k) & 255, f] += 1
        net.b[f] = 0.5 - n
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w", net.w), ("b", net.b), ("v", net.v), ("c", np.zeros(1, np.float32)))}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    step = 0
    size = np.diff(at)
    epochs = max(epochs, -(-STEPS // -(-len(y) // 128)))  # a small sample is seen more often
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            rows = np.sort(order[i : i + 128])
            part = np.concatenate([raw[at[r] : at[r + 1]] for r in rows])
            offsets = np.r_[0, np.cumsum(size[rows])]
            top, row, arg, pad = net.pooled(part, offsets, where=True)
            x = net.features(top, row, len(rows))
            p = 1 / (1 + np.exp(-(x @ net.v + net.c)))
            dz = (p - y[rows]) * weight[rows] / len(rows)
            dx = dz[:, None] * net.v
            # the maximum's gradient goes to the chunk that has it, the mean's to every chunk
            chunks = np.bincount(row, minlength=len(rows))
            dtop = dx[row, FILTERS:] / chunks[row][:, None] + dx[row, :FILTERS] * (top == x[row, :FILTERS])
            dtop = dtop * (top > 0)
            gw = np.zeros_like(net.w)
            f = np.broadcast_to(np.arange(FILTERS), arg.shape)
            live = dtop != 0
            for k in range(WIDTH):
                np.add.at(gw[k], (pad[arg[live] + k], f[live]), dtop[live])
            grads = {"w": gw, "b": dtop.sum(0), "v": x.T @ dz + 1e-5 * net.v, "c": np.array([dz.sum()], np.float32)}
            step += 1
            lr = {"w": rate / 4, "b": rate / 4, "v": rate * 5, "c": rate * 5}
            for name, g in grads.items():
                m, s = state[name]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                move = lr[name] * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
                if name == "c":
                    net.c -= float(move[0])
                elif name == "w":
                    net.w -= np.where(g != 0, move, 0)
                elif name == "v":  # filters are evidence against a document only: a short clean text lacks nothing
                    net.v = np.minimum(net.v - move, 0)
                else:
                    net.b -= move
    return net


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ByteConvNet:
    """Fit on at most ``sample`` labelled documents of ``docs`` and at most ``sample_bytes`` of their text (both bounds documented parameters).

    The sample is drawn by the hash of the id.  A document is one to keep if its quality is 1 and it is not toxic;
    labels without quality are left out, a null ``toxic`` counts as 0; of several labels of one id the least counts.
    Whole texts are used for fitting, never parts of them: a text of more than 1/16 of ``sample_bytes``, or one that
    doesn't fit into what is left of them, is skipped, and the next one is tried.
    """
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.min(good).alias("y"))
    chosen = marks.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most ``sample`` rows of 12 bytes
    rows = rows.where(F.octet_length("text") <= sample_bytes // 16).select("doc_id", "text", "y")
    left = sample_bytes
    got: dict[str, list] = {"text": [], "y": []}
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)
    for r in table.toLocalIterator():
        size = len(r.text.encode())
        if size > left:
            continue
        left -= size
        got["text"].append(r.text)
        got["y"].append(r.y)
    return fit(pa.array(got["text"], pa.string()), np.array(got["y"], np.float32))


def probability(net: ByteConvNet):
    """A function of a text column: the probability that a document is worth keeping; null and empty texts get that of no evidence."""
    weights = (net.w, net.b, net.v, net.c)

    @F.pandas_udf("double")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ByteConvNet(*weights)
        tables = own._tables()
        for text in columns:
            column = pa.array(text, pa.string(), from_pandas=True)
            out = np.zeros(len(column))
            for a, b in pieces(column, 1 << 20):
                out[a:b] = own.predict(*flat(column[a:b]), tables=tables)
            yield pd.Series(out)

    return run


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality_p, keep) of every row of ``docs``; ``keep`` is quality_p >= threshold, so a tie is kept.

    Null texts count as empty ones; very long texts are scored whole.  Null and repeated ids and rows: one result row
    each.  No usable label: every probability is 1/2, all are kept.  Empty table: empty result.  Columns other than
    ``doc_id`` and ``text`` are not read, whatever their names.
    """
    net = train(docs, labels, sample=sample)
    return docs.select("doc_id", probability(net)("text").alias("quality_p")).select("doc_id", F.round("quality_p", 6).alias("quality_p"), (F.col("quality_p") >= threshold).alias("keep"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
