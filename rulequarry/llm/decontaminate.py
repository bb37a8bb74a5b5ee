"""Benchmark decontamination by q-gram lemma filtering.

A benchmark passage is covered by overlapping windows (``WINDOW`` bytes, every ``STEP`` bytes, the last one flush
with the end; a shorter passage is one window).  A document is contaminated by a window if some part of it is within
``k = floor(RATE * length)`` edits of the window.  By the q-gram lemma such a part shares at least
``length - Q + 1 - k * Q`` of the window's q-grams, and because k edits move an alignment by at most k diagonals, all
of them lie in one of the overlapping diagonal bands of 2 (k + 1) diagonals that start at every multiple of k + 1.
Bands that reach the bound are verified by alignment inside the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import PIECE, U64, flat, pieces, read

Q, RATE, WINDOW, STEP = 8, 0.08, 80, 20
CHUNK_BYTES = 8 << 20  # benchmark text that one pass over the documents holds in memory


def normalised(column: pa.Array) -> pa.Array:
    """Lower case, every run of white space as one space."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"\s+", " "))


def windows(length: int) -> list[tuple[int, int]]:
    if length <= WINDOW:
        return [(0, length)] if length else []
    starts = list(range(0, length - WINDOW + 1, STEP))
    if starts[-1] != length - WINDOW:
        starts.append(length - WINDOW)
    return [(s, s + WINDOW) for s in starts]


def budget(length: int) -> int:
    """Edits that a window of this length may have: RATE, but never so many that no shared q-gram is certain."""
    return max(0, min(int(RATE * length), (length - Q) // Q))


def band_edits(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text`` along the diagonals ``low`` to ``high``, and that part's end.

    A diagonal is a position in the text less one in the pattern, so row i of the table has the ends i + low to i + high
    only.  A row is one vector operation, insertions by a running minimum; k + 1 stands for more than k edits.
    """
    width, n = high - low + 1, len(text)
    step = np.arange(width)
    at = low + step  # ends in the text
    row = np.where((at >= 0) & (at <= n), 0, k + 1)
    base = abs(low) + 1
    padded = np.full(base + max(n, len(pattern) + high, 0) + 2, -1, np.int16)
    padded[base : base + n] = text
    for i, c in enumerate(pattern.tolist(), 1):
        at = i + low + step
        new = row + (padded[base + i + low - 1 : base + i + low - 1 + width] != c)  # along the diagonal
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])  # a byte of the pattern left out
        new = np.minimum.accumulate(new - step) + step  # bytes of the text left out
        new[(at < 0) | (at > n)] = k + 1
        row = np.minimum(new, k + 1)
        if row.min() > k:
            return k + 1, 0
    spot = int(row.argmin())
    return int(row[spot]), len(pattern) + low + spot


class Index:
    """The q-grams of a set of benchmark passages."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.text = [np.frombuffer(t, np.uint8) for _, t in items]
        spans = [(n, *w) for n, t in enumerate(self.text) for w in windows(len(t))]
        self.win = np.array(spans, np.int64).reshape(-1, 3)
        self.k = np.array([budget(b - a) for _, a, b in spans], np.int64)
        self.need = np.array([b - a - Q + 1 - k * Q for (_, a, b), k in zip(spans, self.k.tolist())], np.int64)
        grams, owner, offset = [], [], []
        for w, (n, a, b) in enumerate(spans):
            code = _grams(self.text[n][a:b])
            grams.append(code)
            owner.append(np.full(len(code), w))
            offset.append(np.arange(len(code)))
        code = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.offset = code[order], *(np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (owner, offset))
        self.keys, self.first = np.unique(self.code, return_index=True)
        self.count = np.diff(np.r_[self.first, len(self.code)])
        self.seen = np.zeros(1 << 22, bool)
        self.seen[_slot(self.keys)] = True
        whole = np.array([b - a >= Q for _, a, b in spans], bool)
        self.least = max(1, int(self.need[whole].min())) if whole.any() else 1
        self.reach = int((self.win[whole, 2] - self.win[whole, 1] + self.k[whole]).max()) - Q + 1 if whole.any() else 1
        # windows shorter than a q-gram: found as exact substrings
        self.short = [w for w, (_, a, b) in enumerate(spans) if b - a < Q]

    def matches(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, window, start, end, edits) of verified windows, positions within the row."""
        code = _grams(raw)
        # first the bound without regard to diagonals: a match of any window has so many of its q-grams in so short a stretch
        mark = self.seen[_slot(code)]
        upto = np.zeros(len(code) + 1, np.int32)
        np.cumsum(mark, out=upto[1:])
        reach, least = self.reach, self.least
        if len(code) > reach:
            dense = np.flatnonzero(upto[reach:] - upto[:-reach] >= least)
            edge = np.zeros(len(code) + 1, np.int32)
            np.add.at(edge, dense, 1)
            np.subtract.at(edge, np.minimum(dense + reach, len(code)), 1)
            mark &= np.cumsum(edge[:-1]) > 0
        pos = np.flatnonzero(mark)
        if len(pos):
            key = np.searchsorted(self.keys, code[pos])
            key[key == len(self.keys)] = 0
            same = self.keys[key] == code[pos]
            pos, key = pos[same], key[same]
            row = np.searchsorted(at, pos, side="right") - 1
            inside = pos + Q <= at[row + 1]
            pos, key, row = pos[inside], key[inside], row[inside]
            n = self.count[key]
            pair = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[key], n)
            pos, row = np.repeat(pos, n), np.repeat(row, n)
            win, off = self.owner[pair], self.offset[pair]
            diagonal = pos - at[row] - off + (1 << 20)
            width = self.k[win] + 1
            band = diagonal // width
            hits = np.concatenate([np.stack([row, win, band, off], 1), np.stack([row, win, band - 1, off], 1)])
            # a q-gram of the window counts once in a band
            order = np.lexsort(hits.T[::-1])
            hits = hits[order]
            new = np.any(hits[1:] != hits[:-1], axis=1)
            hits = hits[np.r_[True, new]] if len(hits) else hits
            at_ = np.flatnonzero(np.r_[True, np.any(hits[1:, :3] != hits[:-1, :3], axis=1)]) if len(hits) else np.zeros(0, np.int64)
            total = np.diff(np.r_[at_, len(hits)])
            good = total >= np.maximum(self.need[hits[at_, 1]], 1) if len(at_) else np.zeros(0, bool)
            for r, w, b, _ in hits[at_[good]].tolist():
                k = int(self.k[w])
                d = b * (k + 1) - (1 << 20)
                n, x, y = self.win[w].tolist()
                # a q-gram on a diagonal of the band leaves its alignment at most k diagonals on either side
                low, high = d - k, d + 2 * (k + 1) - 1 + k
                lo, hi = max(0, low), min(int(at[r + 1] - at[r]), high + (y - x))
                pattern, part = self.text[n][x:y], raw[at[r] + lo : at[r] + hi]
                spot = part.tobytes().find(pattern.tobytes())  # most copies are verbatim
                edits, end = (0, spot + y - x) if spot >= 0 else band_edits(pattern, part, low - lo, high - lo, k)
                if edits <= k:
                    yield r, w, max(0, lo + end - (y - x) - edits), lo + end, edits
        for w in self.short:
            n, x, y = self.win[w].tolist()
            what, whole = self.text[n][x:y].tobytes(), raw.tobytes()
            spot = whole.find(what)
            while spot >= 0:
                r = int(np.searchsorted(at, spot, side="right")) - 1
                end = spot + len(what)
                # as a word of its own: no letter, digit or byte of a longer character next to it
                if end <= at[r + 1] and not (spot > at[r] and _WORD[whole[spot - 1]] and _WORD[what[0]]) and not (end < at[r + 1] and _WORD[whole[end]] and _WORD[what[-1]]):
                    yield r, w, int(spot - at[r]), int(end - at[r]), 0
                    spot = whole.find(what, int(at[r + 1]))
                else:
                    spot = whole.find(what, spot + 1)


_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def _grams(raw: np.ndarray) -> np.ndarray:
    """The Q bytes that start at each position, as one number."""
    if len(raw) < Q:
        return np.zeros(0, U64)
    two = raw[:-1].astype(U64) | raw[1:].astype(U64) << U64(8)
    four = two[:-2] | two[2:] << U64(16)
    return four[:-4] | four[4:] << U64(32)


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * U64(0x9E3779B97F4A7C15)) >> U64(42)).astype(np.int64)


def benchmark_chunks(benchmark: DataFrame, most: int = CHUNK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The passages in parts of at most ``most`` bytes, streamed through the driver."""
    part, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("i"), "text").distinct().orderBy("i", "text")
    for row in rows.toLocalIterator():
        text = normalised(pa.array([row.text])).to_pylist()[0].encode()
        if size + len(text) > most and part:
            yield part
            part, size = [], 0
        if text:
            part.append((row.i, text))
            size += len(text)
    if part:
        yield part


def contaminations(docs: DataFrame, benchmark: DataFrame, *, most: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, stop, windows, edits): documents that hold a passage of the benchmark or a part of it.

    start and stop are bytes of the normalised text and span all matching windows of the item; edits is the least of
    theirs.  A benchmark that is larger than ``most`` bytes is taken in parts, one pass over the documents each.
    Null or empty documents and passages match nothing; very long ones are searched whole, a long passage by each of its
    windows.  A passage shorter than 8 bytes must occur exactly and as a word or words of its own.  Ties: of equally
    good places of a window the first in its band counts; items of equal id and text count once, those of equal text and
    another id each.  Null and repeated ids of documents are kept, a result row for each.  Empty table: empty result.
    Columns other than the ids and texts are not read, whatever their names.
    """
    schema = "doc_id bigint, item_id bigint, start bigint, stop bigint, windows bigint, edits bigint"

    def scan(items: list[tuple[int, bytes]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                for a, b in pieces(batch.column(1), 2 << 20, 1 << 20):
                    raw, at = flat(normalised(batch.column(1)[a:b]))
                    found: dict[tuple, list] = {}
                    for r, w, start, stop, edits in index.matches(raw, at):
                        n = int(index.win[w, 0])
                        have = found.setdefault((r, n), [start, stop, set(), edits])
                        have[:2] = min(have[0], start), max(have[1], stop)
                        have[2].add(w)
                        have[3] = min(have[3], edits)
                    if found:
                        ids = batch.column(0)
                        rows = [(ids[a + r].as_py(), index.ids[n], s, e, len(w), d) for (r, n), (s, e, w, d) in sorted(found.items())]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "start", "stop", "windows", "edits"])

        return run

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    out = None
    for part in benchmark_chunks(benchmark, most):
        found = rows.mapInArrow(scan(part), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def free_rows(index: Index, column: pa.Array) -> np.ndarray:
    """Which texts of a column hold no window of the index; whole texts, ``PIECE`` bytes of them at a time or one longer text."""
    out = np.ones(len(column), bool)
    for a, b in pieces(column, PIECE, 1 << 20):
        for r, *_ in index.matches(*flat(normalised(column[a:b]))):
            out[a + r] = False
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, most: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; all columns are kept.  Nulls: see ``contaminations``."""
    def free_of(part: list[tuple[int, bytes]]):
        @F.arrow_udf("boolean")
        def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = Index(part)
            for column in columns:
                yield pa.array(free_rows(index, column))

        return clean("text")

    for part in benchmark_chunks(benchmark, most):
        docs = docs.where(free_of(part))
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
