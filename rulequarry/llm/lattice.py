"""Language-model scores that sum over all subword segmentations.

A document's words (white-space separated, each with the vocabulary's word mark in front) are lattices of vocabulary
pieces.  The forward recursion alpha[t] = logsumexp over pieces ending at t of alpha[t - len] + log p(piece) gives a
word's marginal probability over all segmentations, and pieces never cross words, so a document's log probability is
the sum over its words.  The vocabulary is an existing one; its stored scores are merge ranks, not log probabilities,
so the unigram weights are estimated from all documents: every word of the corpus is counted, each distinct word is
segmented once, and its pieces count as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, _BASE, _BYTE, flat, mix64, pieces, powers, read, shared_dir, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SMOOTH = 0.5
SLICE = 20000
LONG = 64  # longer words take the recursion one by one


@cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(path: str) -> list[bytes | None]:
    """Surface bytes of every piece; None for control pieces."""
    sp = _processor(path)
    out: list[bytes | None] = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append(bytes([int(sp.id_to_piece(i)[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(None)
        else:
            out.append(sp.id_to_piece(i).encode())
    return out


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """White-space separated words of all rows, and the number of each row."""
    parts = pc.utf8_split_whitespace(column.fill_null(""))
    word = pc.list_flatten(parts)
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(word), 0)
    return word.filter(full), row[full.to_numpy(zero_copy_only=False)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0), 16 << 20, 1 << 20):
                word, _ = split_words(batch.column(0)[a:b])
                got = pc.value_counts(word)
                if len(got):
                    yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def piece_log_probabilities(docs: DataFrame, *, path: str = VOCABULARY, smooth: float = SMOOTH) -> np.ndarray:
    """Unigram log probability of every piece, from the counts of the whole corpus; -inf for control pieces.

    The driver gets one row per piece of the vocabulary, whatever the size of the corpus.
    """

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            names, times = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(names), SLICE):
                ids = sp.encode(names[i : i + SLICE], num_threads=1)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat_ids = np.fromiter((x for y in ids for x in y), np.int64, int(size.sum()))
                total += np.bincount(flat_ids, np.repeat(times[i : i + SLICE], size), len(total)).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["piece", "n"])

    got = word_counts(docs).mapInArrow(segment, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    surface = vocabulary(path)
    counts = np.full(len(surface), smooth)
    counts[got["piece"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    counts[[s is None for s in surface]] = 0
    with np.errstate(divide="ignore"):
        return np.log(counts) - np.log(counts.sum())


class Lattice:
    """Marginal log probabilities of words under a table of pieces."""

    def __init__(self, surface: list[bytes | None], logp: np.ndarray):
        best: dict[bytes, float] = {}
        for s, p in zip(surface, logp.tolist()):
            if s is not None and p > -np.inf:  # two pieces of one surface are two edges: their probabilities add
                best[s] = float(np.logaddexp(best[s], p)) if s in best else p
        self.best, self.longest = best, max(map(len, best), default=1)
        keys = np.array([self._hash(np.frombuffer(s, np.uint8)) for s in best], U64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(best.values()))[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> U64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(raw: np.ndarray) -> np.uint64:
        return mix64(np.array([(_BYTE[raw] * powers(len(raw))[::-1]).sum(dtype=U64)], U64))[0]

    def _one(self, word: bytes) -> float:
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = 0
        for t in range(1, len(word) + 1):
            for size in range(1, min(t, self.longest) + 1):
                p = self.best.get(word[t - size : t])
                if p is not None:
                    alpha[t] = np.logaddexp(alpha[t], alpha[t - size] + p)
        return float(alpha[-1])

    def words(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of each word (bytes ``raw[at[i]:at[i + 1]]``, without the mark)."""
        mark = MARK.encode()
        size = np.diff(at)
        out = np.zeros(len(size))
        long = size + len(mark) > LONG
        for i in np.flatnonzero(long):
            out[i] = self._one(mark + raw[at[i] : at[i + 1]].tobytes())
        left = np.flatnonzero(~long)
        left = left[np.argsort(-size[left], kind="stable")]  # longest first: words that are over are a suffix
        for i in range(0, len(left), SLICE):
            rows = left[i : i + SLICE]
            out[rows] = self._many(raw, at[rows], size[rows])
        return out

    def _many(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        mark = np.frombuffer(MARK.encode(), np.uint8)
        m, n = len(mark), len(size)
        width = int(size[0]) + m
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        prefix = np.zeros((width + 1, n), U64)  # polynomial hash of every prefix
        out = np.zeros(n)
        scale = powers(self.longest + 1)
        for t in range(1, width + 1):
            live = int(np.searchsorted(-size, -(t - m), side="right"))  # words of at least t bytes
            byte = np.full(live, mark[t - 1], np.uint8) if t <= m else raw[first[:live] + (t - m - 1)]
            prefix[t, :live] = prefix[t - 1, :live] * U64(_BASE) + _BYTE[byte]
            now = alpha[t]
            for length in range(1, min(t, self.longest) + 1):
                if t - length in range(1, m):
                    continue  # no piece starts inside the mark, but for byte pieces
                h = mix64(prefix[t, :live] - prefix[t - length, :live] * scale[length])
                hit = np.flatnonzero(self.seen[(h >> U64(42)).astype(np.int64)])
                if not len(hit):
                    continue
                slot = np.searchsorted(self.keys, h[hit])
                slot[slot == len(self.keys)] = 0
                same = self.keys[slot] == h[hit]
                hit, slot = hit[same], slot[same]
                now[hit] = np.logaddexp(now[hit], alpha[t - length, hit] + self.values[slot])
            if 1 < t <= m:  # byte pieces inside the mark
                p = self.best.get(bytes([mark[t - 1]]))
                if p is not None:
                    now[:live] = np.logaddexp(now[:live], alpha[t - 1, :live] + p)
            done = np.flatnonzero(size[:live] + m == t)
            out[done] = now[done]
        return out


def lattice_scores(docs: DataFrame, *, path: str = VOCABULARY, smooth: float = SMOOTH) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_byte) of every row.

    ``log_prob`` is the natural logarithm of the document's probability over all segmentations of its words.  Null,
    empty or blank text: no words, log_prob 0, bits_per_byte null.  Null and repeated ids and rows: a row each.  Very
    long words are scored whole.  Empty table: empty result.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    logp = piece_log_probabilities(docs, path=path, smooth=smooth)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(vocabulary(path), logp)
        for batch in batches:
            text = batch.column(1)
            for a, b in pieces(text, 16 << 20, 1 << 20):
                word, row = split_words(text[a:b])
                coded = word.dictionary_encode()
                value = model.words(*flat(coded.dictionary)) if len(word) else np.zeros(0)
                ids = coded.indices.to_numpy(zero_copy_only=False)
                total = np.bincount(row, value[ids], b - a) if len(word) else np.zeros(b - a)
                n = np.bincount(row, minlength=b - a)
                size = np.bincount(row, pc.binary_length(word).to_numpy(zero_copy_only=False), b - a) if len(word) else np.zeros(b - a)
                bits = pa.array(-total / np.log(2) / np.where(n > 0, size + n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n.astype(np.int64)), pa.array(total), bits], names=["doc_id", "n_words", "log_prob", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    return rows.mapInArrow(score, "doc_id bigint, n_words bigint, log_prob double, bits_per_byte double")


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"))
