"""Secret scan by sliding-window Shannon entropy.

Candidates are the maximal runs of token characters (letters, digits, ``+ / _ -``) of at least ``WINDOW``
characters.  For each character class, a window slides over every maximal run of class characters inside a
candidate; the window's entropy is kept up to date by adding one character and removing one (counts and the sum
of c * log2 c), for all runs at once.  A candidate is reported if the greatest window entropy of one of its runs
reaches the class's threshold, unless the allow list suppresses it.  The allow list has three parts, and each can be
switched off: patterns of whole candidates, fillers that are cut out of a candidate, so that what stands beside them
still counts, and windows of letters or of digits alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import flat, pieces, read

WINDOW = 16
# class: (its characters, least window entropy in bits); 16 random characters have about 3.2 bits in hex, 3.7 and more in the others
CLASSES = {
    "hex": (b"0123456789abcdefABCDEF", 2.6),
    "upper": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.1),
    "base64": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.4),
}
# words, numbers, UUIDs, file names and path-like words are no secrets
ALLOW = (
    r"^[^0-9]+$", r"^[^a-zA-Z]+$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?:[a-zA-Z]+[/_-])+[a-zA-Z]*\d{0,4}$", r"^[a-zA-Z]+\d{0,4}$",
)
# documented samples and repeated or counted characters
FILLERS = r"EXAMPLE|(?i:sample|dummy|placeholder|changeme|your[_-])|(.)\1{7,}|0123456789|(?i:abcdefghij)"


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; none crosses one of ``breaks``."""
    start, stop = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    stop[:-1] &= ~mask[1:]
    inner = breaks[(breaks > 0) & (breaks < len(mask))]
    start[inner] |= mask[inner]
    stop[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


_CLOG = np.concatenate(([0.0], np.arange(1, 4097) * np.log2(np.arange(1, 4097))))


def window_entropy(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int = WINDOW, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Greatest entropy over the windows of each run (-1 if none), and where it starts; ``mixed``: over those that hold a letter and a digit.

    Counts and the sum of c * log2(c) are updated by one character in and one out, for all runs side by side.
    """
    n = len(start)
    best, where = np.full(n, -1.0), start.copy()
    if not n:
        return best, where
    order = np.argsort(start - stop, kind="stable")  # longest first: runs that ended are a suffix
    s, length = start[order], (stop - start)[order]
    counts = np.zeros((n, 256), np.int16)
    total, digits, letters = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
    is_digit, is_letter = _mask(b"0123456789"), _mask(bytes(range(65, 91)) + bytes(range(97, 123)))
    top, at = np.full(n, -1.0), s.copy()
    live = n
    for t in range(int(length[0])):
        live = int(np.searchsorted(-length[:live], -t, side="left"))
        rows = np.arange(live)
        new = raw[s[:live] + t]
        c = counts[rows, new]
        total[:live] += _CLOG[c + 1] - _CLOG[c]
        counts[rows, new] = c + 1
        digits[:live] += is_digit[new]
        letters[:live] += is_letter[new]
        if t >= window:
            old = raw[s[:live] + t - window]
            c = counts[rows, old]
            total[:live] += _CLOG[c - 1] - _CLOG[c]
            counts[rows, old] = c - 1
            digits[:live] -= is_digit[old]
            letters[:live] -= is_letter[old]
        if t >= window - 1:
            bits = np.log2(window) - total[:live] / window
            if mixed:
                bits[(digits[:live] == 0) | (letters[:live] == 0)] = -1.0
            better = bits > top[:live] + 1e-9
            top[:live][better] = bits[better]
            at[:live][better] = s[:live][better] + t - window + 1
    best[order], where[order] = top, at
    return best, where


def _scan(raw: np.ndarray, at: np.ndarray, allow: list[re.Pattern[str]], filler: re.Pattern[str] | None):
    """(row, start, stop, text, runs by class) of every candidate that the allow list leaves."""
    token = _mask(CLASSES["base64"][0])
    start, stop = _runs(token[raw], at)
    keep = stop - start >= WINDOW
    start, stop = start[keep], stop[keep]
    row = np.searchsorted(at, start, side="right") - 1
    for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
        word = raw[a:b]
        text = word.tobytes().decode("ascii")
        if any(p.search(text) for p in allow):
            continue
        cut = np.ones(b - a, bool)
        for m in filler.finditer(text) if filler else ():
            cut[m.start() : m.end()] = False
        found = []
        for name, (chars, least) in CLASSES.items():
            s, e = _runs(_mask(chars)[word] & cut, np.zeros(0, np.int64))
            long = e - s >= WINDOW
            if long.any():
                found.append((name, least, s[long] + a, e[long] + a))
        if found:
            yield int(row[i]), a, b, text, found


def entropy_secrets(docs: DataFrame, *, allow: tuple[str, ...] = ALLOW, fillers: str = FILLERS, mixed: bool = True) -> DataFrame:
    """(doc_id, start, length, class, entropy, sha256) of every secret-like token; start in bytes of the UTF-8 text.

    At most one row per candidate: the class with the greatest excess of entropy over its threshold; of classes that
    tie, the first of ``CLASSES``.  The token itself is not returned, only its digest.  ``allow``: patterns of candidates
    to leave out; ``fillers``: one pattern of what is cut out of the others, "" for nothing; ``mixed``: whether a window
    needs a letter and a digit.  Null or empty text: no row; very long texts and candidates are scanned whole.  Repeated
    rows: their rows repeat.  Null id: kept.  Empty table: empty result.  Columns other than ``doc_id`` and ``text`` are
    not read, whatever their names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, filler = [re.compile(a) for a in allow], re.compile(fillers) if fillers else None
        for batch in batches:
            for a, b in pieces(batch.column(1), 4 << 20, 1 << 20):
                raw, at = flat(batch.column(1)[a:b])
                found = list(_scan(raw, at, rules, filler))
                runs = [(k, name, least, s, e) for k, f in enumerate(found) for name, least, ss, ee in f[4] for s, e in zip(ss, ee)]
                if not runs:
                    continue
                best, where = window_entropy(raw, np.array([r[3] for r in runs]), np.array([r[4] for r in runs]), mixed=mixed)
                top: dict[int, tuple] = {}
                for (k, name, least, *_), bits in zip(runs, best.tolist()):
                    if bits >= least and (k not in top or bits - least > top[k][0]):
                        top[k] = (bits - least, name, bits)
                ids = batch.column(0)
                rows = [(ids[a + found[k][0]].as_py(), found[k][1] - int(at[found[k][0]]), found[k][2] - found[k][1], name, round(bits, 4), hashlib.sha256(found[k][3].encode()).hexdigest()) for k, (_, name, bits) in top.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()))], names=["doc_id", "start", "length", "class", "entropy", "sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    return rows.mapInArrow(scan, "doc_id bigint, start bigint, length bigint, class string, entropy double, sha256 string")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets(read(spark, sf_dir, "documents"))
