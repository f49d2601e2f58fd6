"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``MIN_EXPONENT`` periods and
``MIN_WORDS`` words long, that no neighbouring word extends. For every power of two B the text is
cut into overlapping dyadic blocks of B words (one starts at every multiple of B/2). A run whose
period lies in (B/2, B] holds such a block together with its copy one period on, and, as the
block is at least a period long, no copy lies nearer. So each block asks for its next occurrence
in the neighbouring window: the occurrences of the block are one range of the suffix array, and
the successor of its own position in that range comes from a wavelet tree over the suffix array.
The occurrences that neighbouring blocks find lie on an arithmetic progression; its difference is
the candidate period, and the stretch it covers grows word by word to its ends.

Blocks are only laid where a run may be at all: every word of a run but those of its last period
comes again within a period, so words whose next equal word is farther off than a third of the
stretch of such words around them cut it, again and again, until nothing changes.

A batch of documents is searched at once, each with word numbers of its own, so nothing is
found across documents. A document is held whole by one task; memory is in proportion to its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_EXPONENT, MIN_WORDS = 4, 6
#: Documents are searched together until they have this many words.
BATCH_WORDS = 200_000


def suffix_ranges(symbols: np.ndarray, levels: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffixes of ``symbols`` in order of their first 2^(levels-1) symbols, and for each level k the
    starts of those dyadic blocks of 2^k symbols that occur more than once, each with the range
    [low, high) of that order which begins with the block. It ends before a level on which every
    block occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    value = symbols[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    for k in range(levels):
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        low = np.empty(n, np.int64)
        high = np.empty(n, np.int64)
        low[order] = starts[group]
        high[order] = np.append(starts[1:], n)[group]
        if len(starts) == n:
            break
        half = 1 << k
        at = np.arange(0, n - half, max(1, half // 2))
        at = at[high[at] - low[at] > 1]
        found.append((at, low[at], high[at]))
        if k + 1 == levels:
            break
        after = np.zeros(n, np.int64)
        after[: n - half] = low[half:] + 1  # a suffix that ends there comes first
        key = low * (n + 1) + after
        # only suffixes whose block is not alone can still change places
        open_ = np.flatnonzero((high - low)[order] > 1)
        part = order[open_]
        order[open_] = part[np.argsort(key[part], kind="stable")]
        value = key[order]
        new = np.concatenate(([True], value[1:] != value[:-1]))
    return order, found


class WaveletTree:
    """Wavelet tree of a permutation of 0..n-1, level by level from the highest bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        cur = np.asarray(values, np.int64)
        for b in range(self.bits - 1, -1, -1):
            low = ((cur >> b) & 1) == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(low))))
            cur = np.concatenate((cur[low], cur[~low]))

    def smaller(self, left: np.ndarray, right: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values in each [left, right) are below ``than`` (which has no more bits than they)."""
        count = np.zeros(len(left), np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1)):
            zl, zr = z[left], z[right]
            one = ((than >> b) & 1) == 1
            count += np.where(one, zr - zl, 0)
            left = np.where(one, z[-1] + left - zl, zl)
            right = np.where(one, z[-1] + right - zr, zr)
        return count

    def nth(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value with the given rank (from 0) in each [left, right)."""
        out = np.zeros(len(left), np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1)):
            zl, zr = z[left], z[right]
            one = rank >= zr - zl
            rank = np.where(one, rank - (zr - zl), rank)
            out |= one.astype(np.int64) << b
            left = np.where(one, z[-1] + left - zl, zl)
            right = np.where(one, z[-1] + right - zr, zr)
        return out

    def successor(self, left: np.ndarray, right: np.ndarray, at_least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``at_least`` in each [left, right), -1 where there is none."""
        out = np.full(len(left), -1, np.int64)
        asked = np.flatnonzero(at_least < 1 << self.bits)
        rank = self.smaller(left[asked], right[asked], at_least[asked])
        some = rank < (right - left)[asked]
        asked, rank = asked[some], rank[some]
        out[asked] = self.nth(left[asked], right[asked], rank)
        return out


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pieces(words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of ``words`` that hold every run. stop: the end of each word's document."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    gap = np.full(n, n, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    flags = gap < n
    for _ in range(64):  # any number of rounds leaves all runs in
        x, y = _stretches(flags)
        size = y - x
        keep = np.repeat(size // (MIN_EXPONENT - 1), size)
        at = np.flatnonzero(flags)
        # the shortest run has period 1; without its last word it is one word shorter
        cut = at[(gap[at] > keep) | (np.repeat(size, size) < MIN_WORDS - 1)]
        if not len(cut):
            break
        flags[cut] = False
    x, y = _stretches(flags)
    return x, np.minimum(y + (y - x) // (MIN_EXPONENT - 1), stop[x])


def _candidates(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block start, block size, distance to its next occurrence) for all dyadic blocks whose
    next occurrence begins in the second half of the window of a block's length after them."""
    levels = int(longest - 1).bit_length() + 1
    order, ranges = suffix_ranges(symbols, levels)
    none = np.zeros(0, np.int64)
    if not ranges:
        return none, none, none
    tree = WaveletTree(order)
    out = []
    for k, (at, low, high) in enumerate(ranges):
        size = 1 << k
        step = tree.successor(low, high, at + 1) - at
        near = (step > size // 2) & (step <= size)
        out.append((at[near], np.full(near.sum(), size), step[near]))
    return tuple(np.concatenate(c) for c in zip(*out))


def find_runs(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run in a row of documents; ``off``: where each begins, and the
    end. Equal words have equal numbers, words of unlike documents unlike ones."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < MIN_WORDS:
        return none
    x, y = _pieces(words, np.repeat(off[1:], np.diff(off)))
    if not len(x):
        return none
    size = y - x
    home = np.repeat(np.arange(len(x)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(x, size)
    # a piece has symbols of its own: two pieces may share words of their document
    _, symbols = np.unique(home * (int(words.max()) + 1) + words[place], return_inverse=True)
    at, block, step = _candidates(symbols, int((size // MIN_EXPONENT).max()) or 1)
    if not len(at):
        return none
    at = place[at]
    by = np.lexsort((at, step))
    at, block, step = at[by], block[by], step[by]
    # blocks of one progression: the next one begins before the last one ends
    joined = (step[1:] == step[:-1]) & (at[1:] <= at[:-1] + block[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~joined)))
    last = np.append(first[1:], len(at)) - 1
    runs = set()
    for s, e, q in zip(at[first].tolist(), (at[last] + block[last]).tolist(), step[first].tolist()):
        # words s..e-1 equal those q later; both ends grow while that holds
        while True:
            lo = max(0, s - q)
            unlike = np.flatnonzero(words[lo:s] != words[lo + q : s + q])
            s = lo + int(unlike[-1]) + 1 if len(unlike) else lo
            if len(unlike) or s == 0:
                break
        while True:
            hi = min(len(words) - q, e + q)
            unlike = np.flatnonzero(words[e:hi] != words[e + q : hi + q])
            e = e + int(unlike[0]) if len(unlike) else hi
            if len(unlike) or e == len(words) - q:
                break
        if e + q - s >= max(MIN_WORDS, MIN_EXPONENT * q):
            runs.add((s, e + q - s, q))
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's documents: in a tenth of them a passage repeats with a period that
    the id fixes. A document without an id is left as it is."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _numbered(batch: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    off, base = [0], 0
    for words in batch:
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
        off.append(len(ids))
    return np.array(ids, np.int64), np.array(off, np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], rewrite: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, words, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = text.as_buffer().to_pybytes().split() if text.is_valid else []
            own = rewritten(own, doc_id) if rewrite else own
            ids.append(doc_id)
            words.append(own)
            size += len(own)
            if size >= BATCH_WORDS:
                yield ids, words
                ids, words, size = [], [], 0
    if ids:
        yield ids, words


def runs(docs: DataFrame, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period by start,
    then period), collapsed (the text's words joined by a space, without those that a run repeats:
    all that come after its first period).

    Null, empty and blank texts have no words and no runs; ``collapsed`` is empty then. Repeated rows
    and rows without an id are each a document of its own. Long texts are searched whole. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    rewrite: first lay a periodic passage into a tenth of the documents, see :func:`rewritten`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for ids, texts in _grouped(batches, rewrite):
            numbers, off = _numbered(texts)
            found = find_runs(numbers, off)
            home = np.searchsorted(off, found[:, 0], "right") - 1
            mine: dict[int, list[tuple[int, int, int]]] = {}
            for k, (s, length, q) in zip(home.tolist(), found.tolist()):
                mine.setdefault(k, []).append((s - int(off[k]), length, q))
            collapsed = []
            for k, words in enumerate(texts):
                if k in mine:
                    stay = np.ones(len(words), bool)
                    for s, length, q in mine[k]:
                        stay[s + q : s + length] = False
                    words = [words[i] for i in np.flatnonzero(stay)]
                collapsed.append(b" ".join(words))
            for i in range(0, len(ids), 512):
                part = slice(i, i + 512)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[part], pa.int64()), pa.array([len(w) for w in texts[part]], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in mine.get(k, [])] for k in range(i, min(i + 512, len(ids)))], kind),
                    pa.array(collapsed[part], pa.binary()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """What :func:`runs` gives, as numbers and digests: n_runs, the run with the greatest exponent (ties:
    smallest start, then period), and SHA-256 of the runs and of the collapsed text."""
    # length / period is exact enough: unlike quotients of numbers below 2^26 are unlike doubles
    better = lambda a, b: (a["exponent"] > b["exponent"]) | ((a["exponent"] == b["exponent"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    as_row = lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))
    rows = F.transform("runs", as_row)
    best = F.when(F.size("runs") > 0, F.aggregate(rows, rows[0], lambda acc, r: F.when(better(r, acc), r).otherwise(acc)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    said = found.withColumn("best", best)
    return said.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
