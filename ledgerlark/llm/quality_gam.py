"""Quality scores by a generalised additive model with pairwise interactions.

Twelve features of a whole text are cut into quantile bins. Cyclic boosting visits the
features in turn and adds a shallow tree over one feature's bins to that feature's lookup
table; the pairs that still explain most of the residual get tables of their own the same
way. A score is the logistic of a sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, hash_spans, share, shingles, sums_between, text_buffer, training_rows, word_spans

FEATURES = ("log_words", "word_bytes", "symbols", "upper", "digits", "punctuation", "distinct_words", "same_as_before", "repeated_windows", "repeated_lines", "words_a_line", "top_word")
FOLDS, HELD = 5, 0
#: Bounds the labelled rows the model is fitted on.
SAMPLE = 20_000


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _PUNCT = _flags("#*$%&|<>!=~^"), _flags(".,;:?'\"()")
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True


def features(col: pa.Array) -> np.ndarray:
    """(texts, 12) features; a null or blank text has zeros."""
    data, off = text_buffer(col)
    start, end, at = word_spans(data, off)
    h = hash_spans(data, start, end)
    n = np.diff(at)
    solid = sums_between(end - start, at)
    distinct, top, windows, lines, dup_lines = (np.zeros(len(n)) for _ in range(5))
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[at[:-1][n > 0]] = False
    cuts = np.flatnonzero(data == 10)
    line_at = np.searchsorted(cuts, off)
    for i in range(len(n)):
        if not n[i]:
            continue
        w = h[at[i] : at[i + 1]]
        counts = np.unique(w, return_counts=True)[1]
        distinct[i], top[i] = len(counts), counts.max()
        windows[i] = max(0, n[i] - 2) - len(shingles(w, 3)) if n[i] > 2 else 0
        own = cuts[line_at[i] : line_at[i + 1]]
        # a line is known by its words: their hashes between two cuts, summed
        first = np.unique(np.searchsorted(start, np.concatenate(([off[i]], own))) - at[i])
        first = first[first < n[i]]
        sums = np.add.reduceat(w * np.uint64(0x9E3779B97F4A7C15) ^ (w >> np.uint64(7)), first)
        lines[i], dup_lines[i] = len(sums), len(sums) - len(np.unique(sums))
    of = lambda table: share(sums_between(table[data], off), solid)
    return np.column_stack([
        np.log1p(n), share(solid, n), of(_SYMBOL), of(_UPPER), of(_DIGIT), of(_PUNCT), share(distinct, n),
        share(sums_between(same, at), n), share(windows, n), share(dup_lines, lines), np.log1p(share(n, lines)), share(top, n)])


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, "right")


def _edges(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 2.0) -> np.ndarray:
    """Leaf values over ordered bins of the best tree with up to ``leaves`` leaves, split greedily."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), int(at[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over a grid of bins: one split of the rows, then one of the columns on each side."""
    rows_g, rows_h = g.sum(1), h.sum(1)
    first = _tree(rows_g, rows_h, 2)
    out = np.zeros_like(g)
    for part in np.unique(first):
        side = first == part
        out[side] = _tree(g[side].sum(0), h[side].sum(0), 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pairs: int = 6, pair_bins: int = 12) -> dict:
    """Lookup tables of single features and of the strongest pairs. Without rows the score is 0.5;
    with one class it is that class's smoothed share."""
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, float)
    edges = [_edges(c, bins) if len(c) else np.zeros(0) for c in x.T]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = {"base": base, "edges": edges, "tables": [np.zeros(len(e) + 1) for e in edges], "pairs": []}
    if len(np.unique(y)) < 2:
        return model
    at = [_bins(c, e) for c, e in zip(x.T, edges)]
    raw = np.full(len(y), base)

    def slopes(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size)

    for _ in range(rounds):
        for f, where in enumerate(at):
            step = rate * _tree(*slopes(where, len(model["tables"][f])), leaves=3)
            model["tables"][f] += step
            raw += step[where]
    coarse = [_edges(c, pair_bins) for c in x.T]
    small = [_bins(c, e) for c, e in zip(x.T, coarse)]
    found = []
    for i in range(len(FEATURES)):
        for j in range(i + 1, len(FEATURES)):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            g, h = (v.reshape(shape) for v in slopes(small[i] * shape[1] + small[j], shape[0] * shape[1]))
            value = _pair_tree(g, h)
            found.append((float((2 * g * value - h * value**2).sum()), i, j))
    for _, i, j in sorted(found, reverse=True)[:pairs]:
        model["pairs"].append([i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))])
    for _ in range(rounds // 2):
        for i, j, _, _, table in model["pairs"]:
            where = small[i] * table.shape[1] + small[j]
            step = rate * _pair_tree(*(v.reshape(table.shape) for v in slopes(where, table.size)))
            table += step
            raw += step.ravel()[where]
    return model


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    raw = np.full(len(x), model["base"])
    for c, edges, table in zip(x.T, model["edges"], model["tables"]):
        raw += table[_bins(c, edges)]
    for i, j, ei, ej, table in model["pairs"]:
        raw += table[_bins(x[:, i], ei), _bins(x[:, j], ej)]
    return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits on at most ``sample`` labelled rows outside the held-out fold; the driver gets their
    twelve features and label only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(b.column("text"))), pa.list_(pa.float64())), b.column("y"), b.column("doc_id")], names=["x", "y", "doc_id"])

    rows = training_rows(docs, labels, "quality", FOLDS, HELD, sample).mapInArrow(run, "x array<double>, y int, doc_id long")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.y, r.x))
    return fit(np.array([r.x for r in got]), np.array([r.y for r in got]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null and empty texts get the score of a
    text without words. The model is a few tables of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(features(b.column("text")), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(features(b.column("text")), model) >= least))

    return docs.mapInArrow(run, docs.schema)
