"""Toxic passages as maximum-scoring segments over token log-odds.

A token's score is the log-odds ratio of the toxic and other texts that have it, under an
informative Dirichlet prior (the pooled counts), less a drift, so that ordinary text scores
below zero. A linear-time scan finds every maximal scoring segment of a whole text. A
segment's extreme-value statistic, lambda * score - log(K * tokens), tells how rarely
ordinary text of that length has one; lambda solves the Karlin-Altschul equation for the
ordinary token distribution and K is fitted to the best segments of ordinary texts. The best
and the summed statistics of a text's significant segments are calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTER, bucket_of, hash_spans, sums_between, text_buffer, training_rows, word_spans

FOLDS, HELD = 5, 0
#: Bounds of the fitted model: labelled rows, and tokens with a score of their own.
SAMPLE, TERMS = 20_000, 65_536
#: The prior's mass as a share of all counts; drift a token; least |z| of a token that scores above the drift.
PRIOR, DRIFT, LEAST_Z = 0.05, 0.25, 3.0
#: A segment is significant if ordinary text has one like it with at most this chance.
ALPHA = 0.05


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order: each has a
    positive score, none can be lengthened or shortened to more. Time is linear; runs of
    tokens below zero are crossed in one step."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    found: list[list] = []  # start, end, sum before it, sum up to its end, index of the last one with a smaller sum before
    for t in np.flatnonzero(values > 0).tolist():
        cur = [t, t + 1, total[t], total[t + 1], -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= cur[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= cur[3]:
                break
            cur[0], cur[2] = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        cur[4] = j
        found.append(cur)
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


def token_model(counts: list[tuple[int, int, int]], n0: int, n1: int) -> dict:
    """Scores of tokens from (hash, count in other texts, count in toxic texts)."""
    model = {"hash": np.zeros(1, np.uint64), "value": np.full(1, -DRIFT), "other": -DRIFT}
    if not counts or not n0 or not n1:
        return model
    h = np.array([c[0] for c in counts], np.int64).view(np.uint64)
    y0, y1 = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float)
    prior, mass = PRIOR * (y0 + y1), PRIOR * (n0 + n1)
    odds = np.log((y1 + prior) / (n1 + mass - y1 - prior)) - np.log((y0 + prior) / (n0 + mass - y0 - prior))
    spread = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - spread, 0)  # what one deviation leaves of it
    value = np.where(odds >= LEAST_Z * spread, sure, np.where(odds <= -LEAST_Z * spread, 0.1 * sure, 0)) - DRIFT
    order = np.argsort(h)
    return {"hash": h[order], "value": value[order], "other": -DRIFT}


def token_values(col: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores, byte starts and byte ends of all tokens (runs of letters, A-Z lower-cased), and each text's offsets among them."""
    data, off = text_buffer(col)
    start, end, at = word_spans(data, off, NOT_LETTER)
    h = hash_spans(data, start, end)
    k = np.minimum(np.searchsorted(model["hash"], h), len(model["hash"]) - 1)
    return np.where(model["hash"][k] == h, model["value"][k], model["other"]), start, end, at


def karlin_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weight * exp(lambda * value)) = 1; values have a negative mean."""
    low, high = 0.0, 1.0
    total = lambda x: float(weights @ np.exp(np.minimum(x * values, 500)))
    if not (values[weights > 0] > 0).any():
        return 1.0
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def statistics(col: pa.Array, model: dict) -> list[list[tuple[int, int, float]]]:
    """For each text its significant segments: byte start, byte end, extreme-value statistic."""
    values, start, end, at = token_values(col, model)
    data, off = text_buffer(col)
    least = -np.log(-np.log1p(-ALPHA))
    out = []
    hot = sums_between(values > 0, at)
    for i in range(len(at) - 1):
        found = []
        if hot[i]:
            a, b = at[i], at[i + 1]
            shift = np.log(max(model["k"] * (b - a), 1e-9))
            for x, y, s in segments(values[a:b]):
                stat = model["lambda"] * s - shift
                if stat >= least:
                    found.append((int(start[a + x] - off[i]), int(end[a + y - 1] - off[i]), float(stat)))
        out.append(found)
    return out


def _summary(found: list[list[tuple[int, int, float]]]) -> np.ndarray:
    best = np.array([max((s for *_, s in f), default=0.0) for f in found])
    total = np.array([sum(s for *_, s in f) for f in found])
    return np.column_stack([np.log1p(np.maximum(best, 0)), np.log1p(np.maximum(total, 0)), np.array([len(f) > 0 for f in found], float)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> dict:
    """Fits on at most ``sample`` labelled rows outside the held-out fold. The driver gets the
    counts of at most ``terms`` tokens, those that tell the classes apart most, and three
    numbers a sampled row. Without both classes every token scores below zero and the score is
    the smoothed share of label 1."""
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD, sample)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(b.column("text"))
            start, end, at = word_spans(data, off, NOT_LETTER)
            h = hash_spans(data, start, end)
            own = [np.unique(h[x:y]) for x, y in zip(at[:-1], at[1:])]  # once a text: a word said over and over is no stronger sign
            toxic = np.repeat(b.column("y").to_numpy(zero_copy_only=False).astype(np.int64) == 1, [len(x) for x in own])
            key, inv = np.unique(np.concatenate([*own, h[:0]]), return_inverse=True)
            n, n1 = np.bincount(inv, minlength=len(key)), np.bincount(inv[toxic], minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n - n1), pa.array(n1)], names=["h", "n0", "n1"])

    counts = rows.mapInArrow(tokens, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all0, all1 = (int(v or 0) for v in counts.agg(F.sum("n0"), F.sum("n1")).first())
    gap = F.abs(F.log((F.col("n1") + 0.5) / max(all1, 1)) - F.log((F.col("n0") + 0.5) / max(all0, 1)))
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    top = counts.orderBy((gap / spread).desc(), "h").limit(terms).collect()
    model = token_model([tuple(r) for r in top], all0, all1)
    seen = {r.h: r.n0 for r in top}
    w = np.array([seen.get(int(h), 0) for h in model["hash"].view(np.int64)], float)
    rest = max(all0 - w.sum(), 0)
    weights = np.concatenate([w, [rest]]) / max(w.sum() + rest, 1)
    model["lambda"] = karlin_lambda(np.concatenate([model["value"], [model["other"]]]), weights)
    model["k"] = 1.0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, _, _, at = token_values(b.column("text"), model)
            hot = sums_between(values > 0, at)
            top = [max((s for *_, s in segments(values[x:y])), default=0.0) if h else 0.0 for x, y, h in zip(at[:-1], at[1:], hot)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(top, pa.float64()), pa.array(np.diff(at)), b.column("doc_id")], names=["y", "best", "n", "doc_id"])

    stats = sorted(tuple(r) for r in rows.mapInArrow(best, "y int, best double, n long, doc_id long").collect())
    plain = [(model["lambda"] * s, n) for y, s, n, _ in stats if y != 1 and n]
    if plain:  # the median of a Gumbel law fixes K on ordinary texts
        s, n = np.array(plain).T
        model["k"] = float(np.exp(np.median(s - np.log(n)) + np.log(np.log(2))))
        model["k"] = min(max(model["k"], 1e-4), 1.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _summary(statistics(b.column("text"), model))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("y"), b.column("doc_id")], names=["x", "y", "doc_id"])

    got = sorted((r.doc_id, r.y, tuple(r.x)) for r in rows.mapInArrow(measured, "x array<double>, y int, doc_id long").collect())
    y = np.array([float(r[1] == 1) for r in got])
    if len(np.unique(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model["weights"] = np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])
    else:
        model["weights"] = _logistic(np.array([r[2] for r in got]), y)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) of every row; passages are the
    significant segments by byte offsets in the UTF-8 text with their statistic. Null and empty
    texts have no passage. The model's size is bounded by its number of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = statistics(b.column("text"), model)
            x = _summary(found)
            p = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stat", pa.float64())]))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(p, pa.float64()),
                pa.array([[{"start": s, "end": e, "stat": v} for s, e, v in f] for f in found], kind)], names=["doc_id", "score", "passages"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, score double, passages array<struct<start:long,end:long,stat:double>>")
    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      F.size("passages").cast("long").alias("n_passages"), "passages")
