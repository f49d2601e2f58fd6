"""Language identification by a byte convolutional network trained and run in numpy.

Byte embeddings feed filters of widths 2, 3 and 4, a rectifier, max pooling over a window of
128 bytes and a softmax. Training runs on the driver over a bounded sample of labelled texts.
For scoring, embedding and filter are folded into tables: one row lookup per byte pair gives
all filters of a width at once. A whole text is cut into windows of the fixed length, which
go through the network in batches; its languages' probabilities are their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.joins import lookup

from .common import bucket_of, stable, text_buffer

FOLDS, HELD = 3, 1
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 12, 8
#: Positions at which every filter fits into a window.
SPAN = WINDOW - max(WIDTHS) + 1
#: Bounds the labelled texts, and the bytes of each, that the network is fitted on.
SAMPLE, SAMPLE_BYTES = 4_000, 512
#: Bounds the windows of those texts that an epoch goes over.
MOST_WINDOWS = 6_000


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes of all texts, the last window of a text filled up with zeros, and
    each window's text."""
    n = np.diff(off)
    count = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    at = (np.arange(len(doc)) - first[doc]) * WINDOW
    out = np.zeros((len(doc), WINDOW), np.uint8)
    size = np.minimum(n[doc] - at, WINDOW)
    full = size == WINDOW
    if full.any():
        out[full] = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[(off[doc] + at)[full]]
    for w in np.flatnonzero(~full):
        a = off[doc[w]] + at[w]
        out[w, : size[w]] = data[a : a + size[w]]
    return out, doc


class Network:
    """Weights: emb (256, EMBED), conv[w] (w, EMBED, FILTERS), bias, out."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        hidden = FILTERS * len(WIDTHS)
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (hidden, classes)), "bias": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (1 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS))
            self.p[f"shift{w}"] = np.zeros(FILTERS)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of windows x with classes y."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        e = p["emb"][x]
        hidden, tops = [], []
        for w in WIDTHS:
            z = sum(e[:, j : j + SPAN] @ p[f"conv{w}"][j] for j in range(w)) + p[f"shift{w}"]
            top = z.argmax(1)
            tops.append(top)
            hidden.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0])
        h = np.concatenate(hidden, 1)
        on = h > 0
        logits = (h * on) @ p["out"] + p["bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        g["out"], g["bias"] = (h * on).T @ q, q.sum(0)
        back = (q @ p["out"].T) * on
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"shift{w}"] = d.sum(0)
            for j in range(w):  # only the byte that won the pooling gets a gradient
                byte = x[rows, tops[k] + j]
                g[f"conv{w}"][j] = np.einsum("bfe,bf->ef", p["emb"][byte], d)
                np.add.at(g["emb"], byte.ravel(), (d[:, :, None] * p[f"conv{w}"][j].T[None]).reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                t += 1
                for k, g in self.step(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def tables(self) -> dict:
        """What scoring needs: two tables by byte pair, for the first and the last two bytes of
        the widest filters, each row holding the values of all filters side by side."""
        rows = {w: [self.p["emb"] @ self.p[f"conv{w}"][j] for j in range(w)] for w in WIDTHS}
        none = np.zeros((256, FILTERS))
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        first = np.concatenate([pair(rows[w][0], rows[w][1]) for w in WIDTHS], 1).astype(np.float32)
        last = np.concatenate([pair(rows[3][2], none), pair(rows[4][2], rows[4][3])], 1).astype(np.float32)
        shift = np.concatenate([self.p[f"shift{w}"] for w in WIDTHS])
        return {"first": first, "last": last, "shift": shift, "out": self.p["out"], "bias": self.p["bias"]}


def probabilities(x: np.ndarray, tables: dict, batch: int = 256) -> np.ndarray:
    """Softmax outputs of windows x, in batches of fixed size."""
    out = np.zeros((len(x), len(tables["bias"])))
    for a in range(0, len(x), batch):
        part = np.ascontiguousarray(x[a : a + batch].T).astype(np.int32)
        pairs = (part[:-1] << 8) | part[1:]
        z = tables["first"].take(pairs[:SPAN], 0)
        z[:, :, FILTERS:] += tables["last"].take(pairs[2 : 2 + SPAN], 0)
        hidden = np.maximum(z.max(0) + tables["shift"], 0)
        logits = hidden @ tables["out"] + tables["bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        out[a : a + batch] = q / q.sum(1, keepdims=True)
    return out


def _picked(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` of the distinct (doc_id, lang), as many of each language as of any other as far as they go, those with
    the smallest hashes of their id. Hashes that are too large for a language's share are left out before anything is
    ordered, so an order is made of some rows of each language only."""
    size = stable(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language_sizes")
    share = max(1, sample // max(1, size.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    near = lookup(rows, size, ["lang"], "inner").filter(place * F.col("n") <= 2 * share + 64)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    return near.withColumn("turn", turn).filter(F.col("turn") <= share).orderBy("turn", "lang").limit(sample).select("doc_id", "lang")


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, epochs: int = 4, most_windows: int = MOST_WINDOWS) -> dict:
    """Fits on at most ``sample`` texts that are not empty, with a language and outside the held-out fold, equally many of
    each language as far as they go, and of each on ``sample_bytes`` bytes from its middle. An epoch goes over
    ``most_windows`` windows at most, drawn so that languages are equally frequent."""
    said = docs.filter("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("raw"))
    rows = said.filter("doc_id is not null and lang is not null").filter(bucket_of(F.col("doc_id"), FOLDS) != HELD).select("doc_id", "lang")
    picked = _picked(rows.distinct(), sample)
    middle = F.greatest(F.lit(1), (F.length("raw") - sample_bytes) / 2 + 1).cast("int")
    got = said.join(F.broadcast(picked), ["doc_id", "lang"]).select("doc_id", "lang", F.expr("raw").substr(middle, F.lit(sample_bytes)).alias("raw"))
    got = sorted({(r.doc_id, r.lang, bytes(r.raw)) for r in got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).collect()})
    langs = sorted({lang for _, lang, _ in got})
    if not langs:
        return {"langs": ["und"], "network": Network(1)}
    off = np.concatenate(([0], np.cumsum([len(raw) for *_, raw in got])))
    x, doc = windows(np.frombuffer(b"".join(raw for *_, raw in got), np.uint8), off)
    y = np.array([langs.index(lang) for _, lang, _ in got])[doc]
    if len(langs) == 1:
        return {"langs": langs, "network": Network(1)}
    weight = 1 / np.bincount(y, minlength=len(langs)).clip(1)  # rare languages are drawn as often as frequent ones
    most = min(len(x), most_windows)
    at = np.random.default_rng(5).choice(len(x), size=max(most, min(3_000, 20 * len(x))), p=weight[y] / weight[y].sum())
    return {"langs": langs, "network": Network(len(langs)).fit(x[at], y[at], epochs)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row. Null texts and texts without a letter
    are ``und`` with score 0. Without labelled texts every text is ``und``."""
    langs = np.array(model["langs"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model["network"].tables()  # built once a task: the weights are far smaller
        for b in batches:
            data, off = text_buffer(b.column("text"))
            total = np.zeros((b.num_rows, len(langs)))
            count = np.zeros(b.num_rows)
            for part in np.array_split(np.arange(b.num_rows), max(1, len(data) >> 20)):
                if not len(part):
                    continue
                a, z = part[0], part[-1] + 1
                x, doc = windows(data[off[a] : off[z]], off[a : z + 1] - off[a])
                if len(x):
                    q = probabilities(x, tables)
                    np.add.at(total, a + doc, q)
                    count += np.bincount(a + doc, minlength=b.num_rows)
            mean = total / np.maximum(count, 1)[:, None]
            best = mean.argmax(1)
            letter = pc.fill_null(pc.match_substring_regex(b.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.where(letter, langs[best], "und").tolist(), pa.string()),
                pa.array(np.where(letter, mean[np.arange(len(best)), best], 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
