"""Quality rules by labelling lines: a linear-chain conditional random field.

Each line of a text has binary features (its length, characters, repetitions); the field has
a weight per feature and label and a weight per pair of neighbouring labels, fitted by
maximum likelihood with forward-backward sums. Viterbi decoding marks every line of a whole
text as content or boilerplate; the share of its words in content lines decides.

Lines have no labels of their own: in fitting, the lines of documents of quality 1 count as
content, those of quality 0 as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, hash_spans, keys64, mix64, share, sums_between, text_buffer, training_rows, word_spans

#: Bounds of the fit: labelled rows, and lines in one training sequence (a longer text gives several).
SAMPLE, SEQUENCE = 3_000, 32
CONTENT_SHARE = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BANG, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_BANG[ord("!")] = True
_STOP[[ord(c) for c in ".?"]] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_STEPS = {"words": (1, 3, 6, 12, 25, 60), "symbol": (0.0, 0.02, 0.08), "bang": (0.0, 0.03), "upper": (0.06, 0.15, 0.4), "digit": (0.0, 0.05, 0.3), "stop": (0.0, 0.005, 0.03), "same": (0.0, 0.05, 0.2), "word": (3.0, 5.0, 7.0)}
N_FEATURES = 1 + sum(len(v) + 1 for v in _STEPS.values()) + 1


class Batch:
    """Words, lines and base counts of an Arrow column of texts."""

    def __init__(self, col: pa.Array):
        data, off = text_buffer(col)
        self.start, self.end, self.at = word_spans(data, off)
        self.h = hash_spans(data, self.start, self.end, fold=False)
        self.n = np.diff(self.at)
        lead = (data & 0xC0) != 0x80
        self.word_chars = sums_between(lead & ~BLANK[data], off)
        self.symbols = sums_between(_SYMBOL[data], off)
        # lines: every text has one more than it has line feeds
        cuts = np.flatnonzero(data == 10)
        per = np.diff(np.searchsorted(cuts, off))
        n_lines = per + 1
        self.line_at = np.concatenate(([0], np.cumsum(n_lines)))
        lo, hi = np.zeros(self.line_at[-1], np.int64), np.zeros(self.line_at[-1], np.int64)
        first, last = self.line_at[:-1], self.line_at[1:] - 1
        inner_lo, inner_hi = np.ones(len(lo), bool), np.ones(len(lo), bool)
        inner_lo[first], inner_hi[last] = False, False
        lo[first], hi[last] = off[:-1], off[1:]
        lo[inner_lo], hi[inner_hi] = cuts + 1, cuts
        words = np.searchsorted(self.start, hi) - np.searchsorted(self.start, lo)
        # lines without a word are not lines of the field
        has = words > 0
        self.lo, self.hi, self.words = lo[has], hi[has], words[has]
        doc = np.repeat(np.arange(len(self.n)), n_lines)[has]
        self.line_at = np.searchsorted(doc, np.arange(len(self.n) + 1))
        line_hash = hash_spans(data, self.lo, self.hi, fold=False)
        self.again = np.zeros(len(doc), bool)
        for i in np.flatnonzero(np.diff(self.line_at) > 1):
            a, b = self.line_at[i], self.line_at[i + 1]
            self.again[a:b] = True
            self.again[a + np.unique(line_hash[a:b], return_index=True)[1]] = False
        self.dup_lines = sums_between(self.again, self.line_at)
        self.repeat_words = self._repeats()
        self.x = self._features(data, doc)

    def _repeats(self) -> np.ndarray:
        """Words of each text inside a 3-word window that the text has twice or more."""
        out = np.zeros(len(self.n), np.int64)
        salt = keys64(3, 41)
        for i in np.flatnonzero(self.n > 3):
            w = self.h[self.at[i] : self.at[i + 1]]
            tri = mix64(w[:-2] * salt[0] + w[1:-1] * salt[1] + w[2:] * salt[2])
            order = np.argsort(tri, kind="stable")
            same = tri[order][1:] == tri[order][:-1]
            if same.any():
                hit = np.zeros(len(tri), bool)
                hit[order[1:][same]] = hit[order[:-1][same]] = True
                cover = np.zeros(len(w), bool)
                cover[:-2] |= hit
                cover[1:-1] |= hit
                cover[2:] |= hit
                out[i] = cover.sum()
        return out

    def _features(self, data: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(lines, features) 0/1: a bias, one of the steps of each measure, a repeated line."""
        def of(table: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(table[data])))
            return share(total[self.hi] - total[self.lo], self.hi - self.lo)

        first = np.searchsorted(self.start, self.lo)
        same = np.zeros(len(self.h), bool)
        same[1:] = self.h[1:] == self.h[:-1]
        same[first] = False
        total = np.concatenate(([0], np.cumsum(same)))
        sizes = np.concatenate(([0], np.cumsum(self.end - self.start)))
        measures = {"words": self.words, "symbol": of(_SYMBOL), "bang": of(_BANG), "upper": of(_UPPER), "digit": of(_DIGIT), "stop": of(_STOP),
                    "same": share(total[first + self.words] - total[first], self.words), "word": share(sizes[first + self.words] - sizes[first], self.words)}
        x = np.zeros((len(doc), N_FEATURES), np.float32)
        x[:, 0], k = 1, 1
        for name, steps in _STEPS.items():
            x[np.arange(len(doc)), k + np.searchsorted(steps, measures[name], "left")] = 1
            k += len(steps) + 1
        x[:, k] = self.again
        return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """Maximum-likelihood weights from sequences x (sequences, SEQUENCE, features), y with -1 after a sequence's end."""
    model = {"w": np.zeros((N_FEATURES, 2)), "t": np.zeros((2, 2))}
    on = y >= 0
    if not on.any():
        return model
    y1 = np.where(on, y, 0)
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.items()}
    gold_w = np.stack([x[on & (y == c)].sum(0) for c in (0, 1)], 1)
    pair = on[:, 1:] & on[:, :-1]
    gold_t = np.array([[(pair & (y1[:, :-1] == a) & (y1[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    total = on.sum()
    for step in range(1, rounds + 1):
        e = x @ model["w"]
        length = x.shape[1]
        fwd, bwd = np.zeros(e.shape), np.zeros(e.shape)
        fwd[:, 0] = e[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(fwd[:, t - 1, :1] + model["t"][0], fwd[:, t - 1, 1:] + model["t"][1]) + e[:, t]
            fwd[:, t] = np.where(on[:, t, None], nxt, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = bwd[:, t + 1] + e[:, t + 1]
            nxt = np.logaddexp(nxt[:, :1] + model["t"][:, 0], nxt[:, 1:] + model["t"][:, 1])
            bwd[:, t] = np.where(on[:, t + 1, None], nxt, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        node = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
        joint = fwd[:, :-1, :, None] + model["t"] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
        edge = (np.exp(np.minimum(joint, 0)) * pair[:, :, None, None]).sum((0, 1))
        grad = {"w": (np.einsum("slf,slc->fc", x, node) - gold_w) / total + ridge * model["w"], "t": (edge - gold_t) / total + ridge * model["t"]}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            model[k] = model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-9)
    return model


def viterbi(e: np.ndarray, at: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best labels of all lines; e: (lines, 2) emissions, at: offsets of each text's lines."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, size = at[:-1][order], n[order]
    back = np.zeros((len(e), 2), np.int8)
    score = np.zeros((len(n), 2))
    for k in range(int(n.max()) if len(n) else 0):
        live = int(np.searchsorted(-size, -k, "left"))  # texts with more than k lines
        rows = first[:live] + k
        if k:
            step = score[:live, :, None] + t
            back[rows] = step.argmax(1)
            score[:live] = step.max(1) + e[rows]
        else:
            score[:live] = e[rows]
    out = np.zeros(len(e), np.int8)
    best = score.argmax(1).astype(np.int8)
    for k in range(int(n.max()) - 1 if len(n) else -1, -1, -1):
        live = int(np.searchsorted(-size, -k, "left"))
        rows = first[:live] + k
        out[rows] = best[:live]
        best[:live] = back[rows, best[:live]]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits on the lines of at most ``sample`` labelled documents; the driver gets one byte a
    feature of at most two sequences a document (its first and its last). Without labels of
    both classes every line is content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Batch(b.column("text"))
            y, d = b.column("y").to_pylist(), b.column("doc_id").to_pylist()
            rows = []
            for i in range(b.num_rows):
                a, z = int(lines.line_at[i]), int(lines.line_at[i + 1])
                for s in sorted({a, max(a, z - SEQUENCE)}) if z > a else []:
                    rows.append((d[i], y[i], lines.x[s : min(s + SEQUENCE, z)].astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "y", "x"])

    got = sorted({(r.doc_id, r.y, bytes(r.x)) for r in training_rows(docs, labels, "quality", 1, -1, sample).mapInArrow(run, "doc_id long, y int, x binary").collect()})
    if len({r[1] for r in got}) < 2:
        model = {"w": np.zeros((N_FEATURES, 2)), "t": np.zeros((2, 2))}
        model["w"][0, 1] = 1.0
        return model
    x = np.zeros((len(got), SEQUENCE, N_FEATURES), np.float32)
    y = np.full((len(got), SEQUENCE), -1)
    for k, (_, label, raw) in enumerate(got):
        part = np.frombuffer(raw, np.uint8).reshape(-1, N_FEATURES)
        x[k, : len(part)], y[k, : len(part)] = part, int(label == 1)
    return fit(x, y)


def judge(docs: DataFrame, model: dict, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, the share of words in
    content lines and kept. Null, empty and blank texts have zeros and fail."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Batch(b.column("text"))
            content = viterbi(t.x @ model["w"], t.line_at, model["t"]) == 1
            part = share(sums_between(t.words * content, t.line_at), sums_between(t.words, t.line_at))
            counts = (t.n, t.word_chars, t.symbols, t.dup_lines, t.repeat_words, np.diff(t.line_at), sums_between(content, t.line_at))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(part, pa.float64())], names=["doc_id", *names, "content_share"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, content_share double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))
