"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Texts are lower-cased and their white space is folded. A window of w characters that occurs
with at most k edits shares at least w + 1 - q - k * q of its q-grams with the place where
it occurs, all within k diagonals. Documents' q-grams are looked up in the benchmark's; hits
are counted in diagonal bands of 16 that overlap by k, over every stretch of w + k
characters; a band that reaches the bound is verified by aligning the item's windows with
the region, within the band. An item shorter than w is one window with a smaller budget.

The benchmark's windows are the query set: it is read in slices of bounded size, each sent
to the documents, which stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, WINDOW, EDITS = 8, 80, 6
BAND = 16
#: Characters of benchmark text sent to the executors at once; a larger benchmark takes more slices.
SLICE_CHARS = 4_000_000
_MASK_BITS = 22
_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    """Edits allowed in a window of that many characters."""
    return EDITS if length >= WINDOW else length * EDITS // WINDOW


def needed(window: int) -> int:
    """Q-grams that a window of that many characters shares at least with a place where it occurs."""
    return max(1, window + 1 - Q - budget(window) * Q)


def stretches(windows: set[int]) -> list[tuple[int, int]]:
    """(need, span) of the windows: as many hits in a stretch of so many q-grams. Neither grows
    steadily with the window, since the budget steps; a pair that another one implies is left out."""
    pairs = {(needed(w), w + budget(w) - Q + 1) for w in windows}
    return sorted((n, s) for n, s in pairs if not any(a <= n and b >= s and (a, b) != (n, s) for a, b in pairs))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by Q zeros, and their starts."""
    gap = "\0" * Q
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + Q for t in texts], np.int64)
    return codes, np.concatenate(([0], np.cumsum(size)))


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 code points from each position on, by three doublings."""
    h = codes.astype(np.uint64) * _MULT[0]
    for step, mult in zip((1, 2, 4), _MULT):
        h[:-step] = h[:-step] * mult + h[step:]
        h ^= h >> np.uint64(29)
    return h[: max(0, len(codes) - Q + 1)]


class Index:
    """The q-grams of a slice of the benchmark with the places where they occur."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts = [i for i, _ in items], [normal(t) for _, t in items]
        codes, self.at = _codes(self.texts)
        self.codes = codes
        place = np.concatenate([np.arange(a, a + len(t) - Q + 1) for a, t in zip(self.at, self.texts) if len(t) >= Q] + [np.zeros(0, np.int64)]).astype(np.int64)
        h = qgrams(codes)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.place = place[order]
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int64)
        self.mask = np.zeros(1 << _MASK_BITS, bool)
        self.mask[(self.hash >> np.uint64(64 - _MASK_BITS)).astype(np.int64)] = True
        self.need = np.array([needed(min(len(t), WINDOW)) for t in self.texts], np.int64)
        self.stretches = stretches({min(len(t), WINDOW) for t in self.texts if len(t) >= Q})

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's place, item's place, start in the normal text, edits): the best window of each item found."""
        norm = [normal(t) for t in texts]
        codes, at = _codes(norm)
        h = qgrams(codes)
        if not len(self.hash) or not len(h):
            return []
        hit = self.mask[(h >> np.uint64(64 - _MASK_BITS)).astype(np.int64)]
        # only stretches with as many hits as the lemma asks of one of the slice's windows
        dense = np.zeros(len(h), bool)
        for need, span in self.stretches:
            total = np.zeros(len(h) + span + 1, np.int32)
            np.cumsum(hit, out=total[1 : len(h) + 1])
            total[len(h) + 1 :] = total[len(h)]
            starts = np.zeros(len(h) + span + 1, np.int32)  # a hit counts if a dense stretch began less than a span before it
            np.cumsum(total[span : span + len(h)] - total[: len(h)] >= need, out=starts[span + 1 :])
            dense |= starts[span + 1 :] > starts[1 : len(h) + 1]
        p = np.flatnonzero(hit & dense)
        if not len(p):
            return []
        k = np.minimum(np.searchsorted(self.hash, h[p]), len(self.hash) - 1)
        real = self.hash[k] == h[p]
        p, k = p[real], k[real]
        many = self.first[k + 1] - self.first[k]
        pos = np.repeat(p, many)
        b = self.place[np.repeat(self.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        diag = pos - b + int(self.at[-1])
        item = np.searchsorted(self.at, b, "right") - 1
        doc = np.searchsorted(at, pos, "right") - 1
        band = diag // BAND
        low = diag % BAND < EDITS  # also in the band before, which reaches over
        key = [np.concatenate((v, v[low])) for v in (doc, item)] + [np.concatenate((band, band[low] - 1)), np.concatenate((pos, pos[low])), np.concatenate((b, b[low]))]
        order = np.lexsort((key[3], key[2], key[1], key[0]))
        doc, item, band, pos, b = (v[order] for v in key)
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(doc))
        enough = (ends - first) >= self.need[item[first]]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for x, y in zip(first[enough], ends[enough]):
            d, i = int(doc[x]), int(item[x])
            size = len(self.texts[i])
            w = min(size, WINDOW)
            edits = budget(w)
            need = needed(w)
            if best.get((d, i), (0, 1))[1] == 0:
                continue
            run = np.unique(pos[x:y])
            if len(run) < need or not (run[need - 1 :] - run[: len(run) - need + 1] <= w + edits - Q).any():
                continue
            found = self._verify(codes, int(at[d]), int(at[d + 1]) - Q, i, int(band[x]) * BAND - int(self.at[-1]), int(pos[x]), int(pos[y - 1]), w, edits)
            if found and ((d, i) not in best or found[1] < best[d, i][1]):
                best[d, i] = found
        return [(d, i, start, e) for (d, i), (start, e) in sorted(best.items())]

    def _verify(self, codes: np.ndarray, lo: int, hi: int, item: int, diag: int, p0: int, p1: int, w: int, edits: int) -> tuple[int, int] | None:
        """Aligns the item's windows of w characters with the document's region along the band of
        diagonals [diag - edits, diag + BAND + 2 * edits): the start and the edits of the best."""
        a, size = int(self.at[item]), len(self.texts[item])
        first = max(0, p0 - diag - BAND - edits - w - a)
        starts = np.arange(min(first, size - w), min(size - w, max(0, p1 - diag + edits - a)) + 1)
        left, width = diag - edits, BAND + 3 * edits + 1
        if not len(starts):
            return None
        cols = np.arange(width)
        reach = a + np.arange(starts[0], starts[-1] + w)  # the pattern's places, a row each; the document's along the band
        at = reach[:, None] + left + cols
        same = (codes[np.clip(at, 0, len(codes) - 1)] == self.codes[reach][:, None]) & (at >= lo) & (at < hi)
        total = np.zeros((len(same) + 1, width), np.int64)
        np.cumsum(same, axis=0, out=total[1:])
        whole = np.argwhere(total[w:] - total[:-w] == w)
        if len(whole):  # a window that occurs as it is
            return int(reach[whole[0, 0]] + left + whole[0, 1] - lo), 0
        cost = np.zeros((len(starts), width), np.int32)  # column c: document place = pattern place + left + c
        for j in range(w):
            step = cost + ~same[j : j + len(starts)]  # match or replace
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a pattern character missing in the document
            cost = np.minimum.accumulate(step - cols, axis=1) + cols  # characters added in the document
        row = int(cost.min(1).argmin())
        if cost[row].min() > edits:
            return None
        return max(0, int(a + starts[row] + left + cost[row].argmin()) - lo), int(cost[row].min())


def slices(bench: DataFrame, chars: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in slices of bounded size, read one after the other."""
    part, held = [], 0
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        part.append((r.item_id, r.text))
        held += len(r.text)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, edits): every pair of a document and a benchmark item one of
    whose windows occurs in it, with the best window's place in the normal text. Null and empty
    texts, and items shorter than a q-gram, match nothing. Repeated rows give repeated matches;
    an empty table gives none."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, edits long"
    out = None
    for items in slices(bench):
        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for b in batches:
                ids, found = b.column("doc_id").to_pylist(), index.find(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d, *_ in found], pa.int64()), pa.array([index.ids[i] for _, i, *_ in found], pa.int64()),
                    pa.array([s for *_, s, _ in found], pa.int64()), pa.array([e for *_, e in found], pa.int64())], names=["doc_id", "item_id", "start", "edits"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, with all their columns."""
    for items in slices(bench):
        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in index.find(b.column("text").to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
