"""A small autoencoder fitted on whole tables.

Layers of a few units (2 and 2 by default) with rectifiers between them, a linear output, squared error and a
weight penalty. One pass over the rows gives the loss and its gradient as exact sums (:mod:`.passes`), so reruns
agree on any partitioning. The driver holds only the parameters (a few dozen numbers) and takes limited-
memory quasi-Newton steps with a line search. Several starts are fitted in the same passes, since a narrow
rectified layer can lose its units; the one with the lowest loss stays.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stable
from .passes import UNIT, exact_totals, few_tasks, held_rows, product_sums, whole_sums

# The settings of the original network.
HIDDEN, MAX_PASSES, PENALTY, SEED = (2, 2), 500, 1e-4, 42
STARTS = 4
#: A fit ends after this many steps in a row that lower the loss by less than this (the original's tolerance).
PATIENCE, TOLERANCE = 5, 1e-4


@dataclass
class Network:
    """Weights (one matrix from, to a layer) and offsets; ``losses`` of the kept start, a step each."""

    weights: list[np.ndarray]
    offsets: list[np.ndarray]
    losses: list[float]


def _shapes(sizes: list[int]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]


def _unpack(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for s in _shapes(sizes):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def _start(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w' x for columns x (features, rows), added up in one order whatever the number of rows."""
    out = np.zeros((w.shape[1], x.shape[1]))
    for i in range(w.shape[0]):
        out += w[i][:, None] * x[i]
    return out


def _through(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Every row's loss, half its squared error, and of every layer what goes in and the loss's slope by what comes out.
    x and the layers: (features, rows)."""
    params = _unpack(flat, sizes)
    layers = len(params) // 2
    held = [x]
    for k in range(layers):
        out = _dot(held[-1], params[2 * k]) + params[2 * k + 1][:, None]
        held.append(np.maximum(out, 0.0) if k < layers - 1 else out)
    back = [held.pop() - x]
    loss = 0.5 * sum(b * b for b in back[0])
    for k in range(layers - 1, 0, -1):
        back.insert(0, _dot(back[0], params[2 * k].T) * (held[k] > 0))
    return loss, held, back


def terms(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Every row's loss and gradient (rows, parameters)."""
    loss, held, back = _through(np.ascontiguousarray(x.T), flat, sizes)
    return loss, np.concatenate([part for h, g in zip(held, back) for part in ((h[:, None] * g).reshape(-1, len(x)), g)]).T


def totals(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> list[int]:
    """The sums of :func:`terms` over the rows in whole numbers of ``UNIT`` squared; x: (features, rows). A weight's slope
    is a product of two numbers of a row; those are made whole, so that the products are added up by matrix products."""
    loss, held, back = _through(x, flat, sizes)
    scale = round(1 / UNIT)
    out = [scale * v for v in whole_sums(np.rint(loss[None] * scale))]
    for h, g in zip(held, back):
        slope = np.rint(g * scale)
        out += product_sums(np.rint(h * scale), slope) + [scale * v for v in whole_sums(slope)]
    return out


def _steps(x: np.ndarray, limit: int, losses: list[float], memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps from ``x``: yields the points at which it wants loss and gradient."""
    loss, g = yield x
    losses.append(loss)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    slow = 0
    while slow < PATIENCE and len(losses) < limit:
        down, used = g.copy(), []
        for s, y in reversed(past):
            used.append((s @ down) / (s @ y))
            down -= used[-1] * y
        if past:
            s, y = past[-1]
            down *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used)):
            down += (a - (y @ down) / (s @ y)) * s
        if g @ down <= 0:
            down, past = g.copy(), []
        size = 1.0 if past else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(20):
            there = x - size * down
            new, new_g = yield there
            if new <= loss - 1e-4 * size * (g @ down):
                break
            size /= 2
        else:
            return x
        if (there - x) @ (new_g - g) > 1e-12:
            past = [*past, (there - x, new_g - g)][-memory:]
        slow = slow + 1 if loss - new < TOLERANCE else 0
        x, loss, g = there, new, new_g
        losses.append(loss)
    return x


def fit(scaled: DataFrame, features: list[str], hidden: tuple[int, ...] = HIDDEN, passes: int = MAX_PASSES, starts: int = STARTS, seed: int = SEED) -> Network:
    """The network with the lowest loss. Rows with a missing feature take no part; without rows the start's
    weights stay. At most ``passes`` passes over the rows."""
    sizes = [len(features), *hidden, len(features)]
    rows = few_tasks(stable(scaled.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna(), "autoencoder_rows"))
    n, parts = rows.count(), rows.rdd.getNumPartitions()
    points = [_start(sizes, seed + k) for k in range(starts)]
    if not n:
        return Network(_unpack(points[0], sizes)[::2], _unpack(points[0], sizes)[1::2], [])
    matrix = np.concatenate([np.full(int(np.prod(s)), len(s) == 2) for s in _shapes(sizes)])  # only weights are penalised

    def summed(at: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def of_rows(x: np.ndarray) -> list[int]:
            columns = np.ascontiguousarray(x.T)
            return [v for flat in at for v in totals(columns, flat, sizes)]

        each = exact_totals(blocks, of_rows, parts, UNIT * UNIT)
        sums = (each / n).reshape(len(at), -1)
        return [(own[0] + 0.5 * PENALTY / n * float((flat[matrix] ** 2).sum()), own[1:] + PENALTY / n * flat * matrix) for own, flat in zip(sums, at)]

    blocks = held_rows(rows, features)
    losses: list[list[float]] = [[] for _ in points]
    runs = [_steps(p, passes, own) for p, own in zip(points, losses)]
    ask = {k: next(r) for k, r in enumerate(runs)}
    done: dict[int, np.ndarray] = {}
    for _ in range(passes):
        if not ask:
            break
        answers = summed(list(ask.values()))
        for k, answer in zip(list(ask), answers):
            try:
                ask[k] = runs[k].send(answer)
            except StopIteration as end:
                done[k] = end.value
                del ask[k]
    blocks.unpersist()
    for k, point in ask.items():  # the passes are used up
        done[k] = point
    best = min(done, key=lambda k: (losses[k][-1], k))
    params = _unpack(done[best], sizes)
    return Network(params[::2], params[1::2], losses[best])


def reconstruction_error(scaled: DataFrame, features: list[str], net: Network, out: str = "reconstruction_error") -> DataFrame:
    """Adds the mean squared error between a row's features and their reconstruction, in column functions."""
    values: list[Column] = [F.col(f).cast("double") for f in features]
    for k, (w, b) in enumerate(zip(net.weights, net.offsets)):
        layer = [sum((v * float(w[i, j]) for i, v in enumerate(values)), F.lit(float(b[j]))) for j in range(w.shape[1])]
        names = [f"_ae_{k}_{j}" for j in range(len(layer))]
        scaled = scaled.withColumns({name: F.greatest(x, F.lit(0.0)) if k < len(net.weights) - 1 else x for name, x in zip(names, layer)})
        values = [F.col(name) for name in names]
    error = sum(((F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, values)), F.lit(0.0)) / float(len(features))
    return scaled.withColumn(out, error).drop(*[c for c in scaled.columns if c.startswith("_ae_")])
