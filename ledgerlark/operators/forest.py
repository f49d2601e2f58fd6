"""Random forests of deep trees for two classes.

The method and the form of the model are those of Spark's ``RandomForestClassifier``: rows drawn with replacement for
every tree, features in at most ``maxBins`` ranges, a new draw of features at every node, splits by Gini gain,
sibling leaves of one prediction merged. Only the way is another. While a node has more than ``GROUP`` rows, partitions
add up its table of (feature, bin, class) and a group per node finds the split. The rows of a smaller
node go to one group, where the rest of its tree is grown to the end, level by level over sorted bins. Trees are taken
in batches, so that a shuffle holds at most some ``COPIES`` rows, whatever the number of trees. The nodes are written
by the groups; the driver sees the splits above them and a line for each group.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, stable
from .boost import CUT_ROWS, cut_points

#: Rows of a node that one group grows to the end, row copies (over all trees of a batch) of a shuffle, rows of a block.
GROUP, COPIES, BLOCK_ROWS = 1 << 16, 1 << 26, 1 << 14
#: Bytes of the tables that a task holds of the trees that are grown at the same time.
TABLES = 1 << 27
#: Gains up to this are rounding.
NO_GAIN = 1e-13
#: Weights are added up as whole numbers of this, so that sums are exact.
UNIT = 2.0 ** -30


def _gini(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Gini impurity of nodes of weight ``w``, of which ``p`` is of class 1."""
    share = p / np.maximum(w, 1)
    return 2.0 * share * (1.0 - share)


def _gain(lw: np.ndarray, lp: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    rw, rp = w - lw, p - lp
    return _gini(w, p) - (lw * _gini(lw, lp) + rw * _gini(rw, rp)) / w


def _subset(key: list[int], nodes: int, width: int, take: int) -> np.ndarray:
    """(nodes, take) features that the nodes look at."""
    if take == width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.sort(np.argpartition(np.random.default_rng(key).random((nodes, width)), take, axis=1)[:, :take], axis=1)


def _cells(x: np.ndarray, rows: np.ndarray, own: np.ndarray, sub: np.ndarray, bins: int) -> np.ndarray:
    """(rows, features looked at) cells of (node, place of the feature, bin); own: the rows' nodes, sub: the nodes' features."""
    take = sub.shape[1]
    return (own[:, None] * take + np.arange(take)) * bins + x[rows[:, None], sub[own]]


def _best_of_tables(cell: np.ndarray, shape: tuple[int, int, int], c: np.ndarray, cy: np.ndarray, w: np.ndarray | None, n: np.ndarray, p: np.ndarray, least: int) -> tuple:
    """(place of the feature, last bin on the left, gain) of the best split of every node, from tables of all its cells; a gain of
    -1 where there is none. c, cy, w: weights, those of class 1 and times drawn (None: the weights) of the rows; n, p: of the nodes."""
    nodes, take, bins = shape
    summed = lambda v: np.bincount(cell.ravel(), np.repeat(v, take), nodes * take * bins).reshape(shape)
    here, lp = summed(c), np.cumsum(summed(cy), axis=2)
    lw = np.cumsum(here, axis=2)
    lk = lw if w is None else np.cumsum(summed(w), axis=2)
    ok = (here > 0) & (lk >= least) & (lk[:, :, -1:] - lk >= least)
    value = np.where(ok, _gain(lw, lp, n[:, None, None], p[:, None, None]), -1.0).reshape(nodes, -1)
    at = value.argmax(axis=1)
    return at // bins, at % bins, value[np.arange(nodes), at]


def _best_of_sorted(cell: np.ndarray, shape: tuple[int, int, int], c: np.ndarray, cy: np.ndarray, w: np.ndarray | None, n: np.ndarray, p: np.ndarray, least: int) -> tuple:
    """As :func:`_best_of_tables`, from the sorted cells that have rows, for many nodes of few rows."""
    nodes, take, bins = shape
    place, last, best = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -1.0)
    both = np.sort(((cell << 24) | np.arange(len(cell))[:, None]).ravel())
    cell, r = both >> 24, both & ((1 << 24) - 1)
    block = cell // bins
    begin = np.flatnonzero(np.diff(block, prepend=-1))  # every (node, feature) has all rows of the node
    at = np.flatnonzero((cell[1:] != cell[:-1]) & (block[1:] == block[:-1]))
    if not len(at):
        return place, last, best
    low = begin[block[at]]
    node = block[at] // take

    def left(v: np.ndarray) -> np.ndarray:
        upto = np.cumsum(v[r])
        return upto[at] - np.where(low > 0, upto[low - 1], 0)

    lw, lp = left(c), left(cy)
    lk, k = (lw, n) if w is None else (left(w), np.bincount(cell // (take * bins), w[r], nodes) / take)
    ok = (lk >= least) & (k[node] - lk >= least)
    value = np.where(ok, _gain(lw, lp, n[node], p[node]), -1.0)
    np.maximum.at(best, node, value)
    which = np.flatnonzero((value == best[node]) & (value >= 0))
    node, one = np.unique(node[which], return_index=True)
    place[node], last[node] = block[at[which[one]]] % take, cell[at[which[one]]] % bins
    return place, last, best


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, take: int, least: int, min_gain: float, key: list[int], bins: int, c: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The tree of the rows ``x`` (rows, features; bins) of class ``y`` drawn ``w`` times, of weight ``c`` (whole numbers; as often
    as drawn if not given), of at most ``depth`` levels of splits: its nodes level by level, left children beside right
    ones; ``left`` is -1 for leaves."""
    found: dict[str, list] = {name: [] for name in ("feature", "cut", "gain", "c0", "c1", "rows", "left")}
    w = w.astype(np.int64)
    times, c = (None, w) if c is None else (w, c)
    cy = c * y
    rows, slot, total, first = np.arange(len(x)), np.zeros(len(x), np.int64), 1, 0
    starts = []
    for level in range(depth + 1):
        n, p = np.bincount(slot, c[rows], total), np.bincount(slot, cy[rows], total)
        feature, cut, gain = np.full(total, -1), np.zeros(total, np.int64), np.full(total, -1.0)
        starts.append(first)
        if level < depth and ((p > 0) & (p < n)).any():
            mixed = (p > 0) & (p < n)
            inner = np.flatnonzero(mixed)
            place = np.cumsum(mixed) - 1
            keep = mixed[slot]
            rows, slot = rows[keep], slot[keep]
            own = place[slot]
            sub = _subset([*key, level], len(inner), x.shape[1], take)
            best = _best_of_tables if len(inner) * bins <= 2 * len(rows) else _best_of_sorted
            at, last, value = best(_cells(x, rows, own, sub, bins), (len(inner), take, bins), c[rows], cy[rows], None if times is None else times[rows], n[inner], p[inner], least)
            node = np.flatnonzero((value > NO_GAIN) & (value >= min_gain))
            feature[inner[node]], cut[inner[node]], gain[inner[node]] = sub[node, at[node]], last[node], value[node]
        split = np.flatnonzero(feature >= 0)
        left = np.full(total, -1)
        left[split] = first + total + 2 * np.arange(len(split))
        for name, v in (("feature", feature), ("cut", cut), ("gain", gain), ("c0", n - p), ("c1", p), ("rows", np.bincount(slot, minlength=total)), ("left", left)):
            found[name].append(v)
        if not len(split):
            break
        keep = feature[slot] >= 0
        rows, slot = rows[keep], slot[keep]
        slot = left[slot] - first - total + (x[rows, feature[slot]] > cut[slot])
        first, total = first + total, 2 * len(split)
    return _merged({name: np.concatenate(v) for name, v in found.items()}, starts)


def _merged(t: dict[str, np.ndarray], starts: list[int]) -> dict[str, np.ndarray]:
    """The tree without sibling leaves that predict alike, its nodes numbered anew."""
    one, left = t["c1"] > t["c0"], t["left"].copy()
    bounds = [*starts, len(left)]
    for lo, hi in reversed(list(zip(bounds, bounds[1:]))):
        inner = lo + np.flatnonzero(left[lo:hi] >= 0)
        a, b = left[inner], left[inner] + 1
        left[inner[(left[a] < 0) & (left[b] < 0) & (one[a] == one[b])]] = -1
    alive = np.zeros(len(left), bool)
    alive[0] = True
    for lo, hi in zip(bounds, bounds[1:]):
        inner = lo + np.flatnonzero(alive[lo:hi] & (left[lo:hi] >= 0))
        alive[left[inner]] = alive[left[inner] + 1] = True
    name = np.cumsum(alive) - 1
    out = {k: v[alive] for k, v in t.items() if k != "left"}
    left = left[alive]
    leaf = left < 0
    out["left"] = np.where(leaf, -1, name[left])
    out["feature"], out["gain"] = np.where(leaf, -1, out["feature"]), np.where(leaf, -1.0, out["gain"])
    return out


class Top:
    """The nodes of a tree above its groups: feature (-1: none), last bin on the left, left child, whose sibling is beside it,
    depth, and for nodes of many rows gain, weight of either class and rows."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.depth, self.more, self.parent = [-1], [0], [-1], [0], [(0.0, 0.0, 0.0, 0)], [-1]

    def split(self, at: int, feature: int, cut: int) -> list[int]:
        self.feature[at], self.cut[at], self.left[at] = feature, cut, len(self.left)
        for _ in range(2):
            for held, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.depth, self.depth[at] + 1), (self.more, (0.0, 0.0, 0.0, 0)), (self.parent, at)):
                held.append(v)
        return [self.left[at], self.left[at] + 1]

    def parted(self, x: np.ndarray, rows: np.ndarray, wanted: list[int]) -> list[tuple[int, np.ndarray]]:
        """(node, those of ``rows`` that come to it) for the ``wanted`` nodes; x: (features, rows). Rows of a node are kept together,
        and those that lead to no wanted node are left."""
        lead, todo = np.zeros(len(self.left), bool), list(wanted)
        while todo:
            at = todo.pop()
            if not lead[at]:
                lead[at] = True
                todo += [self.parent[at]] if at else []
        here, found, held = set(wanted), [], [(0, rows)]
        while held:
            at, own = held.pop()
            if at in here:
                found.append((at, own))
            elif lead[at] and self.left[at] >= 0:
                right = x[self.feature[at]][own] > self.cut[at]
                held += [(self.left[at], own[~right]), (self.left[at] + 1, own[right])]
        return found


def _blocks(train: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[np.ndarray]) -> DataFrame:
    """Rows as blocks of bytes: (part, number) names a block, ``x`` holds its bins row by row, ``y`` its classes, ``c`` its
    weights in :data:`UNIT`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, given, weights = TaskContext.get().partitionId(), 0, [], [], []

        def block() -> pa.RecordBatch:
            x, y = np.concatenate(held), np.concatenate(given)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                                               "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()),
                                               "c": pa.array([np.concatenate(weights).tobytes() if weight else b""], pa.binary())})

        for b in batches:
            x = np.zeros((b.num_rows, len(cuts)), np.uint8)
            for i, cut in enumerate(cuts):
                v = b.column(f"x{i}").to_numpy(zero_copy_only=False)
                if not np.isfinite(v).all():
                    raise ValueError(f"forests are fitted to finite values; {features[i]} has others")
                x[:, i] = np.searchsorted(cut, v, "left")
            held.append(x)
            given.append((b.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.uint8))
            if weight:
                w = b.column("w").to_numpy(zero_copy_only=False)
                if not ((w >= 0) & (w <= 1024)).all():
                    raise ValueError(f"weights of forests' rows are from 0 to 1024; {weight} has others")
                weights.append(np.rint(w / UNIT).astype(np.int64))
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block()
                number, held, given, weights = number + 1, [], [], []
        if held:
            yield block()

    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)] + [F.col(label).cast("double").alias("y")]
    cols += [F.col(weight).cast("double").alias("w")] if weight else []
    return stable(train.select(*cols).mapInArrow(run, "part int, number int, x binary, y binary, c binary"), "forest_rows")


def fit_forest(train: DataFrame, features: list[str], est: RandomForestClassifier) -> StoredForest:
    """The model of ``est``, fitted to the columns ``features``; a missing value among them is an error, as in Spark's own fit."""
    p = {q.name: est.getOrDefault(q) for q in est.params if est.isDefined(q)}
    if p["impurity"] != "gini" or p["minWeightFractionPerNode"] > 0 or p["maxBins"] > 256 or p["featureSubsetStrategy"] not in ("auto", "all", "sqrt"):
        raise ValueError("forests split by Gini gain in at most 256 bins, looking at all features or at the square root of their number")
    spark, width, trees, depth, least, seed = train.sparkSession, len(features), p["numTrees"], p["maxDepth"], p["minInstancesPerNode"], p["seed"] % (1 << 63)
    take = width if p["featureSubsetStrategy"] == "all" or p["featureSubsetStrategy"] == "auto" and trees == 1 else int(np.ceil(np.sqrt(width)))
    rate, again, min_gain, group, bins, weight = p["subsamplingRate"], p["bootstrap"], p["minInfoGain"], GROUP, p["maxBins"], p.get("weightCol")
    unit = UNIT if weight else 1
    n = train.count()
    sample = train.select(*[F.col(f).cast("double") for f in features]).sample(fraction=min(1.0, 1.1 * CUT_ROWS / max(n, 1)), seed=seed)
    cuts = cut_points(sample.limit(CUT_ROWS).toPandas().to_numpy(float), p["maxBins"])  # a bounded sample
    parts = max(1, min(-(-n // BLOCK_ROWS), max(4 * spark.sparkContext.defaultParallelism, -(-n // (16 * BLOCK_ROWS)))))
    blocks = _blocks(train.repartition(parts), features, p["labelCol"], weight, cuts).repartition(parts, "part", "number").persist()

    def drawn(tree: int, part: int, number: int, rows: int) -> np.ndarray:
        """How often the tree learns from the rows of a block."""
        if again:
            return np.random.default_rng([seed, tree, part, number]).poisson(rate, rows)
        return (np.random.default_rng([seed, tree, part, number]).random(rows) < rate).astype(np.int64) if rate < 1.0 else np.ones(rows, np.int64)

    def given(batches: Iterator[pa.RecordBatch], tops: dict[int, Top], wanted: dict[int, list[int]]) -> Iterator[tuple]:
        """For every block and tree the rows that it draws: tree, bins, classes, times drawn, weights, rows by wanted node."""
        for b in batches:
            for one in b.to_pylist():
                y = np.frombuffer(one["y"], np.uint8)
                x = np.frombuffer(one["x"], np.uint8).reshape(len(y), width)
                by_feature = np.ascontiguousarray(x.T)
                c = np.frombuffer(one["c"], np.int64) if weight else None
                for tree, nodes in wanted.items():
                    w = drawn(tree, one["part"], one["number"], len(y))
                    yield tree, x, y, w, w if c is None else w * c, tops[tree].parted(by_feature, np.flatnonzero(w), nodes)

    def counted(tops: dict[int, Top], open_: dict[int, list[int]]):  # noqa: ANN202
        """Tables of the open nodes: per node the weight of class 1 and of both, the rows and, of weighted rows, the times drawn
        by (feature looked at, bin)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, subs, slots = {}, {}, {}
            for tree, nodes in open_.items():
                subs[tree] = np.concatenate([_subset([seed, tree, node, 0], 1, width, take) for node in nodes])
                slots[tree] = np.full(len(tops[tree].left), -1)
                slots[tree][nodes] = np.arange(len(nodes))
            for tree, x, y, w, c, found in given(batches, tops, open_):
                own = np.concatenate([rows for _, rows in found])
                slot = np.repeat(slots[tree][[node for node, _ in found]], [len(rows) for _, rows in found])
                cell, cells = _cells(x, own, slot, subs[tree], bins).ravel(), len(open_[tree]) * take * bins
                terms = [c[own] * y[own], c[own], np.ones(len(own))] + ([w[own]] if weight else [])
                table = np.stack([np.bincount(cell, np.repeat(v, take), cells) for v in terms]).astype(np.int64)
                tables[tree] = tables[tree] + table if tree in tables else table
            for tree, table in tables.items():
                each = table.reshape(len(table), len(open_[tree]), -1)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([tree] * each.shape[1], pa.int32()), "node": pa.array(open_[tree], pa.int32()),
                                                  "cells": pa.array([each[:, i].tobytes() for i in range(each.shape[1])], pa.binary())})
        return run

    def decided(pdf: pd.DataFrame) -> pd.DataFrame:
        """The best split of a node from its tables."""
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        table = sum(np.frombuffer(t, np.int64) for t in pdf["cells"]).reshape(-1, take, bins)
        upto = np.cumsum(table, axis=2)
        lp, lw, held, lk = upto[0], upto[1], upto[2], upto[-1 if weight else 1]
        w, c1, k = lw[:, -1:], lp[:, -1:], lk[:, -1:]
        ok = (lk >= max(least, 1)) & (k - lk >= max(least, 1)) & (table[1] > 0)
        value = np.where(ok, _gain(lw, lp, w, c1), -1.0)
        f, cut = np.unravel_index(int(np.argmax(value)), value.shape)
        split = value[f, cut] > NO_GAIN and value[f, cut] >= min_gain
        feature = int(_subset([seed, tree, node, 0], 1, width, take)[0][f]) if split else -1
        return pd.DataFrame({"tree": [tree], "node": [node], "held": [int(held[0, -1])], "feature": [feature], "cut": [int(cut)], "gain": [float(value[f, cut])],
                             "c0": [float(w[0, 0] - c1[0, 0]) * unit], "c1": [float(c1[0, 0]) * unit], "lw": [float(lw[f, cut]) * unit], "lp": [float(lp[f, cut]) * unit],
                             "lheld": [int(held[f, cut])], "times": [int(k[0, 0])], "ltimes": [int(lk[f, cut])]})

    def dealt(tops: dict[int, Top], ended: dict[int, set[int]]):  # noqa: ANN202
        """The rows of every tree by the node that they have reached, a piece for each block; those of ``ended`` nodes stay."""
        groups = {t: [at for at, left in enumerate(top.left) if left < 0 and at not in ended.get(t, ())] for t, top in tops.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tree, x, y, w, c, found in given(batches, tops, groups):
                found = [(node, rows) for node, rows in found if len(rows)]
                if not found:
                    continue
                node, own = [at for at, _ in found], np.concatenate([rows for _, rows in found])
                each = np.concatenate([x[own], y[own, None], np.minimum(w[own], 255).astype(np.uint8)[:, None]], axis=1)
                if weight:
                    each = np.concatenate([each, c[own].astype(np.int64)[:, None].view(np.uint8)], axis=1)
                pieces = [v.tobytes() for v in np.split(each, np.cumsum([len(rows) for _, rows in found])[:-1])]
                yield pa.RecordBatch.from_pydict({"tree": pa.array([tree] * len(node), pa.int32()), "node": pa.array(node, pa.int32()), "x": pa.array(pieces, pa.binary())})
        return run

    cut_at, wide = {i: c for i, c in enumerate(cuts)}, width + 2 + (8 if weight else 0)

    def finished(tops: dict[int, Top]):  # noqa: ANN202
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            each = np.concatenate([np.frombuffer(v, np.uint8).reshape(-1, wide) for v in pdf["x"]])
            c = np.ascontiguousarray(each[:, width + 2 :]).view(np.int64)[:, 0] if weight else None
            t = grow(each[:, :width], each[:, width], each[:, width + 1], depth - tops[tree].depth[node], take, max(least, 1), min_gain, [seed, tree, node], bins, c)
            cut = [float(cut_at[f][v]) if f >= 0 else 0.0 for f, v in zip(t["feature"].tolist(), t["cut"].tolist())]
            return pd.DataFrame({"tree": tree, "node": node, "id": np.arange(len(cut)), "feature": t["feature"], "threshold": cut, "gain": t["gain"],
                                 "c0": t["c0"].astype(float) * unit, "c1": t["c1"].astype(float) * unit, "held": t["rows"], "left": t["left"]})
        return run

    written: list[DataFrame] = []
    tops: dict[int, Top] = {t: Top() for t in range(trees)}
    ended: dict[int, set[int]] = {}  # nodes of many rows that are leaves: their rows go nowhere
    batch = max(1, TABLES // (-(-n // group) * take * bins * 32))
    for low in range(0, trees if n > group else 0, batch):
        some = {t: tops[t] for t in range(low, min(low + batch, trees))}
        open_ = {t: [0] for t in some}
        while open_:
            tables = blocks.mapInArrow(counted(some, open_), "tree int, node int, cells binary")
            found = tables.groupBy("tree", "node").applyInPandas(decided, "tree int, node int, held long, feature int, cut int, gain double, c0 double, c1 double, lw double, lp double, lheld long, times long, ltimes long").collect()  # a row for each node above the groups
            open_ = {}
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                top, w = tops[r["tree"]], r["c0"] + r["c1"]
                top.more[r["node"]] = (r["gain"], r["c0"], r["c1"], r["held"])
                if r["feature"] < 0:
                    ended.setdefault(r["tree"], set()).add(r["node"])
                    continue
                children = top.split(r["node"], r["feature"], r["cut"])
                for at, cw, cp, held, times in zip(children, (r["lw"], w - r["lw"]), (r["lp"], r["c1"] - r["lp"]), (r["lheld"], r["held"] - r["lheld"]),
                                                   (r["ltimes"], r["times"] - r["ltimes"])):
                    if times > group:
                        top.more[at] = (-1.0, cw - cp, cp, held)
                        if 0 < cp < cw and top.depth[at] < depth:
                            open_.setdefault(r["tree"], []).append(at)
                        else:
                            ended.setdefault(r["tree"], set()).add(at)
    batch = max(1, COPIES // max(n, 1))
    for low in range(0, trees, batch):
        some = {t: tops[t] for t in range(low, min(low + batch, trees))}
        rows = blocks.mapInArrow(dealt(some, ended), "tree int, node int, x binary")
        nodes = rows.groupBy("tree", "node").applyInPandas(finished(some), "tree int, node int, id int, feature int, threshold double, gain double, c0 double, c1 double, held long, left int")
        written.append(stable(nodes, "forest_nodes"))
    blocks.unpersist()
    nodes = written[0]
    for more in written[1:]:
        nodes = nodes.unionByName(more)
    return _stored(spark, est, width, tops, nodes, cut_at)


def _placed(top: Top, lines: dict[int, tuple], cuts: dict[int, np.ndarray]) -> tuple[list[tuple], dict[int, int]]:
    """(nodes above the groups as Spark stores them, first number of each group's nodes), after merging sibling leaves that
    predict alike; lines: nodes, weight of either class and rows of every group."""
    leaf = {at: lines[at][1:] if at in lines else top.more[at][1:] for at in range(len(top.left)) if top.left[at] < 0 and (at not in lines or lines[at][0] == 1)}
    for at in reversed(range(len(top.left))):
        if top.left[at] >= 0:
            a, b = leaf.get(top.left[at]), leaf.get(top.left[at] + 1)
            if a and b and (a[1] > a[0]) == (b[1] > b[0]):
                leaf[at] = tuple(u + v for u, v in zip(a, b))
    order = [0]
    for at in order:
        if top.left[at] >= 0 and at not in leaf:
            order += [top.left[at], top.left[at] + 1]
    above = [at for at in order if top.left[at] >= 0 or at not in lines]
    name, size = {at: i for i, at in enumerate(above)}, len(above)
    first: dict[int, int] = {}
    for at in order:
        if at not in name:
            name[at] = first[at] = size
            size += lines[at][0]
    rows = []
    for at in above:
        if top.left[at] >= 0 and at not in leaf:
            gain, c0, c1, held = top.more[at]
            below = (gain, name[top.left[at]], name[top.left[at] + 1], (top.feature[at], [float(cuts[top.feature[at]][top.cut[at]])], -1))
        else:  # merged, or of many rows, or no row has come here
            (c0, c1, held), below = leaf[at], (-1.0, -1, -1, (-1, [], -1))
        w = c0 + c1
        rows.append((name[at], float(c1 > c0), 2.0 * c0 * c1 / w ** 2 if w else 0.0, [c0, c1], int(held), *below))
    return rows, first


def _stored(spark, est: RandomForestClassifier, width: int, tops: dict[int, Top], nodes: DataFrame, cuts: dict[int, np.ndarray]) -> StoredForest:  # noqa: ANN001
    """The trees as a model of Spark's own, written in the form in which Spark stores one: that of a model of one split gives
    the form, its trees are replaced."""
    weighted = est.isDefined(est.weightCol) and est.getWeightCol()
    names = [est.getLabelCol(), est.getFeaturesCol()] + ([est.getWeightCol()] if weighted else [])
    tiny = spark.createDataFrame([(float(i), Vectors.dense([float(i)] * width), *([1.0] if weighted else [])) for i in range(2)], names)
    form, path = (scratch_path(spark, f"forests/{uuid.uuid4().hex}") for _ in range(2))
    est.copy({est.numTrees: 1, est.maxDepth: 1, est.subsamplingRate: 1.0}).fit(tiny).write().overwrite().save(form)

    def settings(text: str, **own) -> str:  # noqa: ANN003
        held = json.loads(text)
        real = {q.name: est.getOrDefault(q) for q in (est.numTrees, est.maxDepth, est.subsamplingRate)}
        held["paramMap"] |= {k: v for k, v in real.items() if k in held["paramMap"] or k in held["defaultParamMap"]}
        return json.dumps(held | own)

    whole = settings(spark.read.text(f"{form}/metadata").first()[0], numTrees=len(tops))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = spark.read.parquet(f"{form}/treesMetadata")
    one = each.first()[1]
    named = [(t, settings(one, uid=f"{json.loads(one)['uid']}_{t}"), 1.0) for t in tops]
    spark.createDataFrame(named, each.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")

    lines: dict[int, dict[int, tuple]] = {t: {} for t in tops}
    summary = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("id") == 0, F.col(c))).alias(c) for c in ("c0", "c1", "held")])
    for r in summary.collect():  # a line for each group of rows
        lines[r["tree"]][r["node"]] = (r["n"], r["c0"], r["c1"], r["held"])
    placed = {t: _placed(top, lines[t], cuts) for t, top in tops.items()}
    schema = spark.read.parquet(f"{form}/data").schema
    above = spark.createDataFrame([(t, row) for t, (rows, _) in placed.items() for row in rows], schema)
    firsts = spark.createDataFrame([(t, at, first) for t, (_, found) in placed.items() for at, first in found.items()], "tree int, node int, first int")
    kept = nodes.join(F.broadcast(firsts), ["tree", "node"])  # a line for each group
    w, leaf = F.col("c0") + F.col("c1"), F.col("left") < 0
    below = lambda step: F.when(leaf, -1).otherwise(F.col("first") + F.col("left") + step)
    split = F.struct(F.col("feature"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")), F.lit(-1))
    node = F.struct(F.col("first") + F.col("id"), (F.col("c1") > F.col("c0")).cast("double"), 2.0 * F.col("c0") * F.col("c1") / (w * w), F.array("c0", "c1"),
                    F.col("held"), F.col("gain"), below(0), below(1), split)
    kinds = dict((f.name, f.dataType) for f in schema.fields)
    kept = kept.select(F.col("tree").cast(kinds["treeID"]).alias("treeID"), node.cast(kinds["nodeData"]).alias("nodeData"))
    kept.unionByName(above).write.parquet(f"{path}/data")
    return StoredForest(path, est.getFeaturesCol())


class StoredForest(Model, MLWritable, MLReadable):
    """A forest for two classes that stays where it is written, in the form in which Spark stores one. A model of Spark's own is
    a web of objects in the driver, sent along with every task; here rows are scored by flat arrays of the nodes
    (14 bytes each), which a worker reads once, and importances are added up where the nodes lie. Whatever else is
    asked is answered by Spark's model, which is read then."""

    def __init__(self, path: str, features: str = "features"):
        super().__init__()
        self.path, self.features = path, features

    def __getattr__(self, name: str):  # noqa: ANN204
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.spark_model, name)

    @cached_property
    def spark_model(self) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(self.path)

    @cached_property
    def _settings(self) -> dict:
        return json.loads(SparkSession.active().read.text(f"{self.path}/metadata").first()[0])

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return self._settings["numFeatures"]

    @cached_property
    def _nodes(self) -> DataFrame:
        node, split = (lambda c: F.col(f"nodeData.{c}")), "nodeData.split.leftCategoriesOrThreshold"
        c0, c1 = (F.col("nodeData.impurityStats")[i] for i in (0, 1))
        return SparkSession.active().read.parquet(f"{self.path}/data").select(
            F.col("treeID").alias("tree"), node("id").alias("id"), node("leftChild").alias("left"), node("rightChild").alias("right"), node("split.featureIndex").alias("feature"),
            node("split.numCategories").alias("categories"), F.try_element_at(split, F.lit(1)).alias("threshold"), node("gain").alias("gain"), c0.alias("c0"), c1.alias("c1"))

    @cached_property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Spark's: of every tree the gains by the weight of the nodes, as shares, added up and again as shares."""
        own = self._nodes.filter("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * (F.col("c0") + F.col("c1"))).alias("v"))
        share = F.col("v") / F.sum("v").over(Window.partitionBy("tree"))
        found = np.zeros(self.numFeatures)
        for r in own.select("feature", share.alias("v")).groupBy("feature").agg(F.sum("v").alias("v")).collect():  # a row for each feature
            found[r["feature"]] = r["v"] or 0.0
        return DenseVector(found / found.sum() if found.sum() > 0 else found)

    @cached_property
    def _arrays(self):  # noqa: ANN202
        """The trees' arrays, sent to the executors: feature (-1: a leaf), left child, whose sibling is beside it, and threshold, or
        a leaf's share of class 1 (not a number where it has none)."""
        def flat(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            if ((pdf["left"] >= 0) & (pdf["categories"] >= 0)).any():
                raise ValueError("rows are scored by splits on numbers; the model has splits on categories")
            left, right, where = pdf["left"].to_numpy(), pdf["right"].to_numpy(), pdf["id"].to_numpy()
            order, level = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
            while len(level):
                inner = np.searchsorted(where, level)
                inner = inner[left[inner] >= 0]
                level = np.stack([left[inner], right[inner]], axis=1).ravel().astype(np.int64)
                order.append(level)
            at = np.searchsorted(where, np.concatenate(order))
            leaf = left[at] < 0
            child = np.where(leaf, 0, 2 * np.cumsum(~leaf) - 1)
            c0, c1 = pdf["c0"].to_numpy()[at], pdf["c1"].to_numpy()[at]
            share = np.where(c0 + c1 > 0, c1 / np.maximum(c0 + c1, 1e-300), np.nan)
            number = np.where(leaf, share, pdf["threshold"].to_numpy(float)[at])
            feature = np.where(leaf, -1, pdf["feature"].to_numpy()[at])
            return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "feature": [feature.astype(np.int16).tobytes()], "left": [child.astype(np.int32).tobytes()], "number": [number.tobytes()]})

        rows = self._nodes.groupBy("tree").applyInPandas(flat, "tree int, feature binary, left binary, number binary").collect()  # 14 bytes a node
        trees = [(r["feature"], r["left"], r["number"]) for r in sorted(rows, key=lambda r: r["tree"])]
        return SparkSession.active().sparkContext.broadcast([tuple(map(bytes, t)) for t in trees])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The columns that Spark's model adds: rawPrediction, probability, prediction."""
        held, names = self._arrays, self._settings["paramMap"]

        @F.pandas_udf("array<double>")
        def votes(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_list())
            total, ones = np.zeros(len(x)), np.zeros(len(x))
            for feature, left, number in held.value:
                share = _leaf_shares(x, np.frombuffer(feature, np.int16), np.frombuffer(left, np.int32), np.frombuffer(number))
                known = ~np.isnan(share)
                total += known
                ones += np.where(known, share, 0.0)
            return pd.Series(list(np.stack([total - ones, ones], axis=1)))

        v, given = F.col("_votes"), [names.get(f"{k}Col", k) for k in ("rawPrediction", "probability", "prediction")]
        scored = dataset.withColumn("_votes", votes(vector_to_array(F.col(self.features))))
        return scored.withColumns({given[0]: array_to_vector(v), given[1]: array_to_vector(F.transform(v, lambda one: one / (v[0] + v[1]))),
                                   given[2]: (v[1] > v[0]).cast("double")}).drop("_votes")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


def _leaf_shares(x: np.ndarray, feature: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
    """What is held by the leaves that the rows ``x`` reach; a missing value goes right."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    if feature[0] < 0:
        return np.full(len(x), number[0])
    while len(rows):
        own = at[rows]
        own = left[own] + ~(x[rows, feature[own]] <= number[own])
        at[rows] = own
        rows = rows[feature[own] >= 0]
    return number[at]


class _ForestWriter(MLWriter):
    def __init__(self, model: StoredForest):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark, own = SparkSession.active(), self.model.path
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"features": self.model.features})
        spark.read.text(f"{own}/metadata").coalesce(1).write.text(f"{path}/forest/metadata")
        for part in ("treesMetadata", "data"):
            spark.read.parquet(f"{own}/{part}").write.parquet(f"{path}/forest/{part}")


class _ForestReader(MLReader):
    def load(self, path: str) -> StoredForest:
        found = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = StoredForest(f"{path}/forest", found["features"])
        model._resetUid(found["uid"])
        return model
