"""Exact contributions of tree ensembles to each row's score.

A feature's contribution is its Shapley value for the game in which unknown features follow the
training rows down each split by the split's share of them. For one leaf the game is a product over the
features on its path: feature j multiplies the leaf's value by 1 if the row meets all of the path's
conditions on j (else 0) when j is known, and by the share of training rows z_j that do when it is not.
The weights of all subsets of the other features are carried down the path as the coefficients of
the polynomial prod(z_j + o_j t); dividing one factor out gives the weight of that feature. So
contributions plus the base (the ensemble's mean over its training rows) are the row's score.

A tree is cut into parts, subtrees with the splits above them, of few splits each. The sum of the contributions of all
leaves of a part is tabulated once for every outcome of its splits, feature by feature; rows are then scored in Arrow
batches by a lookup for each part and feature. Leaves under more splits than a table takes are scored one by one from
arrays of their paths. All of it is bounded by the model (trees x leaves) whatever the rows are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Parts of a tree with at most this many splits, and single paths with at most this many features, use tables.
TABLED = 10
#: Rows that are scored at once.
ROWS = 1 << 13
#: Numbers in one block of (rows, leaves, features).
BLOCK = 1 << 22


def subset_weights(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Contribution of every feature of a path with leaf value 1. z: shares of training rows (..., m), all
    above 0; o: whether the row meets the path's conditions on each feature (..., m)."""
    m = z.shape[-1]
    o = o.astype(float)
    shape = np.broadcast_shapes(z.shape, o.shape)
    coef = np.zeros((*shape[:-1], m + 1))
    coef[..., 0] = 1.0
    for j in range(m):
        nxt = coef * z[..., j, None]
        nxt[..., 1:] += coef[..., :-1] * o[..., j, None]
        coef = nxt
    weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    out = np.empty(shape)
    for i in range(m):
        zi, met = np.broadcast_to(z[..., i], shape[:-1]), np.broadcast_to(o[..., i], shape[:-1]) > 0
        total = np.zeros(shape[:-1])
        rest = coef[..., m]  # of the quotient by (z + t), from its highest power down
        for k in range(m - 1, -1, -1):
            total += weight[k] * np.where(met, rest, coef[..., k] / zi)
            rest = coef[..., k] - zi * rest
        out[..., i] = (met - zi) * total
    return out


@dataclass
class Paths:
    """All leaves whose path has the same number of features: features (leaves, m), their ranges (low, high],
    shares of training rows, and the leaves' weighted values."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @cached_property
    def table(self) -> np.ndarray:
        """(leaves, outcomes, m): contributions for every outcome of the path's conditions."""
        m = self.feature.shape[1]
        outcome = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        return subset_weights(self.share[:, None, :], outcome[None, :, :]) * self.value[:, None, None]

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds the leaves' contributions for the rows ``x`` to ``out`` (rows, features)."""
        leaves, m = self.feature.shape
        step = max(1, BLOCK // max(1, len(x) * m))
        for s in range(0, leaves, step):
            part = slice(s, min(leaves, s + step))
            seen = x[:, self.feature[part]]
            # a missing value is on no side of a threshold and goes right
            met = ~(seen <= self.low[part]) & ((seen <= self.high[part]) | np.isposinf(self.high[part]))
            if m <= TABLED:
                outcome = (met << np.arange(m)).sum(axis=2)
                given = self.table[np.arange(s, part.stop)[None, :], outcome]
            else:
                given = subset_weights(self.share[part][None], met) * self.value[part][None, :, None]
            to = np.zeros((given.shape[1] * m, out.shape[1]))
            to[np.arange(len(to)), self.feature[part].ravel()] = 1.0
            out += given.reshape(len(x), -1) @ to


@dataclass
class Part:
    """A subtree and the splits above it: (feature, threshold) of its splits, and for each of its leaves its weighted value
    and the splits on its path as {feature: (share of training rows, [(place of the split, whether it is passed on the right)])}."""

    splits: list[tuple[int, float]]
    leaves: list[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]

    @cached_property
    def table(self) -> dict[int, np.ndarray]:
        """Per feature the leaves' contributions for every outcome (bit i: split i is passed on the right)."""
        outcome, out = np.arange(1 << len(self.splits)), {}
        for value, path in self.leaves:
            met, m = np.zeros(len(outcome), np.intp), len(path)
            for i, (_, passed) in enumerate(path.values()):
                mask = sum(1 << at for at, _ in passed)
                met |= ((outcome & mask) == sum(1 << at for at, right in passed if right)).astype(np.intp) << i
            share = np.array([z for z, _ in path.values()])
            given = subset_weights(share, (np.arange(1 << m)[:, None] >> np.arange(m)) & 1) * value
            for i, f in enumerate(path):
                out[f] = out.get(f, 0.0) + given[met, i]
        return out

    def add(self, right: dict[tuple[int, float], np.ndarray], out: np.ndarray) -> None:
        """Adds the contributions for rows to ``out`` (features, rows); right: whether the rows pass a split on the right."""
        at = np.zeros(out.shape[1], np.uint16)
        for i, split in enumerate(self.splits):
            at |= right[split] << np.uint16(i)
        at = at.astype(np.intp)
        for f, given in self.table.items():
            out[f] += given[at]


class Ensemble:
    """The leaves of a tree ensemble, in tabulated parts of trees and, where paths are long, by the number of features on
    their paths, and its base value."""

    def __init__(self, nodes: pd.DataFrame):
        """nodes: tree, node, left, right (-1: leaf), feature, threshold, count (weight of training rows),
        value (of a leaf, with the tree's weight)."""
        held: dict[int, list] = defaultdict(list)
        self.base, self.parts = 0.0, []
        for _, t in nodes.groupby("tree"):
            left, right, feature, threshold, count, value = (t.sort_values("node")[c].to_numpy() for c in ("left", "right", "feature", "threshold", "count", "value"))
            order, below = [0], np.zeros(len(left), np.int64)  # splits of a node's subtree, itself included
            for at in order:
                if left[at] >= 0:
                    order += [int(left[at]), int(right[at])]
            for at in reversed(order):
                if left[at] >= 0:
                    below[at] = 1 + below[left[at]] + below[right[at]]
            todo: list = [(0, {}, (), None)]
            made: list[list] = []  # the leaves of every part
            while todo:
                at, path, above, part = todo.pop()
                if part is None and 0 < len(above) + below[at] <= TABLED:
                    part = []
                    made.append(part)
                if left[at] < 0:
                    self.base += float(value[at]) * float(np.prod([s for _, _, s in path.values()]))
                    if part is not None:
                        part.append((float(value[at]), {f: (s, [v for v in above if int(feature[v[0]]) == f]) for f, (_, _, s) in path.items()}))
                    elif path:
                        held[len(path)].append((list(path), *zip(*path.values()), value[at]))
                    continue
                f, cut = int(feature[at]), float(threshold[at])
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, span, right_one in ((left[at], (low, min(high, cut)), False), (right[at], (max(low, cut), high), True)):
                    if count[child] > 0:  # no training row ever reached the others
                        todo.append((int(child), path | {f: (*span, share * count[child] / count[at])}, (*above, (at, right_one)), part))
            for leaves in made:
                splits = sorted({at for _, path in leaves for _, passed in path.values() for at, _ in passed})
                place = {at: i for i, at in enumerate(splits)}
                own = [(v, {f: (s, [(place[at], to) for at, to in passed]) for f, (s, passed) in path.items()}) for v, path in leaves]
                self.parts.append(Part([(int(feature[at]), float(threshold[at])) for at in splits], own))
        self.paths = [Paths(np.array(f), np.array(lo, float), np.array(hi, float), np.array(s, float), np.array(v, float))
                      for f, lo, hi, s, v in (zip(*rows) for rows in held.values())]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((x.shape[1], len(x)))
        for s in range(0, len(x), ROWS):
            own, given = np.ascontiguousarray(x[s : s + ROWS].T), np.zeros((x.shape[1], min(ROWS, len(x) - s)))
            # a missing value is not below a threshold and goes right
            right = {(f, cut): (~(own[f] <= cut)).astype(np.uint16) for f, cut in {split for p in self.parts for split in p.splits}}
            for p in self.parts:
                p.add(right, given)
            out[:, s : s + ROWS] = given
        out = np.ascontiguousarray(out.T)
        for p in self.paths:
            for s in range(0, len(x), 512):
                p.add(x[s : s + 512], out[s : s + 512])
        return out


def node_table(model: PipelineModel, spark) -> pd.DataFrame:  # noqa: ANN001
    """The nodes of the pipeline's fitted trees, read from the stored form of its last stage. The number of
    rows is bounded by the model's trees and depth. Values of a boosted classifier are on the scale of log-odds."""
    m = model.stages[-1]
    m = getattr(m, "spark_model", m)
    kind = type(m).__name__
    path = scratch_path(spark, f"trees/{uuid.uuid4().hex}")
    m.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        rows = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        rows = data.select(F.lit(0).alias("tree"), "*")
    split = "split.leftCategoriesOrThreshold"
    rows = rows.select("tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
                       F.col("split.numCategories").alias("categories"), F.try_element_at(split, F.lit(1)).alias("threshold"), F.col("rawCount").cast("double").alias("count"), "prediction", "impurityStats")
    nodes = rows.toPandas().sort_values(["tree", "node"], ignore_index=True)
    if ((nodes["left"] >= 0) & (nodes["categories"] >= 0)).any():
        raise ValueError("contributions are for splits on numbers; the model has splits on categories")
    weights = list(getattr(m, "treeWeights", [1.0]))
    value = nodes["prediction"].to_numpy(float)
    if kind in ("RandomForestClassificationModel", "DecisionTreeClassificationModel"):
        stats = np.stack([np.asarray(s, float) for s in nodes["impurityStats"]])
        value = stats[:, 1] / np.maximum(stats.sum(axis=1), 1e-300)
    scale = 2.0 if kind == "GBTClassificationModel" else 1.0 / len(weights) if kind.startswith("RandomForest") else 1.0
    nodes["value"] = value * np.asarray(weights, float)[nodes["tree"].to_numpy(int)] * scale
    return nodes


def tree_contributions(df: DataFrame, features: list[str], ensemble: Ensemble, out: str = "contributions") -> DataFrame:
    """Adds the array of the features' contributions, in their order, in Arrow batches. Features are numbers;
    missing ones go right at every split, as in the models."""
    bc = df.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(list(bc.value.contributions(x)))

    return df.withColumn(out, explain(*[F.col(f).cast("double") for f in features]))


def tree_waterfall(df: DataFrame, id_col: str, features: list[str], ensemble: Ensemble, max_features: int = 12) -> DataFrame:
    """A waterfall per row from the ensemble's base to the row's score: the ``max_features`` largest
    contributions by size (ties by name), then one step for all others together (feature null). Columns:
    id, base, step, feature, value, contribution, start, end. A row's steps are made inside the row."""
    given = tree_contributions(df, features, ensemble, "_given")
    item = lambda i, f: F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("_given")[i].alias("contribution"))
    keyed = F.array_sort(F.transform(F.array(*[item(i, f) for i, f in enumerate(features)]), lambda s: F.struct((-F.abs(s["contribution"])).alias("k"), s["feature"].alias("f"), s.alias("s"))))
    ordered = F.transform(keyed, lambda k: k["s"])
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda acc, s: acc + s["contribution"])
    row = given.select(id_col, ordered.alias("_o"))
    if max_features < len(features):
        rest = F.slice("_o", max_features + 1, len(features))
        other = F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"), total(rest).alias("contribution"))
        row = row.select(id_col, F.concat(F.slice("_o", 1, max_features), F.array(other)).alias("_o"))
    steps = F.transform("_o", lambda s, i: F.struct((i + 1).alias("step"), s["feature"].alias("feature"), s["value"].alias("value"), s["contribution"].alias("contribution"),
                                                    (F.lit(ensemble.base) + total(F.slice("_o", 1, i + 1))).alias("end")))
    out = row.select(id_col, F.lit(ensemble.base).alias("base"), F.inline(steps))
    return out.select(id_col, "base", "step", "feature", "value", "contribution", (F.col("end") - F.col("contribution")).alias("start"), "end")
