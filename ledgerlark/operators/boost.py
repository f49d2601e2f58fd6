"""Boosted trees for two classes, for many rounds over many rows.

The method and the fitted model are those of Spark's ``GBTClassifier``: trees of variance gain on the pseudo-residuals
of the log loss, features in at most ``maxBins`` ranges, a new draw of ``subsamplingRate`` of the rows every round.
Only the way is another. Rows are held as bytes of bins, and one stage without a shuffle grows a level: every partition
adds up weights and residuals by (node, bin), two features at a time, and the driver adds the partitions' tables,
whose size depends on depth and bins only. Of two siblings the lighter is counted, the other is the rest of
their parent. A round has as many jobs as levels: the first of them also moves the scores by the tree before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import scratch_path

#: Rows that cut points are found from, rows of a block, and rows that are worth a partition of their own.
CUT_ROWS, BLOCK_ROWS, PART_ROWS = 50_000, 1 << 17, 1 << 22
#: Rounds after which scores are computed anew from the rows, which ends their lineage.
RENEW = 50
#: Up to so many partitions their tables go straight to the driver; beyond, executors add them up first.
PARTS = 64


@dataclass
class Tree:
    """Nodes by heap place (children of i: 2i+1, 2i+2): feature (-1: no split), last bin on the left, gain, value."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))


@dataclass
class Block:
    """Rows of one task: ``keys`` (pairs of features, rows) hold two bins each; y is 1 or -1, score the sum of the trees
    so far, drawn whether this round's tree learns from the row."""

    keys: np.ndarray
    y: np.ndarray
    weight: np.ndarray | None
    score: np.ndarray
    drawn: np.ndarray
    #: (4, nodes): of the tree before, the rows it learnt from where they end: number, weight, sums of residuals, of squares.
    ended: np.ndarray | None = None

    def reached(self, tree: Tree, levels: int, width: int, rows: np.ndarray, wanted: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
        """``rows`` by the heap place that they have reached after ``levels`` splits; of ``wanted`` places only, if they are
        given. The rows of a node are kept together, so that a level costs one look at a feature and one parting."""
        lead = np.ones(len(tree.feature), bool)
        if wanted is not None:
            lead[:] = False
            while len(wanted):
                lead[wanted] = True
                wanted = (wanted[wanted > 0] - 1) // 2
        found = [(0, rows)]
        for _ in range(levels):
            below = []
            for at, own in found:
                f, cut = int(tree.feature[at]), int(tree.cut[at])
                if f < 0:
                    below.append((at, own))
                    continue
                key = self.keys[f >> 1][own]
                right = key % width > cut if f & 1 else key >= (cut + 1) * width
                if lead[2 * at + 1]:
                    below.append((2 * at + 1, own[~right]))
                if lead[2 * at + 2]:
                    below.append((2 * at + 2, own[right]))
            found = below
        return found

    def nodes(self, tree: Tree, levels: int, width: int) -> np.ndarray:
        """The heap place that every row has reached after ``levels`` splits."""
        at = np.empty(self.keys.shape[1], np.int64)
        for place, own in self.reached(tree, levels, width, np.arange(len(at))):
            at[own] = place
        return at

    def residual(self, rows: np.ndarray, first: bool) -> np.ndarray:
        """What the round's tree is fitted to: the classes in the first round, then the loss's negative gradient."""
        y = self.y[rows].astype(float)
        return y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * self.score[rows]))


def cut_points(sample: np.ndarray, most: int) -> list[np.ndarray]:
    """Per feature at most ``most`` - 1 thresholds: between all values of the sample if they are few, else
    at its quantiles."""
    found = []
    for x in sample.T:
        value, count = np.unique(x, return_counts=True)
        if len(value) > most:
            upto = np.cumsum(count)
            at = np.searchsorted(upto, upto[-1] * np.arange(1, most) / most)
            at = np.unique(np.minimum(at, len(value) - 2))
        else:
            at = np.arange(len(value) - 1)
        found.append((value[at] + value[at + 1]) / 2 if len(value) > 1 else np.zeros(0))
    return found


def _binned(rows: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[np.ndarray], width: int):
    """RDD of (keys, y, weight) blocks of the rows."""
    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    cols += [F.col(label).cast("double").alias("y")] + ([F.col(weight).cast("double").alias("w")] if weight else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(p, axis=-1) for p in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["keys", "y", "w"])

        for b in batches:
            keys = np.zeros(((len(cuts) + 1) // 2, b.num_rows), np.uint16)
            for i, cut in enumerate(cuts):
                x = b.column(f"x{i}").to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    raise ValueError(f"boosted trees are fitted to finite values; {features[i]} has others")
                found = np.searchsorted(cut, x, "left").astype(np.uint16)
                keys[i // 2] += found if i % 2 else found * np.uint16(width)
            y = np.where(b.column("y").to_numpy(zero_copy_only=False) > 0, 1, -1).astype(np.int8)
            held.append((keys, y, b.column("w").to_numpy(zero_copy_only=False) if weight else np.zeros(0)))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    def blocks(rows) -> Iterator[tuple]:  # noqa: ANN001
        for r in rows:
            y = np.frombuffer(r["y"], np.int8)
            yield np.frombuffer(r["keys"], np.uint16).reshape(-1, len(y)), y, np.frombuffer(r["w"]) if weight else None

    return rows.select(*cols).mapInArrow(run, "keys binary, y binary, w binary").rdd.mapPartitions(blocks)


def _added(rdd) -> np.ndarray:  # noqa: ANN001
    """The sum of the partitions' tables (one each), in the order of the partitions where they are few."""
    if rdd.getNumPartitions() > PARTS:
        return rdd.treeReduce(np.add, depth=2)
    total = None
    for one in rdd.collect():
        total = one if total is None else total + one
    return total


def _table(blocks: Iterator[Block], tree: Tree, level: int, slot: np.ndarray, width: int, first: bool) -> Iterator[np.ndarray]:
    """The flat (2, features, slots, bins) sums of weights and of weighted residuals of the drawn rows by (node's slot,
    bin), and after them the sums of :attr:`Block.ended`."""
    slots, total, ended, wanted = int(slot.max()) + 1, None, np.zeros(4 * len(tree.feature)), np.flatnonzero(slot >= 0)
    for b in blocks:
        found = [(slot[at], rows) for at, rows in b.reached(tree, level, width, np.flatnonzero(b.drawn), wanted) if slot[at] >= 0]
        take = np.concatenate([rows for _, rows in found])
        given = b.residual(take, first)
        weight = None if b.weight is None else b.weight[take]
        if weight is not None:
            given *= weight
        base = np.repeat([own * width * width for own, _ in found], [len(rows) for _, rows in found])
        if total is None:
            total = np.zeros((2, len(b.keys), slots * width * width))
        for p, key in enumerate(b.keys):
            cell = base + key[take]
            total[0, p] += np.bincount(cell, weight, slots * width * width)
            total[1, p] += np.bincount(cell, given, slots * width * width)
        if b.ended is not None:
            ended += b.ended.ravel()
    if total is not None:
        both = total.reshape(2, -1, slots, width, width)
        yield np.concatenate([np.stack([both.sum(axis=4), both.sum(axis=3)], axis=2).ravel(), ended])


def _tables(*args):  # noqa: ANN002, ANN202
    return lambda blocks: _table(blocks, *args)


def _ended(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
    found = [b.ended for b in blocks]
    if found:
        yield np.sum(found, axis=0)


def _leaf_sums(b: Block, at: np.ndarray, nodes: int, first: bool) -> np.ndarray:
    """:attr:`Block.ended` for the rows that ended at ``at``."""
    take = np.flatnonzero(b.drawn)
    r, w = b.residual(take, first), np.ones(len(take)) if b.weight is None else b.weight[take]
    return np.stack([np.bincount(at[take], v, nodes) for v in (np.ones(len(take)), w, w * r, w * r * r)])


def _split(tree: Tree, at: int, table: np.ndarray, cuts: list[np.ndarray], least: int, min_gain: float) -> tuple[float, float] | None:
    """Sets the best split of a node from its table (2, features, bins); the weights of its children, or None for a leaf."""
    left = np.cumsum(table, axis=2)
    (lw, ls), (w, s) = left, left[:, :1, -1:]
    rw, rs = w - lw, s - ls
    total = float(w[0, 0])
    if total <= 0:
        return None
    least = max(least, 1e-9 * total)  # a difference of sums of weights may be not quite zero
    ok = (lw >= least) & (rw >= least)
    ok &= np.arange(table.shape[2])[None, :] < np.array([len(c) for c in cuts])[:, None]
    gain = np.where(ok, ls * ls / np.where(ok, lw, 1.0) + rs * rs / np.where(ok, rw, 1.0) - s * s / total, -np.inf) / total
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, cut] > 1e-14 + 1e-12 * float(s[0, 0] / total) ** 2 or gain[f, cut] < min_gain:
        return None
    tree.feature[at], tree.cut[at], tree.gain[at] = f, cut, gain[f, cut]
    for child, cw, cs in ((2 * at + 1, lw, ls), (2 * at + 2, rw, rs)):
        tree.value[child] = cs[f, cut] / cw[f, cut]
    return float(lw[f, cut]), float(rw[f, cut])


def fit_boosted(train: DataFrame, features: list[str], est: GBTClassifier) -> GBTClassificationModel:
    """The model of ``est``, fitted to the columns ``features``; a missing value among them is an error, as in
    Spark's own fit."""
    p = {q.name: est.getOrDefault(q) for q in est.params if est.isDefined(q)}
    if p["featureSubsetStrategy"] not in ("all", "auto") or p["minWeightFractionPerNode"] > 0 or p.get("validationIndicatorCol"):
        raise ValueError("boosted trees look at all features of all nodes, without validation rows")
    depth, width, rounds, rate = p["maxDepth"], p["maxBins"], p["maxIter"], p["subsamplingRate"]
    label, weight, seed = p["labelCol"], p.get("weightCol"), p["seed"]
    if width > 256 or weight and p["minInstancesPerNode"] > 1:
        raise ValueError("at most 256 bins, and weighted rows with one row a leaf at least")
    sc = train.sparkSession.sparkContext
    n = train.count()
    sample = train.select(*[F.col(f).cast("double") for f in features]).sample(fraction=min(1.0, 1.1 * CUT_ROWS / max(n, 1)), seed=seed)
    cuts = cut_points(sample.limit(CUT_ROWS).toPandas().to_numpy(float), width)  # a bounded sample
    cores = sc.defaultParallelism  # as many partitions for every core, so that none waits for another
    parts = max(cores * -(-n // (PART_ROWS * cores)) if n > PART_ROWS else 0, min(cores, -(-n // 10_000)), 1)
    if train.rdd.getNumPartitions() != parts:
        train = train.repartition(parts)
    base = _binned(train, features, label, weight, cuts, width)

    least = 0 if weight else p["minInstancesPerNode"]

    def drawn(part: int, number: int, turn: int, rows: int) -> np.ndarray:
        return np.random.default_rng([seed % (1 << 63), turn, part, number]).random(rows) < rate if rate < 1.0 else np.ones(rows, bool)

    def begin(part: int, blocks: Iterator[tuple], turn: int, trees: list[tuple[float, Tree]]) -> Iterator[Block]:
        for i, (keys, y, w) in enumerate(blocks):
            b = Block(keys, y, w, np.zeros(len(y)), drawn(part, i, turn, len(y)))
            for share, tree in trees:
                b.score += share * tree.value[b.nodes(tree, depth, width)]
            yield b

    def move(part: int, blocks: Iterator[Block], turn: int, share: float, tree: Tree) -> Iterator[Block]:
        for i, b in enumerate(blocks):
            at = b.nodes(tree, depth, width)
            ended = _leaf_sums(b, at, len(tree.feature), turn == 1)
            yield Block(b.keys, b.y, b.weight, b.score + share * tree.value[at], drawn(part, i, turn, len(b.y)), ended)

    def moved(held, turn: int):  # noqa: ANN001, ANN202
        """The blocks before round ``turn`` (from 1), from those before the round before it."""
        *known, last = trees
        if turn % RENEW == 0 and turn < rounds:
            held = base.mapPartitionsWithIndex(lambda i, it: begin(i, it, turn - 1, known))
        return held.mapPartitionsWithIndex(lambda i, it: move(i, it, turn, *last)).persist(StorageLevel.MEMORY_AND_DISK)

    trees: list[tuple[float, Tree]] = []
    ends: list[np.ndarray] = []
    held, before, places = base.mapPartitionsWithIndex(lambda i, it: begin(i, it, 0, [])).persist(StorageLevel.MEMORY_AND_DISK), None, (2 << depth) - 1
    for turn in range(rounds):
        if turn:
            held, before = moved(held, turn), held
        tree, tables, nodes = Tree.empty(depth), {}, {0: 0.0}
        for level in range(depth):
            count = [at for at, w in nodes.items() if at == 0 or (w, at) < (nodes[_sibling(at)], _sibling(at))]
            slot = np.full(places, -1)
            slot[count] = np.arange(len(count))
            found = _added(held.mapPartitions(_tables(tree, level, slot, width, turn == 0)))
            if level == 0 and turn:
                ends.append(found[-4 * places :].reshape(4, -1))
            found = found[: -4 * places].reshape(2, -1, len(count), width)[:, : len(features)]
            own = {at: found[:, :, i] for i, at in enumerate(count)}
            own |= {at: tables[(at - 1) // 2] - own[_sibling(at)] for at in nodes if at not in own}
            if level == 0:
                w, s = own[0][:, 0].sum(axis=1)
                tree.value[0] = s / w if w > 0 else 0.0
            tables, nodes = own, {}
            for at, table in own.items():
                children = _split(tree, at, table, cuts, least, p["minInfoGain"])
                if children:
                    nodes |= {2 * at + 1: children[0], 2 * at + 2: children[1]}
            if not nodes:
                break
        trees.append((1.0 if turn == 0 else p["stepSize"], tree))
        if before is not None:
            before.unpersist()
    ends.append(_added(moved(held, rounds).unpersist().mapPartitions(_ended)))
    held.unpersist()
    return _spark_model(train.sparkSession, est, len(features), cuts, trees, ends)


def _sibling(at: int) -> int:
    return at + 1 if at % 2 else at - 1


def _node_rows(number: int, tree: Tree, ended: np.ndarray, cuts: list[np.ndarray]) -> list[tuple]:
    """A tree's nodes as Spark stores them, children after their parents."""
    full = ended.copy()
    places = [0]
    for at in places:
        if tree.feature[at] >= 0:
            places += [2 * at + 1, 2 * at + 2]
    for at in reversed(places):
        if tree.feature[at] >= 0:
            full[:, at] = full[:, 2 * at + 1] + full[:, 2 * at + 2]
    name = {at: i for i, at in enumerate(places)}
    rows = []
    for at in places:
        rows_, w, s, s2 = full[:, at].tolist()
        impurity = max(s2 / w - (s / w) ** 2, 0.0) if w > 0 else 0.0
        f = int(tree.feature[at])
        below = (float(tree.gain[at]), name[2 * at + 1], name[2 * at + 2], (f, [float(cuts[f][tree.cut[at]])], -1)) if f >= 0 else (-1.0, -1, -1, (-1, [], -1))
        rows.append((number, (name[at], float(tree.value[at]), impurity, [w, s, s2], round(rows_), *below)))
    return rows


def _spark_model(spark, est: GBTClassifier, width: int, cuts: list[np.ndarray], trees: list[tuple[float, Tree]], ends: list[np.ndarray]) -> GBTClassificationModel:  # noqa: ANN001
    """The trees as a model of Spark's own, read from the form in which Spark stores one: that of a model of one split
    gives the form, its trees are replaced."""
    weighted = est.isDefined(est.weightCol) and est.getWeightCol()
    names = [est.getLabelCol(), est.getFeaturesCol()] + ([est.getWeightCol()] if weighted else [])
    tiny = spark.createDataFrame([(float(i), Vectors.dense([float(i)] * width), *([1.0] if weighted else [])) for i in range(2)], names)
    form, path = (scratch_path(spark, f"boosted/{uuid.uuid4().hex}") for _ in range(2))
    est.copy({est.maxIter: 1, est.maxDepth: 1, est.subsamplingRate: 1.0}).fit(tiny).write().overwrite().save(form)

    def settings(text: str, **own) -> str:  # noqa: ANN003
        held = json.loads(text)
        given = {q.name: est.getOrDefault(q) for q in (est.maxIter, est.maxDepth, est.subsamplingRate)}
        held["paramMap"] |= {k: v for k, v in given.items() if k in held["paramMap"] or k in held["defaultParamMap"]}
        return json.dumps(held | own)

    whole = settings(spark.read.text(f"{form}/metadata").first()[0], numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = spark.read.parquet(f"{form}/treesMetadata")
    one = each.first()[1]
    named = [(i, settings(one, uid=f"{json.loads(one)['uid']}_{i}"), share) for i, (share, _) in enumerate(trees)]
    spark.createDataFrame(named, each.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [row for i, ((_, tree), ended) in enumerate(zip(trees, ends)) for row in _node_rows(i, tree, ended, cuts)]  # bounded by the model
    spark.createDataFrame(nodes, spark.read.parquet(f"{form}/data").schema).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
