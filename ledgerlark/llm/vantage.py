"""Near-duplicates by 64-bit similarity fingerprints, searched in vantage-point trees.

Every text's word windows vote on 64 bits. Equal fingerprints are one class. The classes are dealt
into shards by a vantage-point tree that is fitted on a bounded sample: at a node with vantage point v
and radius m a fingerprint goes inside if its Hamming distance d to v is at most m + reach and outside
if d is above m. The ring (m, m + reach] overlaps the border and goes both ways; by the triangle
inequality two fingerprints within ``reach`` of each other then meet in a shard: if one of them is
inside m the other is inside m + reach, otherwise both are outside. Each shard goes on splitting by
vantage points of its own until a few hundred fingerprints are left, and compares those.

A shard returns a star for each group of linked fingerprints and never their pairs. Shards that hold more
than a task should (very many unlike fingerprints close together) are searched in another exact way:
two fingerprints differ in at most two bits if, and only if, both are within one bit of a common one, so
they are joined on their one-bit neighbours, at most 65 to a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stable

SHINGLE, SEED, REACH = 3, 42, 2
#: Fingerprints (those with the smallest hashes) on which the tree of the shards is fitted.
SAMPLE = 65_536
#: Levels of that tree, so at most 4,096 shards; its table has at most twice as many rows.
DEPTH = 12
#: Fingerprints that a shard should have, those that a task may hold, and those that are compared at once.
WANTED, MOST, FEW = 4_096, 200_000, 256
_BITS, _ONES = np.arange(8, dtype=np.uint64), np.uint64(0x0101010101010101)
_HIDDEN = 1 << 62  # nodes of classes none of whose rows has an id


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the text's word windows have it set in their XXH64. Texts with fewer
    words than a window are one window; those without words give 0."""
    words = text.lower().split()  # of bytes: only A-Z change, and only ASCII blanks part words
    if not words:
        return 0
    said = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    k = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    votes = np.zeros((8, 8), np.int64)  # by bit of a byte, then by byte
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        spans = zip(start[i:j].tolist(), end[i + k - 1 : j + k - 1].tolist())
        h = np.fromiter((digest(said[a:b], SEED) for a, b in spans), "<u8", j - i)
        # every byte of a number counts one bit of that byte, for 255 windows at most
        lanes = (h[None, :] >> _BITS[:, None]) & _ONES
        votes += np.add.reduceat(lanes, np.arange(0, j - i, 255), axis=1).view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * votes > n).T.ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed number. Null texts have none set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- vantage points

def _split(fp: np.ndarray, reach: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """(vantage point, radius, distances) that leaves the least to compare; None if no split saves a tenth."""
    best = None
    for v in fp[:: max(1, len(fp) // 4)][:4]:
        d = np.bitwise_count(fp ^ v).astype(np.int64)
        upto = np.cumsum(np.bincount(d, minlength=65 + reach))
        radius = np.arange(65)
        cost = upto[radius + reach].astype(float) ** 2 + (len(fp) - upto[radius]).astype(float) ** 2
        m = int(cost.argmin())
        if best is None or cost[m] < best[0]:
            best = (cost[m], v, m, d)
    return best[1:] if best and best[0] < 0.9 * float(len(fp)) ** 2 else None


def fit(sample: np.ndarray, depth: int, reach: int = REACH) -> np.ndarray:
    """The tree of the shards, a row for each node: vantage point, radius, row of its inner and of its
    outer child. A leaf has radius -1."""
    rows: list[list] = [[0, -1, 0, 0]]
    todo = [(0, np.unique(sample), 0)]
    while todo:
        at, fp, level = todo.pop()
        cut = _split(fp, reach) if level < depth and len(fp) >= 32 else None
        if cut is None:
            continue
        v, m, d = cut
        rows[at] = [int(v), m, len(rows), len(rows) + 1]
        todo += [(len(rows), fp[d <= m + reach], level + 1), (len(rows) + 1, fp[d > m], level + 1)]
        rows += [[0, -1, 0, 0], [0, -1, 0, 0]]
    return np.array([tuple(r) for r in rows], [("v", "u8"), ("m", "i8"), ("inside", "i8"), ("outside", "i8")])


def route(fp: np.ndarray, tree: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard to which each fingerprint belongs; a shard's number is its leaf's row."""
    row, node, done = np.arange(len(fp)), np.zeros(len(fp), np.int64), []
    while len(row):
        at = tree[node]
        leaf = at["m"] < 0
        done.append((row[leaf], node[leaf]))
        row, at = row[~leaf], at[~leaf]
        d = np.bitwise_count(fp[row] ^ at["v"]).astype(np.int64)
        inside, outside = d <= at["m"] + reach, d > at["m"]
        node = np.concatenate((at["inside"][inside], at["outside"][outside]))
        row = np.concatenate((row[inside], row[outside]))
    return tuple(np.concatenate(c) for c in zip(*done)) if done else (row, node)


class _Groups:
    """Smallest member of each group of linked places; links are taken in and merged a million at a time."""

    def __init__(self, n: int) -> None:
        self.first, self.held, self.size = np.arange(n), [], 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size >= 1 << 20:
            self.merge()

    def merge(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(c) for c in zip(*self.held))
            while len(a):
                x, y = self.first[a], self.first[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(self.first, np.maximum(x, y), np.minimum(x, y))
                while (up := self.first[self.first]).tobytes() != self.first.tobytes():
                    self.first = up
        self.held, self.size = [], 0
        return self.first


def linked(fp: np.ndarray, reach: int = REACH) -> np.ndarray:
    """For each of these distinct fingerprints the place of the first one of its group, by links within ``reach``."""
    groups, todo = _Groups(len(fp)), [np.arange(len(fp))]
    while todo:
        at = todo.pop()
        own = fp[at]
        cut = _split(own, reach) if len(at) > FEW else None
        if cut is not None:
            _, m, d = cut
            todo += [at[d <= m + reach], at[d > m]]
            continue
        for i in range(0, len(at), FEW):  # one block against all that follow it
            near = np.bitwise_count(own[i : i + FEW, None] ^ own[None, i:]) <= reach
            a, b = np.nonzero(near)
            after = a < b
            groups.link(at[i + a[after]], at[i + b[after]])
    return groups.merge()


# ---------------------------------------------------------------- on Spark

def _by_neighbours(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join all pairs of ``rows`` (fp, node) within two bits: a star for each number that is
    within one bit of several fingerprints."""
    around = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    hubs = rows.select("node", F.explode(F.transform(around, lambda x: F.col("fp").bitwiseXOR(x))).alias("hub"))
    held = hubs.groupBy("hub").agg(F.collect_set("node").alias("nodes")).filter("size(nodes) > 1")  # at most 65
    return held.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a < b").distinct()


def links(classes: DataFrame, sample: int = SAMPLE, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """Links (a, b) between nodes of ``classes`` (fp, node; a row for each fingerprint) that connect exactly
    what links within two bits connect."""
    n = classes.count()
    if n < 2:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    drawn = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    # every level leaves about 0.6 of a node's fingerprints in either half
    tree = fit(np.sort(drawn.view(np.uint64)), min(depth, max(0, int(np.ceil(np.log(n / WANTED) / np.log(1 / 0.6))))))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, shard = route(b.column("fp").to_numpy().view(np.uint64), tree)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(b.column(c).take(pa.array(row)) for c in ("fp", "node"))], names=["shard", "fp", "node"])

    dealt = stable(classes.select("fp", "node").mapInArrow(routed, "shard long, fp long, node long"), "vantage_shards")
    sizes = dealt.groupBy("shard").count()  # at most as many rows as the tree has leaves
    full = [r["shard"] for r in sizes.filter(F.col("count") > most).collect()]

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        by = np.argsort(node)
        fp, node = fp[by], node[by]
        first = linked(fp)
        other = np.flatnonzero(first != np.arange(len(fp)))
        return pa.table({"a": node[first[other]], "b": node[other]})

    held = dealt.filter(~F.col("shard").isin(full)) if full else dealt
    found = held.groupBy("shard").applyInArrow(compared, "a long, b long")
    if full:
        found = found.union(_by_neighbours(dealt.filter(F.col("shard").isin(full)).select("fp", "node").distinct()))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable
    over fingerprints that differ in at most two bits).

    Null, empty and blank texts have fingerprint zero, which links like any other. Case of A-Z is
    ignored. Texts with fewer words than a window are one window; long texts are read whole. Repeated
    rows of one id with unlike texts are rows of their own, and link if their fingerprints do. Rows
    without an id link as others; a component without any id has component_id null. Other columns
    are ignored, whatever their names. An empty table gives no rows. limits: of :func:`links`."""
    rows = stable(fingerprints(docs, shingle, id_col, text_col), "vantage_rows")
    node = F.coalesce(F.min("doc_id"), F.lit(_HIDDEN) + F.shiftright(F.abs(F.xxhash64("fp")), 2))
    # an id may be the smallest of several classes: all but one of them get numbers that no id has
    classes = rows.groupBy("fp").agg(node.alias("own"))
    main = classes.groupBy("own").agg(F.min("fp").alias("main"))
    classes = classes.join(main, "own").select("fp", "own", F.when(F.col("fp") == F.col("main"), F.col("own")).otherwise(F.lit(_HIDDEN) + F.shiftright(F.abs(F.xxhash64("fp", "own")), 2)).alias("node"))
    classes = stable(classes, "vantage_classes")
    named = components(links(classes.select("fp", "node"), **limits))
    named = classes.join(named, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "own")
    # a class keeps the smallest id of its component: a hidden number is larger than any id
    least = named.groupBy("component").agg(F.min("own").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("component_id") < _HIDDEN, F.col("component_id")).alias("component_id"))
