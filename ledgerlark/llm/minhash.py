"""Near-duplicate documents by HyperMinHash registers, banding and verification.

A text's word windows are hashed; each of 128 buckets keeps the leading-zero count and
ten mantissa bits of its smallest hash (16 bits a register). Empty registers borrow from
a bucket chosen by hash, so equal registers stay as likely as the Jaccard similarity for
short texts too. 32 bands of 4 compressed registers propose pairs: at similarity 0.8 a
pair is missed with a chance of (1 - 0.8^4)^32 < 5e-8. A proposed pair is estimated from
its registers, corrected for chance collisions, and confirmed on the full sets.

Groups are never expanded into all pairs. Texts with equal sets are one class from the
start. The members of a band are linked to its hub, the text that shares the largest bands;
bands whose members are in one component by then are done. In the others every pair that is
still apart is compared by finer sketches inside blocks of bounded size; only pairs near the
threshold come out and are verified. So every pair that shares a band is compared or connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keys64, mix64, shingle_sets, stable

BUCKETS, MANTISSA, BANDS = 128, 10, 32
_PREFIX = 7  # bits that choose the bucket
_HIDDEN = 1 << 62  # nodes of classes none of whose rows has an id
#: Where a register is empty: the bucket tried at each attempt.
_DONORS = (keys64(96 * BUCKETS, 501) % np.uint64(BUCKETS)).astype(np.int64).reshape(96, BUCKETS)
#: An estimate this far below the threshold (about six deviations of 128 registers) drops a pair.
SLACK = 0.2
#: Bytes of a fine sketch, its slack (over five deviations), and texts in a block of a large band.
FINE, FINE_SLACK, BLOCK = 1024, 0.07, 512


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, 128) registers of sorted hash sets: leading zeros and mantissa; 0 only for an empty set."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    h = np.concatenate([s for s in sets if len(s)])
    slot = np.repeat(np.arange(len(sets)), sizes) * BUCKETS + (h >> np.uint64(64 - _PREFIX)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))  # sorted: a bucket's first is its least
    rest = np.maximum(h[first] << np.uint64(_PREFIX), np.uint64(1 << _PREFIX))
    zeros = 64 - np.frexp((rest >> np.uint64(1)).astype(np.float64))[1].astype(np.int64) - 1
    zeros = np.clip(zeros, 0, 56)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[slot[first]] = (zeros << MANTISSA) + mantissa.astype(np.int64) + 1
    own = out.copy()
    rows = np.flatnonzero((sizes > 0) & (out == 0).any(axis=1))
    for donors in _DONORS:
        if not len(rows):
            break
        block = out[rows]
        out[rows] = np.where(block == 0, own[rows][:, donors], block)
        rows = rows[(out[rows] == 0).any(axis=1)]
    for r in rows:  # the next bucket in the ring that has one
        full = np.flatnonzero(own[r])
        at = np.searchsorted(full, np.arange(BUCKETS)) % len(full)
        out[r] = np.where(out[r] == 0, own[r][full[at]], out[r])
    return out


def chance_table(steps: int = 40) -> np.ndarray:
    """[i, j]: the chance that registers of unlike sets with 2^(i/2) and 2^(j/2) hashes a
    bucket agree, summed over all register values."""
    zeros = np.arange(24)[:, None]
    low = (2.0 ** -(zeros + 1)) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    low, width = low.ravel(), np.repeat(2.0 ** -(zeros.ravel() + 1) / (1 << MANTISSA), 1 << MANTISSA)
    n = 2.0 ** (np.arange(steps) / 2)
    p = (1 - low) ** n[:, None] - np.maximum(0, 1 - low - width) ** n[:, None]
    return p @ p.T


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, without the agreements expected by chance."""
    share = (a == b).mean(axis=1)
    step = lambda n: np.clip(np.rint(2 * np.log2(np.maximum(n / BUCKETS, 1))), 0, len(chance) - 1).astype(int)
    c = chance[step(na), step(nb)]
    return np.maximum(0, (share - c) / (1 - c))


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, set_key, regs) of every row, and the binary columns ``keep`` as they are."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), shingle)
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays([
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets)], pa.binary()),
                *(b.column(c) for c in keep),
            ], names=["doc_id", "n_shingles", "set_key", "regs", *keep])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return src.mapInArrow(run, ", ".join(["doc_id long, n_shingles long, set_key binary, regs binary", *(f"{c} binary" for c in keep)]))


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose corrected estimate is near it."""
    chance, floor = chance_table(), threshold / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in ("ra", "rb")]
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = estimate(*regs, na, nb, chance) >= floor
            yield b.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    fit = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(fit)
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb = shingle_sets(b.column("ta"), shingle), shingle_sets(b.column("tb"), shingle)
            keep = []
            for x, y in zip(sa, sb):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def fine_sketch(sets: list[np.ndarray]) -> list[bytes]:
    """A byte for each of 1024 buckets: of its smallest hash, 0 where it has none. Short texts are told
    apart almost exactly, long ones with a deviation of 0.0125."""
    out = []
    for s in sets:
        row = np.zeros(FINE, np.uint8)
        slot = (s >> np.uint64(54)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(s) else slot
        row[slot[first]] = 1 + mix64(s[first]) % np.uint64(255)
        out.append(row.tobytes())
    return out


def _compare(rows: dict[str, np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group of :func:`_blockwise` that may reach the threshold."""
    one, two = np.flatnonzero(rows["block"] == rows["lo"][0]), np.flatnonzero(rows["block"] == rows["hi"][0])
    comp, n, regs, fine = rows["component"], rows["n"], rows["regs"], rows["fine"]
    apart = comp[one][:, None] != comp[two][None, :]
    apart &= 100 * np.minimum(n[one][:, None], n[two][None, :]) >= threshold * np.maximum(n[one][:, None], n[two][None, :])
    if rows["lo"][0] == rows["hi"][0]:
        apart &= one[:, None] < two[None, :]
    i, j = np.nonzero(apart)
    i, j = one[i], two[j]
    keep = []
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        mine = (regs[x] == regs[y]).argmax(1) == rows["at"][0]  # of the bands a pair shares, the first compares it
        x, y = x[mine], y[mine]
        either = ((fine[x] > 0) | (fine[y] > 0)).sum(1)
        same = ((fine[x] == fine[y]) & (fine[x] > 0)).sum(1)
        near = (same / np.maximum(either, 1) - 1 / 255) / (1 - 1 / 255) >= threshold / 100 - FINE_SLACK
        keep.append(np.column_stack([x[near], y[near]]))
    found = np.concatenate([*keep, np.zeros((0, 2), np.int64)]).astype(np.int64)
    return found[:, 0], found[:, 1]


def _blockwise(members: DataFrame, labels: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of one band in different components whose fine sketches are near the threshold.
    A band's members are dealt into blocks of about 512 by a hash; a group is a pair of blocks,
    so no task holds a large band, and only near pairs come out of it."""
    named = members.select("band", "at", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"))
    left = stable(named.join(split.filter("x < y").select("band", "m"), "band"), "minhash_open")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(fine_sketch(shingle_sets(b.column("text"), shingle)), pa.binary())], names=["node", "fine"])

    ask = texts.join(left.select("node").distinct(), "node", "left_semi").select("node", "text")
    fine = ask.mapInArrow(sketched, "node long, fine binary").dropDuplicates(["node"])
    sent = fine.join(classes.select("node", "n", "regs").dropDuplicates(["node"]), "node")
    blocks = F.ceil(F.col("m") / BLOCK)
    own = left.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("band", "at", "node", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = dealt.join(sent, "node").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    names = ["band", "at", "node", "component", "block", "lo", "hi", "n", "regs", "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            num = {c: rows.column(c).to_numpy() for c in names[:-2]}
            num["regs"] = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint64).reshape(-1, BANDS)
            num["fine"] = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
            cuts = np.flatnonzero(np.concatenate(([True], (num["band"][1:] != num["band"][:-1]) | (num["lo"][1:] != num["lo"][:-1]) | (num["hi"][1:] != num["hi"][:-1]))))
            a, b = [], []
            for x, y in zip(cuts, np.append(cuts[1:], len(num["band"]))):
                group = {c: v[x:y] for c, v in num.items()}
                i, j = _compare(group, threshold)
                a.append(group["node"][i])
                b.append(group["node"][j])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("band", "lo", "hi")])
            last = int(np.flatnonzero((keys != keys[-1]).any(1)).max(initial=-1)) + 1  # the last group may go on
            if last or (key is not None and (keys[0] != key).any()):
                done = [*held, batch.slice(0, last)] if last else held
                yield whole(done)
                held = []
            held.append(batch.slice(last))
            key = keys[-1]
        if held:
            yield whole(held)

    return dealt.select(*names).mapInArrow(run, "a long, b long").distinct()


def _partnered(texts: DataFrame, weight: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The rows of ``weight`` whose text may have a link at all: one with a share of windows
    that occur in no other of these texts above 100 - threshold percent has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), shingle)
            own = np.repeat(b.column("node").to_numpy(), [len(s) for s in sets])
            h = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(own[i : i + (1 << 16)]), pa.array(h[i : i + (1 << 16)])], names=["node", "h"])

    each = texts.select("node", "text").mapInArrow(run, "node long, h long")
    lone = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1")
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    size = texts.select("node", "n")
    j = weight.join(size, "node").join(lone, "node", "left")
    return j.filter(100 * (F.col("n") - F.coalesce("lone", F.lit(0))) >= threshold * F.col("n")).select("node", "weight")


def _components(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, threshold: int, given: DataFrame | None = None) -> DataFrame:
    """``classes`` (node, n, regs, ...) with the component of each node. texts_of gives (node, text, n)
    of the (node, n) that it gets; given: links (a, b) that hold whatever the texts are."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(regs, {1 + 8 * i}, 8)")) for i in range(BANDS)])
    banded = classes.select("node", F.posexplode(keys).alias("at", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y")
    members = stable(banded.join(shared.select("band", "size"), "band").distinct(), "minhash_members")
    if members.isEmpty():
        if given is None:
            return classes.withColumn("component", F.col("node"))
        return classes.join(components(given), "node", "left").withColumn("component", F.coalesce("component", "node"))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    involved = weight.select("node").join(classes.select("node", "n"), "node")
    texts = stable(texts_of(involved).dropDuplicates(["node", "text"]), "minhash_texts")
    likely = _partnered(texts, weight, shingle, threshold)
    members = stable(members.select("band", "at", "node").join(likely, "node"), "minhash_members")
    # The text that shares the largest bands is the likeliest source of a group of copies.
    hub = members.groupBy("band").agg(F.max(F.struct("weight", F.negative("node"))).alias("hub"))
    near = members.join(hub.select("band", F.negative("hub.col2").alias("hub"), F.col("hub.weight").alias("far")), "band").filter("node <> hub")
    near = near.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("far").alias("far"))
    maybe = stable(_likely(near.select("a", "b"), classes, threshold).join(near, ["a", "b"]), "minhash_pairs")
    first = maybe.groupBy("b").agg(F.max_by("a", F.struct("far", F.negative("a"))).alias("a")).select("a", "b")
    links = stable(_verified(first, texts, shingle, threshold), "minhash_links")
    if given is not None:
        links = links.union(given)
    labels = components(links)
    later = maybe.select("a", "b").join(first, ["a", "b"], "left_anti")
    more = stable(_verified(_apart(later, labels), texts, shingle, threshold), "minhash_links")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    # what no hub has joined: every pair of a band that is still apart is compared, in blocks
    rest = stable(_verified(_blockwise(members, labels, texts, classes, shingle, threshold), texts, shingle, threshold), "minhash_links")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    return classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over
    links with 100 * intersection >= threshold * union), kept (is that document).

    Null, empty and blank texts have no shingles and are linked with nothing. Texts shorter
    than a window are one shingle. Repeated rows of one id are one document: if their texts are
    unlike, their sets are linked, and each links as its own text does. Rows without an
    id link as others; a component without any id has component_id null, and the row that
    stands for it is kept. Other columns are ignored. An empty table gives no rows."""
    rows = stable(signatures(docs, shingle, id_col, text_col), "minhash_rows")
    # ids that stand for several sets cannot name one: their sets are named by a number, and linked
    unlike = rows.filter("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y"))
    unlike = stable(unlike.filter("x <> y").select("doc_id"), "minhash_unlike")
    mixed = not unlike.isEmpty()
    rows = rows.withColumn("name", F.col("doc_id"))
    if mixed:
        flagged = rows.join(unlike.withColumn("unlike", F.lit(True)), "doc_id", "left")
        rows = stable(flagged.withColumn("name", F.when(F.col("unlike").isNull(), F.col("doc_id"))).drop("unlike"), "minhash_rows")
    node = F.coalesce(F.min("name"), F.lit(_HIDDEN) + F.shiftright(F.abs(F.xxhash64("set_key")), 2))
    classes = stable(rows.filter("set_key is not null").groupBy("set_key").agg(
        node.alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "minhash_classes")

    def texts_of(involved: DataFrame) -> DataFrame:
        text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
        if not involved.filter(F.col("node") >= _HIDDEN).isEmpty():
            text = _named(docs, classes, shingle, id_col, text_col, unlike)
        return text.join(involved, "node")

    given = None
    if mixed:
        own = rows.join(unlike, "doc_id", "left_semi").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
        given = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("node <> a")
        given = stable(given.select("a", F.col("node").alias("b")), "minhash_given")
    named = _components(classes, texts_of, shingle, threshold, given).select("set_key", "node", "component")
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    if mixed:  # the smallest id of a component may be one that names no set
        least = out.filter("component is not null and doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        out = out.join(least, "component", "left").withColumn("component", F.coalesce("least", "component"))
    own = F.coalesce("doc_id", "node", F.lit(_HIDDEN))
    comp = F.coalesce("component", "doc_id", F.lit(_HIDDEN))
    return out.select("doc_id", "n_shingles", F.when(comp < _HIDDEN, comp).alias("component_id"), (own == comp).alias("kept"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return j.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _named(docs: DataFrame, classes: DataFrame, shingle: int, id_col: str, text_col: str, unlike: DataFrame) -> DataFrame:
    """(node, text) where some classes are not named by an id: the texts of rows without an id, or with one of
    ``unlike``, are found by their set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(0), shingle)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0)], names=["set_key", "text"])

    every = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    loose = unlike.withColumnRenamed("doc_id", "node")
    bare = every.filter("node is null").select("text").union(every.join(loose, "node", "left_semi").select("text"))
    found = bare.mapInArrow(run, "set_key binary, text string").dropDuplicates(["set_key"])
    hidden = found.join(classes.filter(F.col("node") >= _HIDDEN).select("set_key", "node"), "set_key").select("node", "text")
    return every.filter("node is not null").join(loose, "node", "left_anti").union(hidden)


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("string")))


def _standing(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(doc_id, text_key) of the row that stands for each component with an id: the smallest id, and
    of its texts in the component the one with the smallest digest. Here every distinct set is a
    node of its own, whatever ids its rows have, so unlike texts under one id do not link."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key("text").alias("text_key"))
    rows = signatures(keyed, shingle, keep=["text_key"]).filter("set_key is not null")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    classes = rows.groupBy("set_key").agg(first.alias("first"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    # numbered as they are written, so no number comes twice; what is linked does not depend on them
    classes = stable(classes.withColumn("node", F.monotonically_increasing_id()), "minhash_classes")

    def texts_of(involved: DataFrame) -> DataFrame:
        asked = classes.select("node", "first", "text_key").join(involved, "node")
        own = asked.filter("first is not null").select("first.doc_id", "first.text_key", "node", "n")
        bare = asked.filter("first is null").select("text_key", "node", "n")
        found = keyed.join(own, ["doc_id", "text_key"]).select("node", "text", "n")
        return found.union(keyed.filter("doc_id is null").dropDuplicates(["text_key"]).join(bare, "text_key").select("node", "text", "n"))

    named = _components(classes, texts_of, shingle, threshold)
    return named.filter("first is not null").groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")


def keep_one(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest
    doc_id stays, once if that row is repeated (of repeated rows with unlike other columns, the one whose
    other columns come first as JSON); all columns stay, whatever their names. Texts are told apart by id and
    words: unlike texts under one id are judged each for itself. Rows without a doc_id and
    rows without words stay."""
    stay = _standing(docs, shingle, threshold).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    aside = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = docs.filter(~aside).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_key("text").alias("key")).join(stay, ["id", "key"], "left_semi")
    order = F.to_json(F.col("row").dropFields("doc_id", "text")) if others else F.lit("")
    turn = F.row_number().over(Window.partitionBy("id", "key").orderBy(order))
    first = left.withColumn("turn", turn).filter("turn = 1").select("row.*")
    return first.union(docs.filter(aside))
