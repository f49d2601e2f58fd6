"""Helpers shared by the operators: readers, text buffers, word hashing, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import configure, stable

#: Words are runs of anything but these ASCII blanks (fixed by the query contracts).
WORD_RE = r"[^\x20\x09-\x0D]+"
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for every byte that is neither an ASCII letter nor part of a longer UTF-8 character.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches, so that a batch of very
    long texts stays within a worker's memory."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD_RE})"), F.lit(1))).cast("long"), F.lit(0).cast("long"))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold rule of the labelled queries."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_sample(labels: DataFrame, column: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows outside the held-out fold, those with the
    smallest hashes of their id: a bounded sample, the same on every run."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    rows = rows.filter("doc_id is not null and y is not null").filter(bucket_of(F.col("doc_id"), folds) != held)
    return rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)


def training_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, y) of the sample; it has at most ``most`` rows of two numbers, so it is
    sent to the documents and not the other way round. A repeated doc_id counts once a row."""
    picked = labelled_sample(labels, column, folds, held, most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")


def sums_between(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags in each [off[i], off[i+1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


# ---------------------------------------------------------------- text buffers (numpy)

def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column in a row, and each text's offsets. Null: empty."""
    col = pc.fill_null(col, "").cast(pa.large_binary())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the offsets of each text's words among them.
    gap: 256 flags, true for the bytes that separate words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (edge[:-1] | ~before))
    end = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    return start, end, np.searchsorted(start, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def keys64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit keys."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE_KEYS = keys64(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each (non-empty, non-overlapping, ascending) byte span; fold lower-cases A-Z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    within = np.arange(size.sum()) - np.repeat(first, size)
    chars = data[within + np.repeat(start, size)]
    if fold:
        chars = LOWER[chars]
    terms = _BYTE_KEYS[chars] * _powers(int(size.max()))[within]
    return mix64(np.add.reduceat(terms, first) + size.astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word windows; fewer words: the whole sequence as
    one; no words: none."""
    if not len(words):
        return words
    salt = keys64(k, 77)
    if len(words) <= k:
        return mix64((words * salt[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    m = len(words) - k + 1
    acc = np.full(m, k, np.uint64)
    for j in range(k):
        acc += words[j : j + m] * salt[j]
    return np.unique(mix64(acc))


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """The shingle set of every text of an Arrow column (A-Z lower-cased)."""
    data, off = text_buffer(col)
    start, end, at = word_spans(data, off)
    h = hash_spans(data, start, end)
    return [shingles(h[a:b], k) for a, b in zip(at[:-1], at[1:])]


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (columns a, b; a link each): component is
    the smallest node reachable. Alternating large-star and small-star steps, each a
    pre-aggregated minimum per node and a join, until every node hangs on one root; every
    round is written to the shared checkpoint folder. Nothing is gathered per node, so a hub with very many links is a
    skewed join that AQE splits."""
    def starred(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return sym.join(low, "u")

    def settled(cur: DataFrame) -> bool:
        ends = cur.select(F.col("b").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.union(cur.select(F.col("a").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        seen = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        return seen.filter("down > 1 or (down = 1 and up = 1)").isEmpty()

    cur = stable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "components")
    for _ in range(max_rounds):
        if settled(cur):
            break
        sym = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = starred(sym).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = starred(large)
        down = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select(F.col("u").alias("b"), F.col("m").alias("a")))
        cur = stable(down.filter("a <> b").select("a", "b").distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())
