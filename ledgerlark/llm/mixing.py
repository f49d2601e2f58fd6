"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target number of words: its weight's share of all words, at most a given
multiple of the source's own words, the excess reshared by weight until none is above. Over
the training time u in [0, 1] a source's rate is its target times 1 + slope * (2u - 1), so its
cumulative demand is target * (u + slope * (u^2 - u)). The documents of a source stand in a
fixed random order; each pass over them meets the demand from the words taken so far, and the
inverse of the demand gives the time, and so the training position, at which a document starts.

All sums over documents are prefix sums over range partitions: a source that holds a third of
all words is spread over many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.ranking import global_row_number
from ledgerlark.session import scratch_path

from .common import stable, text_buffer, word_spans

#: Passes over a source at most, as a multiple of its words.
MOST = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of every row's whole text; null counts 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = word_spans(*text_buffer(b.column("text")))[2]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(at[1:] - at[:-1], pa.int64())], names=["doc_id", "source", "size"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, weight, target) of every source. Shares go to the sources below
    their limit again and again, each round one pass over this small table, until no further
    source reaches its limit."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_row_number(per, [F.col("source").asc_nulls_last()], out="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = stable(per.withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast("double")), "mixing_sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at = F.col("weight") * level >= F.col("limit")
        capped = per.agg(F.sum(at.cast("long")), F.sum(F.when(at, F.col("limit"))), F.sum(F.when(~at, F.col("weight")))).first()
        if not capped[2] or (capped[0] or 0) == full:
            break
        full = capped[0] or 0
        level = max(0.0, total - (capped[1] or 0.0)) / capped[2]
    target = F.when(F.col("weight") * level >= F.col("limit"), F.col("limit")).otherwise(F.col("weight") * level)
    return per.select("source", "rank", "source_size", "weight", target.alias("target"))


def slope(rank: Column) -> Column:
    """How a source's rate changes over the training: sources in turn fall, stay and rise."""
    return (F.pmod(rank, F.lit(3)) - 1) * 0.5


def moment(offset: Column, target: Column, lean: Column) -> Column:
    """The time at which the cumulative demand reaches ``offset`` words: the root in [0, 1] of
    lean * u^2 + (1 - lean) * u = offset / target."""
    x = F.least(F.lit(1.0), offset / target)
    b = 1 - lean
    root = 2 * x / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * lean * x)))
    return F.when(target > 0, F.coalesce(root, F.lit(0.0))).otherwise(F.lit(0.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target (of its source),
    taken (words the mix takes, repeats counted), positions (where each pass over the
    document starts, in words from the start of the training) and place (the row's number).

    The order within a source is by a hash of the id; a null source is a source, last by name;
    null texts have no words and are never taken. Equal rows share their source's words in
    turn. A source's taken words are its target rounded to whole words."""
    sized = stable(sizes(docs), "mixing_sizes")
    per = targets(sized, weights, most)
    named = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    order = [F.col("rank"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("size")]
    run = global_row_number(named, order, out="place", sum_col="size", cum_out="upto", total_out="rows")
    # a source's words start where those of the sources before it end
    before = F.sum("source_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select(F.col("rank").alias("r"), F.coalesce(before, F.lit(0)).alias("before"))
    run = run.join(starts, F.col("rank") == F.col("r"))
    first = F.col("upto").cast("long") - F.col("size") - F.col("before")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    lean = slope(F.col("rank"))
    takes, places = [], []
    for p in range(most):
        offset = p * F.col("source_size") + first
        take = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - offset))
        takes.append(take)
        places.append(F.when(take > 0, moment(offset.cast("double"), F.col("target"), lean) * F.col("total")))
    total = per.agg(F.sum("source_size").cast("double").alias("total"))
    run = run.crossJoin(F.broadcast(total))  # one row
    taken = takes[0]
    for t in takes[1:]:
        taken = taken + t
    return run.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.array_compact(F.array(*places)).alias("positions"), "place")


def schedule(mixed: DataFrame) -> DataFrame:
    """The training order: a row for each pass over each document, range-sorted by position."""
    each = mixed.select("doc_id", "source", "place", F.posexplode("positions").alias("pass", "position"))
    return each.repartitionByRange("position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


def deal(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the mix and its training order under ``path`` (a new shared folder by default): ``order``
    has its files, by name, and their rows in training order. Returns the rows of :func:`mix`, with
    positions as they stand in that order. Ids may repeat or be null, so a row is known by its place."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"mixing/{uuid.uuid4().hex}")
    mix(docs).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    schedule(rows).write.parquet(f"{path}/order")
    dealt = spark.read.parquet(f"{path}/order").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pass", "position"))).alias("dealt"))
    out = rows.drop("positions").join(dealt, "place", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce("dealt.position", F.array().cast("array<double>")).alias("positions"))
