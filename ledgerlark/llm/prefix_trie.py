"""Prefix trie of conversations by block hashing.

Conversations are cut into blocks of ``BLOCK`` turns. A block's digest covers its number and its
turns; the exclusive or of the digests of a conversation's first blocks names its prefix at that
block border, so every border is named from prefix sums over range partitions, however long a
conversation is. Conversations are grouped by these successive names first: one row for each
distinct block after each distinct prefix. Only where such a prefix has several blocks after it are
the borders between turns looked for: those blocks' first 1, 2, ... turns are named and grouped in the same
way. A block without siblings is a chain of turns with the same members, which needs no
further digest or grouping.

The smallest members part the trie into paths: the nodes with one smallest member are consecutive
nodes of that conversation. A sum over a subtree is a sum along a path and over the paths that
hang from it, and the paths' totals come from pointer doubling, in as many rounds as the logarithm of
how deep paths hang on paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.ranking import group_row_number

from .common import stable

BLOCK = 4
#: Characters of conversation ids that are handed on at once to a node's digest.
CHUNK = 1 << 20


def _turn_key(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes) of every turn: its place in the conversation from 1, a digest of role and text,
    and the text's UTF-8 bytes. Turns stand by turn number (null first), then role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        _turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    return group_row_number(rows, ["conv_id"], order, out="pos").select("conv_id", "pos", "key", "bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, key, bytes) of every conversation c with its opening exchanged, and all conv_ids:
    the first h turns of conversation c - c % 5, then c's own turns after its first h, with h = crc32 of c modulo 9."""
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).alias("h")
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h)
    lent = convs.select(F.col("conv_id").alias("base"), F.least("n", F.lit(8)).alias("has"))
    plan = stable(plan.join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")), "trie_plan")
    opening = own.filter("pos <= 8").withColumnRenamed("conv_id", "base").join(plan, "base").filter("pos <= h")
    rest = own.join(plan, "conv_id").filter("pos > h")
    out = opening.select("conv_id", "pos", "key", "bytes").union(rest.select("conv_id", F.col("pos") - F.col("h") + F.col("taken"), "key", "bytes"))
    return out, plan.select("conv_id")


def _before(df: DataFrame, group: str, order: str, cols: dict[str, Column], name: str) -> DataFrame:
    """Adds, for every column of ``cols``, its aggregate (an aggregate expression over that column) over the
    earlier rows of the group. The rows stand in range partitions; a group that is cut at a border gets
    what its earlier parts hold from a table of at most two rows for each partition."""
    tagged = stable(df.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_part", F.spark_partition_id()), name)
    parts = tagged.groupBy(group, "_part").agg(*[agg.alias(c) for c, agg in cols.items()])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.count(F.lit(1)).over(Window.partitionBy(group)).alias("_parts"), *[agg.over(earlier).alias(f"_{c}") for c, agg in cols.items()])
    cut = parts.filter("_parts > 1").drop("_parts")
    here = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = tagged.withColumns({f"before_{c}": agg.over(here) for c, agg in cols.items()})
    return run.join(F.broadcast(cut), [group, "_part"], "left")


def _names(number: Column, keys: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(17), number, keys), F.xxhash64(F.lit(91), number, keys)


def blocks(told: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, turns, pa, pb, ia, ib): every conversation's blocks with the names of the prefix before
    (pa, pb) and after (ia, ib) each. turns: (pos, key, bytes) in order, ``size`` at most."""
    held = told.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns"))
    a, b = _names(F.col("block"), F.transform("turns", lambda t: t["key"]))
    run = _before(held.withColumns({"a": a, "b": b}), "conv_id", "block", {"a": F.bit_xor("a"), "b": F.bit_xor("b")}, "trie_blocks")
    zero = F.lit(0).cast("long")
    before = {c: F.coalesce(f"before_{c}", zero).bitwiseXOR(F.coalesce(f"_{c}", zero)) for c in "ab"}
    return run.select("conv_id", "block", "turns", before["a"].alias("pa"), before["b"].alias("pb"), before["a"].bitwiseXOR(F.col("a")).alias("ia"), before["b"].bitwiseXOR(F.col("b")).alias("ib"))


def _nodes(cut: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """(depth, ia, ib, pa, pb, conv_id, n_convs, bytes): the trie's nodes, with their parents' names."""
    groups = cut.groupBy("block", "pa", "pb", "ia", "ib").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    groups = stable(groups, "trie_groups")
    several = groups.groupBy("block", "pa", "pb").agg(F.count(F.lit(1)).alias("siblings")).filter("siblings > 1").select("block", "pa", "pb", F.lit(True).alias("diverges"))
    groups = groups.join(several, ["block", "pa", "pb"], "left")
    last = F.size("turns")
    each = groups.select("*", F.posexplode("turns").alias("at", "t")).withColumn("upto", F.col("at") + 1)
    depth = (F.col("block") * size + F.col("upto")).alias("depth")
    common = [F.col("t.bytes").alias("bytes")]

    def named(upto: Column) -> tuple[Column, Column]:
        a, b = _names(F.col("block"), F.transform(F.slice("turns", 1, F.greatest(upto, F.lit(1))), lambda t: t["key"]))
        return F.col("pa").bitwiseXOR(a), F.col("pb").bitwiseXOR(b)

    def ends(of: tuple[Column, Column], upto: Column) -> list[Column]:
        """The name after ``upto`` turns of the block: the borders' own names at both its ends."""
        return [F.when(upto == 0, F.col(f"p{c}")).when(upto == last, F.col(f"i{c}")).otherwise(x) for c, x in zip("ab", of)]

    def laid(rows: DataFrame, of) -> DataFrame:  # noqa: ANN001
        up = F.col("upto")
        (ia, ib), (pa_, pb_) = ends(of(up), up), ends(of(up - 1), up - 1)
        return rows.select(depth, ia.alias("ia"), ib.alias("ib"), pa_.alias("pa"), pb_.alias("pb"), "conv_id", "n_convs", *common)

    chain = lambda upto: (F.xxhash64("ia", "ib", upto), F.xxhash64("ib", "ia", upto))
    alone = laid(each.filter("diverges is null"), chain)
    apart = laid(each.filter("diverges"), named).groupBy("depth", "ia", "ib").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("ia"), zero.alias("ib"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "conv_id", "n_convs", zero.alias("bytes"))
    return alone.unionByName(apart).unionByName(root)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, ia, ib, ends_sha256): SHA-256 of the ids of the conversations that end at each node, in order.
    A node's ids are joined where they lie in range partitions, and the parts, a few for each
    partition, are read in order with nothing held but the digest's state."""
    key = ["depth", "ia", "ib"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, since, said, size = [], None, None, [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=[*key, "since", "ids"])

        for b in batches:
            for *own, conv in zip(*(b.column(c).to_pylist() for c in (*key, "conv_id"))):
                if own != node or size > CHUNK:
                    if said:
                        out.append((*node, since, ",".join(said)))
                    node, since, said, size = own, conv, [], 0
                said.append(str(conv))
                size += len(said[-1]) + 1
            if len(out) > 4096:
                yield flush()
        if said:
            out.append((*node, since, ",".join(said)))
        yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, state = [], None, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*key, "ends_sha256"])

        for b in batches:
            for *own, ids in zip(*(b.column(c).to_pylist() for c in (*key, "ids"))):
                if own != node:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(out) > 4096:
                yield flush()
        if state:
            out.append((*node, state.hexdigest()))
        yield flush()

    parts = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(joined, "depth long, ia long, ib long, since long, ids string")
    parts = parts.repartition(*key).sortWithinPartitions(*key, "since").select(*key, "ids")
    return parts.mapInArrow(hashed, "depth long, ia long, ib long, ends_sha256 string")


def _path_totals(paths: DataFrame) -> DataFrame:
    """(path, leaves, saved) over each path and all that hang from it. paths: (path, up, leaves, saved), ``up`` the
    path it hangs from. Each round adds the sums of the paths twice as far below."""
    cur = stable(paths, "trie_paths")
    while not cur.filter("up is not null").isEmpty():
        below = cur.filter("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        higher = cur.select(F.col("path").alias("up"), F.col("up").alias("next"))
        cur = cur.join(higher, "up", "left").join(below, "path", "left")
        cur = stable(cur.select("path", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie_paths")
    return cur.select("path", "leaves", "saved")


def trie(told: DataFrame, convs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node of the prefix trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (over its subtree), ends_sha256.

    told: (conv_id, pos from 1 without gaps, key, bytes), a row for each turn; convs: all conv_ids, also those
    without turns. A node is a distinct sequence of keys with which some conversation begins, the
    empty one included; no conversations give no rows. saved_tokens counts, for each node, the bytes of
    its last turn once for every member but one."""
    cut = stable(blocks(told, size), "trie_cut")
    zero = F.lit(0).cast("long")
    nodes = stable(_nodes(cut, convs, size), "trie_nodes")
    final = cut.groupBy("conv_id").agg(F.max(F.struct("block", F.size("turns").alias("n"), "ia", "ib")).alias("f"))
    final = convs.join(final, "conv_id", "left").select("conv_id", F.coalesce(F.col("f.block") * size + F.col("f.n"), zero).alias("depth"), F.coalesce("f.ia", zero).alias("ia"), F.coalesce("f.ib", zero).alias("ib"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ia"), F.col("pb").alias("ib")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, ["depth", "ia", "ib"], "left").join(_digests(final), ["depth", "ia", "ib"], "left")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ia").alias("pa"), F.col("ib").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    full = full.join(up, ["depth", "pa", "pb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("save"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    full = stable(full, "trie_full")
    # a path begins at the root or where the parent has a smaller member
    tops = full.filter("parent_conv_id is null or parent_conv_id <> conv_id").select(F.col("conv_id").alias("path"), F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("hangs"))
    own = full.groupBy(F.col("conv_id").alias("path")).agg(F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"))
    tops = tops.join(own, "path")
    total = stable(_path_totals(tops.select("path", "up", "leaves", "saved")), "trie_totals")
    hung = tops.select("path", "up", "hangs").join(total, "path").filter("up is not null")
    hung = hung.groupBy(F.col("up").alias("conv_id"), F.col("hangs").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    full = full.join(hung, ["conv_id", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", zero), "save": F.col("save") + F.coalesce("more_saved", zero)})
    run = _before(full.drop("more_leaves", "more_saved"), "conv_id", "depth", {"leaf": F.sum("leaf"), "save": F.sum("save")}, "trie_sums")
    run = run.join(total.withColumnRenamed("path", "conv_id"), "conv_id")
    past = lambda c: F.coalesce(f"before_{c}", zero) + F.coalesce(f"_{c}", zero)
    return run.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") - past("leaf")).alias("n_leaves"), (F.col("saved") - past("save")).alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame, rebuild: bool = False, size: int = BLOCK) -> DataFrame:
    """The trie of all conversations, see :func:`trie`; rebuild: with openings exchanged, see :func:`rebuilt`.

    Null roles and texts are empty. Turns stand by number, null first; equal numbers by role, then by a
    digest of the text, so reruns agree; repeated rows are repeated turns. Rows without a conv_id
    belong to no conversation. Long texts are read once, into their digest. Other columns are ignored,
    whatever their names. An empty table gives no rows."""
    own = stable(turns(conversations), "trie_turns")
    told, convs = rebuilt(own) if rebuild else (own, own.select("conv_id").distinct())
    return trie(told, convs, size)


ORACLE = """
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM raw),
crc AS (
  SELECT conv_id, s, 1 AS i, 4294967295::BIGINT AS c FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, list_reduce([xor(c, ascii(substr(s, i, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  FROM crc WHERE i <= length(s)),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = length(s) + 1),
told AS (
  SELECT h.conv_id, 0 AS part, raw.pos, raw.role, raw.text FROM h JOIN raw ON raw.conv_id = h.base AND raw.pos <= h.h
  UNION ALL
  SELECT h.conv_id, 1, raw.pos, raw.role, raw.text FROM h JOIN raw ON raw.conv_id = h.conv_id AND raw.pos > h.h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS prefix
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM path GROUP BY depth, prefix),
named AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
  FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.prefix = substr(n.prefix, 1, 64 * (n.depth - 1))
  LEFT JOIN (SELECT depth - 1 AS depth, substr(prefix, 1, 64 * (depth - 1)) AS prefix, count(*) AS n_children
             FROM node WHERE depth > 0 GROUP BY ALL) k ON k.depth = n.depth AND k.prefix = n.prefix),
below AS (
  SELECT a.depth, a.prefix, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM named u JOIN path a_path ON a_path.conv_id = u.conv_id AND a_path.depth <= u.depth
  JOIN node a ON a.depth = a_path.depth AND a.prefix = a_path.prefix GROUP BY a.depth, a.prefix),
ends AS (
  SELECT depth, prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max(depth) AS depth, max_by(prefix, depth) AS prefix FROM path GROUP BY conv_id) GROUP BY depth, prefix)
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM named n JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix
LEFT JOIN ends e ON e.depth = n.depth AND e.prefix = n.prefix
"""
