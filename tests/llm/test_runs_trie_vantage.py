"""Vantage-point shards, conversation trie and periodic runs against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.llm import periodic_runs, prefix_trie, vantage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- periodic runs

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text, rewrite=True):
    words = WORD.findall(text or "")
    if rewrite and doc_id is not None and words and crc32(str(doc_id).encode()) % 10 == 0:
        n, g = len(words), crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    said = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(said), sha(kept))


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 40)), max_size=4), min_size=1, max_size=3))
def test_runs_of_random_words(documents):
    docs = [[str(x).encode() for period, size in parts for x in (period * size)[:size]] for parts in documents]
    numbers, off = periodic_runs._numbered(docs)
    want = [(s + int(o), size, q) for o, d in zip(off, docs) for s, size, q in brute_runs(d)]
    assert sorted(map(tuple, periodic_runs.find_runs(numbers, off).tolist())) == sorted(want)


def test_wavelet_tree_answers_like_a_sorted_slice():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 65, 300):
        values = rng.permutation(n)
        left = rng.integers(0, n, 200)
        right = np.array([rng.integers(x, n + 1) for x in left])
        ask = rng.integers(0, n + 3, 200)
        want = [min((v for v in values[x:y] if v >= a), default=-1) for x, y, a in zip(left, right, ask)]
        assert periodic_runs.WaveletTree(values).successor(left, right, ask).tolist() == want


def test_runs_of_a_long_text_and_of_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    words = np.array(b)  # its runs have fewer than four periods
    assert len(periodic_runs.find_runs(words, np.array([0, len(words)]))) == 0
    words = np.arange(60_000) % 10_000
    assert periodic_runs.find_runs(words, np.array([0, 60_000])).tolist() == [[0, 60_000, 10_000]]


def test_runs_query_of_documents_against_brute_force(spark, odd_docs):
    docs = odd_docs.filter("length(text) < 4000 or text is null").withColumn("runs", F.lit(1)).withColumn("text_", F.lit("x"))
    rows = docs.select("doc_id", "text").collect()
    assert any(r.doc_id is not None and crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows)
    got = periodic_runs.digest(periodic_runs.runs(docs, rewrite=True))
    assert as_rows(got) == sorted((run_row(r.doc_id, r.text) for r in rows), key=str)


def test_runs_of_odd_texts(spark, odd_docs, no_docs):
    assert periodic_runs.runs(no_docs).count() == 0
    long = periodic_runs.runs(odd_docs.filter("length(text) > 40000")).collect()
    assert long and all([tuple(x) for x in r.runs] == [(0, 9000, 1)] and r.collapsed == "word" for r in long)
    blank = periodic_runs.digest(periodic_runs.runs(odd_docs.filter("text is null or text = ''"))).collect()
    assert blank and all(r.n_runs == 0 and r.start is None and r.runs_sha256 == r.collapsed_sha256 == hashlib.sha256(b"").hexdigest() for r in blank)


# ---------------------------------------------------------------- vantage-point trees

def brute_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fp):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def some_fingerprints(seed):
    """Scattered ones, chains of small changes, and a dense cloud around one of them."""
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for _ in range(3):
        nxt = parts[-1].copy()
        for _ in range(rng.integers(1, 4)):
            nxt ^= np.uint64(1) << rng.integers(0, 64, len(nxt)).astype(np.uint64)
        parts.append(nxt)
    cloud = np.full(500, parts[0][0])
    for _ in range(3):
        cloud ^= np.uint64(1) << rng.integers(0, 20, 500).astype(np.uint64)
    return np.unique(np.concatenate([*parts, cloud]))


def test_local_search_and_routing_find_every_link():
    for seed in range(12):
        fp = some_fingerprints(seed)
        assert (vantage.linked(fp) == brute_groups(fp)).all()
        tree = vantage.fit(fp[::3], 5)
        shards = defaultdict(set)
        for row, shard in zip(*vantage.route(fp, tree)):
            shards[int(row)].add(int(shard))
        assert len(shards) == len(fp) and len(tree) > 3
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
        assert all(shards[a] & shards[b] for a, b in zip(*np.nonzero(near)))


def groups_of(links, n):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_links_by_shards_and_by_neighbours_of_full_shards(spark):
    fp = some_fingerprints(99)
    rng = np.random.default_rng(1)
    node = rng.permutation(len(fp))
    df = spark.createDataFrame([(int(x), int(k)) for x, k in zip(fp.view(np.int64), node)], "fp long, node long")
    want = np.empty(len(fp), int)
    by_node = np.argsort(node)
    want[:] = brute_groups(fp[by_node])
    for limits in ({"most": 60}, {"most": 1, "sample": 50}, {"depth": 0}):
        got = [tuple(r) for r in vantage.links(df, **limits).collect()]
        assert groups_of(got, len(fp)) == want.tolist(), limits


def test_vantage_query_against_brute_force(spark, odd_docs):
    docs = odd_docs.withColumn("fp", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("fingerprint", F.lit(0))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    prints = np.unique(np.array([f for _, f in rows], np.uint64))
    label = brute_groups(prints)
    comp = {int(f): int(c) for f, c in zip(prints, label)}
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[comp[f]] = min(doc_id, least.get(comp[f], doc_id))
    got = vantage.near_duplicates(docs)
    assert as_rows(got) == sorted(((d, f"{f:016x}", least.get(comp[f])) for d, f in rows), key=str)
    again = vantage.near_duplicates(docs, most=5)
    assert as_rows(again) == as_rows(got)


def test_vantage_of_small_tables(spark, no_docs):
    assert vantage.near_duplicates(no_docs).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (None, "A b  c"), (7, "unlike"), (7, "text x y z")], "doc_id long, text string")
    got = vantage.near_duplicates(df).collect()
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert [r.component_id for r in got if r.doc_id == 7] == [7, 7]


# ---------------------------------------------------------------- conversation trie

def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    told = {}
    for c, mine in said.items():
        h = crc32(str(c).encode()) % 9 if rebuild else 0
        told[c] = said.get(c - c % 5, [])[:h] + mine[h:] if rebuild else mine
    members = defaultdict(list)
    for c in sorted(told):
        for d in range(len(told[c]) + 1):
            members[tuple(told[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p] + [q for k in children[p] for q in below(k)]

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(told[c]) == len(p))
        sub = below(p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), sum(not children[q] for q in sub),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 4 * n), n):
        size = rng.choice([1, 2, 3, 4, 5, 8, 9, longest])
        rows += [(c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.05 else ("user", "assistant")[k % 2], rng.choice("aé") if rng.random() < 0.2 else "same") for k in range(size)]
    return rows


def test_trie_of_random_conversations(spark):
    for seed, size, rebuild in ((1, 4, True), (2, 3, False)):
        rows = random_conversations(seed, 60, 23)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert as_rows(prefix_trie.prefix_trie(df, rebuild, size)) == brute_trie(rows, rebuild), (seed, rebuild)


def test_trie_of_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 1, "user", "é" * 30_000), (7, 1, "a", "b:c"), (8, 1, "a:b", "c"), (9, 0, "", "")]
    rows += [(100 + k, t, "user", "same") for k in range(40) for t in range(3)] + [(300, t, "user", "same") for t in range(150)] + [(301, t, "user", "same") for t in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("x")).withColumn("key", F.lit(1)).withColumn("block", F.lit(None).cast("string"))
    assert as_rows(prefix_trie.prefix_trie(df, True)) == brute_trie(rows, True)
    assert prefix_trie.prefix_trie(df.filter("false"), True).count() == 0


def test_digest_of_many_ends_is_joined_from_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    ends = spark.range(5000).select((F.col("id") % 3).alias("depth"), F.lit(1).cast("long").alias("ia"), F.lit(2).cast("long").alias("ib"), F.col("id").alias("conv_id"))
    got = {r.depth: r.ends_sha256 for r in prefix_trie._digests(ends).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, range(d, 5000, 3))).encode()).hexdigest() for d in range(3)}


def test_running_sums_of_one_long_group(spark):
    """A group that is cut by partition borders gets the sums of its earlier parts."""
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).cast("long").alias("g"), F.col("id").alias("o"), F.lit(1).cast("long").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run = prefix_trie._before(df, "g", "o", {"v": F.sum("v")}, "test")
        assert run.filter("g = 1").select("_part").distinct().count() > 1
        wrong = run.filter("coalesce(before_v, 0) + coalesce(_v, 0) <> case when g = 1 then o else 0 end")
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
