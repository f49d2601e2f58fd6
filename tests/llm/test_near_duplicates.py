import random
import re

import numpy as np

from pyspark.sql import functions as F

from ledgerlark.llm import minhash
from ledgerlark.llm.common import components, prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, threshold):
    """Component of every id by comparing all pairs."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def variants():
    """A text with many near copies around the threshold, exact copies, and texts that share a passage."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper())]
    for d in range(2, 120):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(1, 3)] = [f"n{d}"]
        rows.append((d, " ".join(w)))
    passage = " ".join(base[:12])
    rows += [(200 + d, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(6))) for d in range(80)]
    return rows + [(400, "a b"), (401, "A  B"), (402, "a b c"), (403, None), (404, "")]


def test_components_equal_brute_force(spark):
    prepare(spark)
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, threshold in ((4, 80), (5, 80)):
        want = brute(rows, k, threshold)
        got = minhash.near_duplicates(docs, k, threshold).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[-1].n_shingles == 0 and by[-1].component_id == -1 and by[-1].kept
    assert by[-4].n_shingles == 1
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {-50}
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.filter("text like 'one'").collect()]
    assert ids == [-4]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        cut = int(3000 * share)
        other = rng.integers(0, 2**63, 3000 - cut, dtype=np.uint64)
        a, b = np.unique(both), np.unique(np.concatenate([both[:cut], other]))
        r = minhash.registers([a, b])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        n = np.array([3000])
        assert abs(minhash.estimate(r[:1], r[1:], n, n, minhash.chance_table())[0] - exact) < 0.15
    assert (minhash.registers([np.array([5], np.uint64)]) > 0).all()
    assert not minhash.registers([np.zeros(0, np.uint64)]).any()


def test_components_of_chains_and_hubs(spark):
    prepare(spark)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 60)] + [(3, 2), (2, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[140] == 100 and got[59] == 7 and got[3] == 2 and len(got) == 41 + 53 + 2


def test_rows_without_id_stay_whatever_columns_they_have(spark):
    prepare(spark)
    rows = [(None, "same words in this text", {"a": 1}, 1, "x"), (None, "same words in this text", None, None, None), (None, None, None, None, None),
            (None, None, None, None, None), (5, "same words in this text", None, 2, "y"), (5, "same words in this text", None, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` int, `q``s` string")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 0, 0, 5]


def test_unlike_texts_under_one_id_all_stay(spark):
    prepare(spark)
    rng = random.Random(6)
    a, b, c, d, e, f = (" ".join(rng.choice("abcdefghijklmnopq") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(6))
    rows = [(3, a), (7, b), (7, a + " more"), (7, a), (8, c), (8, d), (8, d), (8, d.upper()), (9, ""), (9, e), (9, None), (9, " "),
            (10, f + " x"), (10, f), (12, f + " y"), (12, c + " z"), (None, b), (None, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in minhash.keep_one(docs).collect()]
    fold = sorted((i or 0, (t or "").strip().lower()) for i, t in got)
    ten = [t for i, t in fold if i == 10]
    assert len(ten) == 1 and ten[0] in (f, f + " x")  # one of the near copies under one id
    assert [x for x in fold if x[0] != 10] == sorted([(3, a), (7, b), (8, c), (8, d), (9, ""), (9, ""), (9, ""), (9, e), (0, b), (0, f)])


def test_unlike_texts_of_one_id_are_linked(spark):
    prepare(spark)
    base, y = (" ".join(f"{c}{i}" for i in range(12)) for c in "ay")
    rows = [(3, base), (7, base), (7, y), (9, y + " z"), (11, "quite another text of some words"), (None, y), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=4, threshold=80).collect()}
    assert got[(3, 9)] == (3, True) and got[(7, 9)] == (3, False) and got[(9, 10)] == (3, False)
    assert got[(None, 9)] == (3, False) and got[(11, 3)] == (11, True) and got[(5, 0)] == (5, True)
    swapped = spark.createDataFrame([(7, y), (2, y + " z"), (7, base), (1, "other words in this one text")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(swapped, 4, 80).collect()} == {(7, 2), (2, 2), (1, 1)}
    alone = spark.createDataFrame([(7, "one two three four five"), (7, "six seven eight nine ten"), (8, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(alone, 4, 80).collect()} == {(7, 7), (8, 8)}


def test_kept_rows_keep_columns_of_any_name_and_the_same_one_of_repeated_rows(spark):
    prepare(spark)
    text = "a text of more than five words for everyone"
    rows = [(1, text, "b"), (1, text, "a"), (2, text, "c"), (None, text, "d")]
    names = ("_id", "_turn", "_text_key", "row", "id", "key", "turn")
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").withColumns({c: F.lit(c) for c in names})
    for part in (df, df.repartition(3), df.orderBy(F.desc("note"))):
        out = minhash.keep_one(part)
        assert out.columns == df.columns
        assert sorted((r.doc_id or 0, r.note, *(r[c] for c in names)) for r in out.collect()) == [(0, "d", *names), (1, "a", *names)]
