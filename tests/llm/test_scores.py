import re
import zlib
from collections import Counter

import numpy as np

from ledgerlark.llm import language, line_crf, quality_gam, toxicity
from ledgerlark.llm.common import prepare


def held(d, n, r):
    return d is not None and zlib.crc32(str(d).encode()) % n == r


def test_quality_on_held_out_rows(spark, sf):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_gam.score(docs, quality_gam.train(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert out and all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.9
    assert all(p.start < p.end for r in rows for p in r.passages)


def test_language_on_held_out_rows(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.95


def test_odd_rows_and_empty_tables(odd_docs, labels, no_docs, no_labels):
    n = odd_docs.count()
    for some in (labels, no_labels):
        assert quality_gam.score(odd_docs, quality_gam.train(odd_docs, some)).filter("score between 0 and 1").count() == n
        assert toxicity.score(odd_docs, toxicity.train(odd_docs, some)).filter("score between 0 and 1").count() == n
        assert line_crf.judge(odd_docs, line_crf.train(odd_docs, some)).filter("kept is not null").count() == n
    said = {r.doc_id: r for r in language.predict(odd_docs, language.train(odd_docs)).collect()}
    assert said[-1].lang_pred == said[-2].lang_pred == said[-3].lang_pred == "und" and said[-4].lang_pred != "und"
    assert quality_gam.score(no_docs, quality_gam.train(no_docs, no_labels)).count() == 0
    assert toxicity.score(no_docs, toxicity.train(no_docs, no_labels)).count() == 0
    assert language.predict(no_docs, language.train(no_docs)).count() == 0
    assert line_crf.judge(no_docs, line_crf.train(no_docs, no_labels)).count() == 0
    good = quality_gam.keep_good(odd_docs, quality_gam.train(odd_docs, labels))
    assert good.columns == odd_docs.columns


def test_segments_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.choice([-3.0, -2.0, -1.0, 1.0, 2.0, 4.0], size=rng.integers(0, 25))
        want, stack = [], [(0, len(v))]
        while stack:  # the best stretch (shortest among equals), then the same on both sides of it
            a, b = stack.pop()
            best = max(((v[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 0:
                want.append(best[0])
                stack += [(a, best[3]), (best[4], b)]
        got = toxicity.segments(v)
        assert sorted(s for *_, s in got) == sorted(want)
        assert all(abs(v[a:b].sum() - s) < 1e-9 for a, b, s in got)


def test_line_counts_equal_brute_force(odd_docs, labels):
    def counts(x):
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        tri = list(zip(w, w[1:], w[2:]))
        c, cover, seen, dup = Counter(tri), set(), set(), 0
        for i, g in enumerate(tri):
            if c[g] > 1:
                cover |= {i, i + 1, i + 2}
        for line in x.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover)

    texts = Counter((r.doc_id, counts(r.text)) for r in odd_docs.select("doc_id", "text").collect())
    rows = line_crf.judge(odd_docs, line_crf.train(odd_docs, labels)).collect()
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == texts
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_viterbi_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    at = np.array([0, 4, 4, 5, 11])
    e, t = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    got = line_crf.viterbi(e, at, t)
    for a, b in zip(at[:-1], at[1:]):
        if b > a:
            best = max(product((0, 1), repeat=b - a), key=lambda y: sum(e[a + i, c] for i, c in enumerate(y)) + sum(t[x, z] for x, z in zip(y, y[1:])))
            assert tuple(got[a:b]) == best


def test_a_rare_language_is_learned_among_texts_that_are_not_empty(spark):
    """By share, 40 of 3,000 texts would hold none of the four rare ones; empty texts take no place."""
    prepare(spark)
    rows = [(k, "the and of that with this is from", "en") for k in range(3000)] + [(9000 + k, "", "xx") for k in range(500)]
    rows += [(5000 + k, "ჟღქ წჭხ ჯჰ ფცძ", "xx") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = language._picked(docs.filter("text <> ''").select("doc_id", "lang"), 40).collect()
    assert sorted(r.lang for r in picked) == ["en"] * 20 + ["xx"] * 12
    model = language.train(docs, sample=40, most_windows=60)
    assert model["langs"] == ["en", "xx"]
    out = {r.doc_id: r.lang_pred for r in language.predict(docs.filter("text <> ''"), model).collect()}
    assert all(out[5000 + k] == "xx" for k in range(12)) and out[1] == "en"
